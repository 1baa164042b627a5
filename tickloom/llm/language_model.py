"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark and scored from memory-mapped arrays.

Counting is three rounds of packed arrays. Words first: that also names the words frequent enough to be contexts too
large for one task, a thousand at most. Pairs next, dealt by context, and pairs of a frequent context by both words; each
task writes its pairs as sorted hash arrays with counts, and its contexts with what smoothing takes from them. Last, for
each word, how many contexts it follows. Counts of a few million tokens are combined before they are sent.

A model is a folder of arrays in the shared folder and a few numbers. Workers map the files into memory; nobody reads
them whole. Words are 48-bit hashes. The order is two: the model's arrays and the shuffles that count them grow with
the number of different n-grams.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.anchors import Block, mixed
from tickloom.llm.common import anonymous, identified, remainder, staged, text_bytes
from tickloom.session import fresh_folder

WORD_BYTES = 6
WORD_BITS = 8 * WORD_BYTES
END = (1 << WORD_BITS) - 1  # the token behind the last word
START = (1 << WORD_BITS) - 2  # the context of the first word; never a token
COMBINED_TOKENS = 2_000_000  # counted together before they are sent
SHARD_TOKENS = 2_000_000
FREQUENT = 1000  # a context with more than this part of all tokens is split
PAIR = np.uint64(0xBF58476D1CE4E5B9)

Arrays = tuple[np.ndarray, ...]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by END, and the number of tokens of each."""
    block = Block([text.lower() for text in texts], words=True)
    words = mixed(block.hashes(1)) >> np.uint64(64 - WORD_BITS)
    words = np.minimum(words, np.uint64(START - 1))
    return np.insert(words, block.first + block.counts, np.uint64(END)), block.counts + 1


def contexts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each, START at the beginning of a text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(before * PAIR) + words)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def narrow(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()


def wide(packed: bytes) -> np.ndarray:
    parts = np.frombuffer(packed, dtype=np.uint8).reshape(-1, WORD_BYTES)
    words = np.zeros((len(parts), 8), dtype=np.uint8)
    words[:, :WORD_BYTES] = parts
    return words.view("<u8").ravel()


def shard_of_words(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges, so that the shards' sorted arrays are in order too."""
    return ((words >> np.uint64(WORD_BITS - 32)).astype(np.int64) * shards) >> 32


def shard_of_pairs(before: np.ndarray, keys: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    by = np.where(np.isin(before, frequent), keys >> np.uint64(32), mixed(before) >> np.uint64(32))
    return (by.astype(np.int64) * shards) >> 32


def slices(shard: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for at in np.flatnonzero(np.diff(edges)):
        yield int(at), slice(edges[at], edges[at + 1])


def count_words(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, words, counts) of the tokens of ``docs``, each word in one row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, held = [], 0
        for batch in batches:
            found, counts = np.unique(tokens([text_bytes(t) for t in batch["text"]])[0], return_counts=True)
            kept.append((found, counts))
            held += len(found)
            if held >= COMBINED_TOKENS:
                yield send(kept)
                kept, held = [], 0
        if kept:
            yield send(kept)

    def send(kept: list[Arrays]) -> pd.DataFrame:
        found, counts = summed(np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]))
        rows = [
            (at, narrow(found[part]), counts[part].astype("<i8").tobytes())
            for at, part in slices(shard_of_words(found, shards), shards)
        ]
        return pd.DataFrame(rows, columns=["shard", "words", "counts"])

    return identified(docs).mapInPandas(count, "shard long, words binary, counts binary")


def merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(b"".join(rows["counts"]), dtype="<i8")
    return summed(wide(b"".join(rows["words"])), counts)


def count_pairs(docs: DataFrame, shards: int, frequent: np.ndarray) -> DataFrame:
    """(shard, contexts, sizes, words, counts): pairs by context; ``sizes`` tells how many words each context has."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, held = [], 0
        for batch in batches:
            words, sizes = tokens([text_bytes(t) for t in batch["text"]])
            kept.append((contexts(words, sizes), words))
            held += len(words)
            if held >= COMBINED_TOKENS:
                yield send(kept)
                kept, held = [], 0
        if kept:
            yield send(kept)

    def send(kept: list[Arrays]) -> pd.DataFrame:
        before, words = (np.concatenate(each) for each in zip(*kept, strict=True))
        keys = pair_keys(before, words)
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        before, words, keys = before[first], words[first], keys[first]
        shard = shard_of_pairs(before, keys, frequent, shards)
        order = np.lexsort((words, before, shard))
        before, words, counts, shard = before[order], words[order], counts[order], shard[order]
        rows = []
        for at, part in slices(shard, shards):
            own = before[part]
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sizes = np.diff(np.append(begins, len(own))).astype("<u4")
            packed = narrow(own[begins]), sizes.tobytes(), narrow(words[part]), counts[part].astype("<u4").tobytes()
            rows.append((at, *packed))
        return pd.DataFrame(rows, columns=["shard", "contexts", "sizes", "words", "counts"])

    schema = "shard long, contexts binary, sizes binary, words binary, counts binary"
    return identified(docs).mapInPandas(count, schema)


def tally(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4."""
    return [int(np.count_nonzero(counts == number)) for number in (1, 2, 3, 4)]


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how often 1 to 4 occur. Where one never occurs, half, one and one and a half."""
    one, two, three, four = counts
    if not all(counts):
        return 0.5, 1.0, 1.5
    part = one / (one + 2 * two)
    found = 1 - 2 * part * two / one, 2 - 3 * part * three / two, 3 - 4 * part * four / three
    return tuple(float(np.clip(value, 0.05 * k, 0.95 * k)) for k, value in enumerate(found, 1))


def store(folder: str, name: str, array: np.ndarray) -> None:
    """One array as a file of the shared folder. A repeated task writes the same again."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(np.ascontiguousarray(array).tobytes())


def narrowest(counts: np.ndarray) -> np.ndarray:
    """The counts in four bytes each if all of them fit, else in eight; a reader sees which by the array's size."""
    return counts.astype("<u4" if counts.max(initial=0) < 2**32 else "<u8")


FOLDERS: dict[str, str] = {}  # of each worker: local place of a model


def local(folder: str) -> str:
    """Where a model's files can be mapped: the folder itself, or a copy if it is in a remote store."""
    if folder.startswith("file:") or "://" not in folder:
        return folder.removeprefix("file://").removeprefix("file:")
    if folder not in FOLDERS:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        FOLDERS.clear()
        place = tempfile.mkdtemp(prefix="model-")
        fs.copy_files(path, place, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        FOLDERS[folder] = place
    return FOLDERS[folder]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for all of them."""

    folder: str
    shards: int
    total: int  # tokens
    words: int  # different ones
    pairs: int  # different ones
    word_discounts: tuple[float, float, float]
    word_rest: float  # part of the continuation distribution that goes to all words alike
    pair_discounts: tuple[float, float, float]
    frequent: np.ndarray
    frequent_stats: np.ndarray  # total, followers with count 1, 2 and more


def uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


def train(docs: DataFrame) -> Model:
    """A model of all rows of ``docs`` (doc_id, text); null texts are empty."""
    spark = docs.sparkSession
    folder = uri(fresh_folder(spark, "language-model"))
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = int((size // 6 + rows) // SHARD_TOKENS + 1)

    def merge_words(group: pd.DataFrame) -> pd.DataFrame:
        found, counts = merged(group)
        row = (group["shard"].iloc[0], narrow(found), counts.astype("<i8").tobytes(), int(counts.sum()), len(found))
        return pd.DataFrame([row], columns=["shard", "words", "counts", "total", "different"])

    words = count_words(docs, shards).groupBy("shard").applyInPandas(
        merge_words, "shard long, words binary, counts binary, total long, different long"
    )
    words = staged(words, "model-words")
    total, different = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()

    def often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed, counts in zip(batch["words"], batch["counts"], strict=True):
                hit = np.frombuffer(counts, dtype="<i8") > total / FREQUENT
                yield pd.DataFrame({"word": wide(packed)[hit].astype(np.int64)})

    frequent = words.mapInPandas(often, "word long").toPandas()["word"].to_numpy(dtype=np.uint64)
    if rows > total / FREQUENT:
        frequent = np.append(frequent, np.uint64(START))
    frequent = np.sort(frequent)

    def merge_pairs(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        sizes = np.frombuffer(b"".join(group["sizes"]), dtype="<u4")
        before = np.repeat(wide(b"".join(group["contexts"])), sizes)
        follow = wide(b"".join(group["words"]))
        counts = np.frombuffer(b"".join(group["counts"]), dtype="<u4").astype(np.int64)
        keys = pair_keys(before, follow)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        counts = np.add.reduceat(counts[order], first)
        at = order[first]
        before, follow, keys = before[at], follow[at], keys[at]
        store(folder, f"pair-keys-{shard}", keys)
        store(folder, f"pair-counts-{shard}", narrowest(counts))
        order = np.argsort(before, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(before[order]) != 0]))
        ordered = counts[order]
        sums = [np.add.reduceat(x, begins) for x in (ordered, ordered == 1, ordered == 2, ordered >= 3)]
        stats = np.stack([np.asarray(x, dtype=np.int64) for x in sums], axis=1)
        names = before[order][begins]
        split = np.isin(names, frequent)
        store(folder, f"context-keys-{shard}", names[~split])
        store(folder, f"context-stats-{shard}", narrowest(stats[~split]))
        heads = [("context", int(w), *map(int, s), 0, b"", b"") for w, s in zip(names[split], stats[split], strict=True)]
        heads.append(("tally", shard, *tally(counts), len(counts), b"", b""))
        seen, times = np.unique(follow, return_counts=True)
        for place, part in slices(shard_of_words(seen, shards), shards):
            heads.append(("follows", place, 0, 0, 0, 0, 0, narrow(seen[part]), times[part].astype("<i8").tobytes()))
        return pd.DataFrame(heads, columns=["kind", "key", "a", "b", "c", "d", "n", "words", "counts"])

    schema = "kind string, key long, a long, b long, c long, d long, n long, words binary, counts binary"
    found = count_pairs(docs, shards, frequent).groupBy("shard").applyInPandas(merge_pairs, schema)
    found = staged(found, "model-pairs")
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("a", "b", "c", "d", "n")]
    pair_tally = found.where("kind = 'tally'").agg(*sums).first()
    heads = found.where("kind = 'context'").groupBy("key").agg(*sums).toPandas()
    stats = heads.set_index("key").reindex(frequent.astype(np.int64)).fillna(0)[["a", "b", "c", "d"]].to_numpy(np.float64)

    def merge_follows(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        plain = group["kind"] == "words"
        names, counts = merged(group[plain])
        seen, times = merged(group[~plain])
        follows = np.zeros(len(names), dtype=np.int64)
        follows[np.searchsorted(names, seen)] = times
        store(folder, f"word-keys-{shard}", names)
        store(folder, f"word-counts-{shard}", np.stack([counts, follows], axis=1).astype("<i8"))
        return pd.DataFrame([(*tally(follows), int(np.count_nonzero(follows)))], columns=["a", "b", "c", "d", "n"])

    both = words.select("shard", F.lit("words").alias("kind"), "words", "counts").unionByName(
        found.where("kind = 'follows'").select(F.col("key").alias("shard"), "kind", "words", "counts")
    )
    last = both.groupBy("shard").applyInPandas(merge_follows, "a long, b long, c long, d long, n long")
    word_tally = staged(last, "model-tally").agg(*sums).first()
    one, two, three = discounts(list(word_tally)[:4])
    more = word_tally["n"] - word_tally["a"] - word_tally["b"]
    rest = (one * word_tally["a"] + two * word_tally["b"] + three * more) / max(1, pair_tally["n"])
    return Model(
        folder, shards, int(total), int(different), int(pair_tally["n"]), (one, two, three),
        rest if total else 1.0, discounts(list(pair_tally)[:4]), frequent, stats,
    )


class Reader:
    """A model's arrays, mapped into memory."""

    def __init__(self, model: Model) -> None:
        self.model, self.folder = model, local(model.folder)
        self.open: dict[str, np.ndarray] = {}

    def array(self, name: str, shard: int, kind: str | None, width: int = 1, rows: int = 0) -> np.ndarray:
        """An array with so many numbers a row; where the kind is not given, that of ``narrowest`` for these rows."""
        name = f"{name}-{shard}"
        if name not in self.open:
            path = os.path.join(self.folder, name)
            filled = os.path.exists(path) and os.path.getsize(path)
            if kind is None:
                kind = f"<u{filled // (rows * width)}" if filled else "<u4"
            flat = np.memmap(path, dtype=kind, mode="r") if filled else np.empty(0, dtype=kind)
            self.open[name] = flat.reshape(-1, width) if width > 1 else flat
        return self.open[name]

    def look_up(self, keys: np.ndarray, shard: np.ndarray, names: tuple[str, str], kind: str | None, width: int) -> np.ndarray:
        """Stored numbers of each key, zeros where it is unknown. ``shard`` in any order."""
        found = np.zeros((len(keys), width))
        order = np.lexsort((keys, shard))
        for at, part in slices(shard[order], self.model.shards):
            known = self.array(names[0], at, "<u8")
            if not len(known):
                continue
            own = order[part]
            place = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
            hit = known[place] == keys[own]
            found[own[hit]] = self.array(names[1], at, kind, width, len(known))[place[hit]].reshape(-1, width)
        return found

    def words(self, words: np.ndarray) -> np.ndarray:
        """Count, and number of contexts, of each."""
        shard = shard_of_words(words, self.model.shards)
        return self.look_up(words, shard, ("word-keys", "word-counts"), "<i8", 2)

    def contexts(self, before: np.ndarray) -> np.ndarray:
        """Total, and followers with count 1, 2 and more, of each."""
        model = self.model
        shard = shard_of_pairs(before, np.zeros_like(before), model.frequent[:0], model.shards)
        found = self.look_up(before, shard, ("context-keys", "context-stats"), None, 4)
        split = np.isin(before, model.frequent)
        found[split] = model.frequent_stats[np.searchsorted(model.frequent, before[split])]
        return found

    def pairs(self, before: np.ndarray, words: np.ndarray, keys: np.ndarray) -> np.ndarray:
        shard = shard_of_pairs(before, keys, self.model.frequent, self.model.shards)
        return self.look_up(keys, shard, ("pair-keys", "pair-counts"), None, 1)[:, 0]

    def probabilities(self, before: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word behind its context, and how often each word was counted."""
        model = self.model
        names, back = np.unique(words, return_inverse=True)
        known = self.words(names)
        counts, follows = known[:, 0], known[:, 1]
        plain = np.maximum(follows - taken(follows, model.word_discounts), 0) / max(1, model.pairs)
        plain = (plain + model.word_rest / (model.words + 1))[back]
        heads, head_back = np.unique(before, return_inverse=True)
        stats = self.contexts(heads)
        total = np.maximum(stats[:, 0], 1)
        left = np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(model.pair_discounts) / total, 1.0)
        keys, first, pair_back = np.unique(pair_keys(before, words), return_index=True, return_inverse=True)
        pairs = self.pairs(before[first], words[first], keys)
        pairs = np.maximum(pairs - taken(pairs, model.pair_discounts), 0)[pair_back]
        return pairs / total[head_back] + left[head_back] * plain, counts[back]


def taken(counts: np.ndarray, by_count: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by_count])[np.minimum(counts, 3).astype(np.int64)]


READERS: dict[str, Reader] = {}  # of each worker, the last one only


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs`` (doc_id, text).

    Scores are base-10 logarithms of the text's probability, its end included: ``base_score`` by single words with one
    added to each count, ``score`` by the model. Null and empty texts are the end alone. Other columns are ignored.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model.folder not in READERS:
            READERS.clear()
            READERS[model.folder] = Reader(model)
        reader = READERS[model.folder]
        for batch in batches:
            if not len(batch):
                continue
            words, sizes = tokens([text_bytes(text) for text in batch["text"]])
            chances, counts = reader.probabilities(contexts(words, sizes), words)
            begins = np.cumsum(sizes) - sizes
            base = np.log10((counts + 1) / (model.total + model.words + 1))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": sizes,
                    "n_known": np.add.reduceat((counts > 0).astype(np.int64), begins),
                    "base_score": np.add.reduceat(base, begins),
                    "score": np.add.reduceat(np.log10(chances), begins),
                }
            )

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    return anonymous(identified(docs).mapInPandas(of, schema))


def language_model_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(remainder("doc_id", 7) != 2))
    scored = staged(score(docs, model), "language-scores")
    return scored.select(
        "doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
    )


def forget(model: Model) -> None:
    """Delete a model's files, once nothing scores with it any more."""
    if model.folder.startswith("file://"):
        shutil.rmtree(model.folder.removeprefix("file://"), ignore_errors=True)
