"""Substring dedup on bytes with the Burrows-Wheeler transform of a collection, built column by column.

A string of ``window`` bytes is removed where it also starts in a text with a smaller id. Only windows that can repeat
matter (see ``anchors``). Runs of such windows are cut where their smallest short gram changes, into pieces of less than
two windows; equal windows have equal grams, so pieces that share a window come to the same task. Equal pieces are one
row from then on, with the smallest id that holds them.

A task takes its pieces as a collection of strings and builds the collection's transform and common prefixes from the
right: each round inserts one more symbol of every string. Where it goes follows from counting symbols in the transform
of the round before; the common prefixes with the suffixes next to it are one longer than those one symbol further on.
Both lie in files that a round reads and writes once, in order. In the finished order, suffixes with ``window`` bytes in
common stand together, and the smallest id of each such run is the source of all its windows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import sha256
from tempfile import TemporaryDirectory

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.anchors import Block, anchors, copies, copy_mark, repeated_windows, text_key
from tickloom.llm.common import anonymous, identified, staged, text_bytes

WINDOW = 50
GRAM = 32
DEALING_GRAM = 8
COLLECTION_BYTES = 300_000


class Column:
    """Numbers of one byte in two files by turns; each round reads the last version in order and writes the next."""

    def __init__(self, folder: str, name: str, values: np.ndarray) -> None:
        self.files = [open(os.path.join(folder, f"{name}.{turn}"), "w+b", buffering=0) for turn in (0, 1)]
        self.write(values.astype(np.uint8))

    def write(self, values: np.ndarray) -> None:
        self.files.reverse()
        self.files[0].seek(0)
        self.files[0].write(values)
        self.size = len(values)

    def read(self) -> np.ndarray:
        """All numbers, and a zero."""
        values = np.empty(self.size + 1, dtype=np.uint8)
        values[-1] = 0
        self.files[0].seek(0)
        self.files[0].readinto(values[:-1])
        return values

    def close(self) -> None:
        for file in self.files:
            file.close()


def least_between(prefixes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of prefixes[low + 1 .. high] for each pair, low < high; cheap in ascending order.

    ``prefixes`` ends with a number that is not asked for.
    """
    if not len(low):
        return np.empty(0, dtype=np.uint8)
    edges = np.empty(2 * len(low), dtype=np.int64)
    edges[::2], edges[1::2] = low + 1, high + 1
    return np.minimum.reduceat(prefixes, edges)[::2]


def ordered_windows(strings: list[bytes], window: int, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, first of its kind) of all windows of the strings, in order of the suffixes they begin.

    Symbols are bytes plus one; zero is the end of a string. UTF-8 has no byte 255. Strings begin in one column: a round
    inserts the suffixes of all strings from one start on, and a string is taken up in the round of its last symbol. So
    short ones add nothing to the early rounds, and no round is left to long ones alone.
    """
    count, lengths = len(strings), np.array([len(s) for s in strings])
    longest = int(lengths.max())
    symbols = np.zeros((longest + 1, count), dtype=np.uint8)  # symbols[j]: before the suffixes of the j-th round
    ends = np.cumsum(lengths)
    turn = np.repeat(ends - lengths + longest - 1, lengths) - np.arange(ends[-1])  # of each symbol, the round before its own
    symbols.ravel()[turn * count + np.repeat(np.arange(count), lengths)] = np.frombuffer(b"".join(strings), dtype=np.uint8) + np.uint8(1)
    transform = Column(folder, "transform", symbols[0])
    prefixes = Column(folder, "prefixes", np.zeros(count))
    taken_up = np.split(*taken_up_by_round(lengths, longest))
    active = at = np.empty(0, dtype=np.int64)  # strings by place of their last suffix, and the places, ascending
    for length in range(1, longest + 1):
        before, common = transform.read()[:-1], prefixes.read()
        begun = taken_up[length - 1]
        if len(begun):  # ends are the first places, in order of strings; nothing stood before these until now
            active, at = np.concatenate([begun, active]), np.concatenate([begun, at])
            before[begun] = symbols[length - 1][begun]
        size, by_symbol = len(before), np.argsort(before, kind="stable")
        here = np.zeros(size, dtype=bool)
        here[at] = True
        rank = np.flatnonzero(here.take(by_symbol))  # of the active places, by symbol and place
        turn = np.argsort(before[at], kind="stable")
        put = rank + len(active)  # all ends come first; those of strings not taken up have nothing before
        back = np.empty_like(turn)
        back[turn] = np.arange(len(turn))
        rank = rank[back]  # by place again, as the common prefixes lie

        neighbour = by_symbol[np.maximum(rank - 1, 0)]
        has = (rank > 0) & (before[neighbour] == before[at])
        shared = np.zeros(len(at), dtype=np.uint8)
        shared[has] = np.minimum(least_between(common, neighbour[has], at[has]) + 1, window)
        neighbour = by_symbol[np.minimum(rank + 1, size - 1)]
        has = (rank < size - 1) & (before[neighbour] == before[at])
        next_put = put[back[has]] + 1
        next_shared = np.minimum(least_between(common, at[has], neighbour[has]) + 1, window)

        old = np.ones(size + len(at), dtype=bool)
        old[put] = False
        active, merged = active[turn], np.empty(len(old), dtype=np.uint8)
        merged[old], merged[put] = before, symbols[length][active]
        transform.write(merged)
        merged[old], merged[put] = common[:-1], shared[turn]
        merged[next_put] = next_shared
        prefixes.write(merged)
        at = put
    before, common = transform.read()[:-1], prefixes.read()
    transform.close()
    prefixes.close()
    owners = window_owners(before, lengths, window)
    found = np.flatnonzero(owners >= 0)
    return *np.divmod(owners[found], longest + 1), common[found] < window


def taken_up_by_round(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings in the order they are taken up, ascending in a round, and where each round but the first begins."""
    order = np.argsort(longest - lengths, kind="stable")
    return order, np.searchsorted((longest - lengths)[order], np.arange(1, longest))


def window_owners(transform: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """String and start, as string * (longest + 1) + start, of each suffix of a window at least; -1 for the others.

    The finished transform is followed from each string's end to its start: a symbol's rank is the place of the suffix
    that it begins.
    """
    longest = int(lengths.max())
    following, owners = np.empty(len(transform), dtype=np.int64), np.full(len(transform), -1, dtype=np.int64)
    following[np.argsort(transform, kind="stable")] = np.arange(len(transform))
    strings = places = np.arange(len(lengths))
    for length in range(1, longest + 1):
        if (lengths[strings] < length).any():
            going = lengths[strings] >= length
            strings, places = strings[going], places[going]
        places = following[places]
        if length >= window:
            owners[places] = strings * (longest + 1) + lengths[strings] - length
    return owners


def sources(collection: pd.DataFrame, window: int) -> pd.DataFrame:
    """(piece_id, low, high, source_id): the smallest id with the windows low..high of each piece."""
    with TemporaryDirectory() as folder:
        owners, starts, new = ordered_windows(collection["piece"].tolist(), window, folder)
    least = collection["least_id"].to_numpy()[owners]
    kinds = np.flatnonzero(new)
    source = np.repeat(np.minimum.reduceat(least, kinds), np.diff(np.append(kinds, len(new))))
    # Each string and start is there once, so its number is its place: no sort.
    width = int(starts.max()) + 1
    place = np.full((int(owners.max()) + 1) * width, -1)
    place[owners * width + starts] = np.arange(len(owners))
    order = place[place >= 0]
    owners, starts, source = owners[order], starts[order], source[order]
    turn = np.ones(len(owners), dtype=bool)
    turn[1:] = (owners[1:] != owners[:-1]) | (source[1:] != source[:-1])
    first = np.flatnonzero(turn)
    last = np.append(first[1:], len(owners)) - 1
    return pd.DataFrame(
        {
            "piece_id": collection["piece_id"].to_numpy()[owners[first]],
            "low": starts[first].astype(np.int64),
            "high": starts[last].astype(np.int64),
            "source_id": source[first],
        }
    )


def pieces(docs: DataFrame, known: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, pos, piece_id, deal, piece): ``piece`` is null where the same block has listed the same one before."""

    def emit(texts: pd.DataFrame, block: Block, lowest: np.ndarray, candidate: np.ndarray) -> pd.DataFrame:
        from xxhash import xxh3_64_intdigest

        names = ["doc_id", "text_key", "pos", "piece_id", "deal", "piece"]
        at = np.flatnonzero(candidate)
        if not len(at):
            return pd.DataFrame({name: pd.Series(dtype="object") for name in names})
        short_gram = min(DEALING_GRAM, gram)
        _, short = anchors(block, window, short_gram)
        text = block.text_of(at)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > 1) | (short[at][1:] != short[at][:-1]) | (text[1:] != text[:-1])
        run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= (np.arange(len(at)) - run) % (window - short_gram + 1) == 0  # where one gram recurs, a run could go on for ever
        begin = np.flatnonzero(new)
        first, last = at[begin], at[np.append(begin[1:], len(at)) - 1]
        data = block.data.tobytes()
        listed = [data[low:high] for low, high in zip(first.tolist(), (last + window).tolist(), strict=True)]
        keys = np.fromiter(map(xxh3_64_intdigest, listed), dtype=np.uint64, count=len(listed)) - np.uint64(1 << 63)
        listed = pd.Series(listed, dtype="object")
        listed[pd.Series(keys).duplicated()] = None
        own = texts.iloc[text[begin]]
        columns = own["doc_id"].to_numpy(), own["text_key"].to_numpy(), first - block.first[text[begin]]
        columns = (*columns, keys.view(np.int64), short[first].astype(np.int64), listed)
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    schema = "doc_id long, text_key long, pos long, piece_id long, deal long, piece binary"
    return repeated_windows(docs, known, False, window, gram, emit, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Null and empty texts have no bytes; rows without doc_id keep all theirs. Rows that repeat an id are no sources for
    each other. What is kept of a text may not be UTF-8. Other columns are ignored.
    """
    known = staged(copies(docs), "copies")
    found = staged(pieces(docs, known, window, gram), "pieces")
    listed = found.where("piece is not null")
    collections = (listed.agg(F.sum(F.octet_length("piece"))).first()[0] or 0) // COLLECTION_BYTES + 1
    # Each block has listed a piece once; what it lists moves once, and is counted where its collection is.
    listed = listed.withColumn("collection", F.pmod(F.xxhash64("deal"), F.lit(collections))).repartition("collection")
    distinct = listed.groupBy("collection", "piece_id", "piece").agg(F.min("doc_id").alias("least_id"))

    def sorted_out(collection: pd.DataFrame) -> pd.DataFrame:
        return sources(collection, window)

    first = distinct.groupBy("collection").applyInPandas(
        sorted_out, "piece_id long, low long, high long, source_id long"
    )
    hits = found.select("doc_id", "text_key", "pos", "piece_id").join(first, "piece_id").where("doc_id > source_id")
    low, high = (F.col("pos") + F.col("low")).alias("low"), (F.col("pos") + F.col("high")).alias("high")
    lists = hits.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", low, high)).alias("spans"))
    copied = known.groupBy("doc_id").agg(F.collect_list("copy_mark").alias("copy"))
    lists = lists.join(copied, "doc_id", "full_outer")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            columns = (batch["doc_id"].tolist(), batch["text"], batch["spans"], batch["copy"])
            for doc_id, text, hits, copy in zip(*columns, strict=True):
                data, runs = text_bytes(text), 0
                kept = data
                copied = copy is not None and copy_mark(data) in copy
                if copied and len(data) >= window:
                    kept, runs = b"", 1
                elif not copied and hits is not None:
                    mark = text_key(data)
                    hits = [hit for hit in hits if hit["text_key"] == mark]
                    steps = np.zeros(len(data) + 1, dtype=np.int32)
                    np.add.at(steps, [hit["low"] for hit in hits], 1)
                    np.add.at(steps, [hit["high"] + window for hit in hits], -1)
                    gone = np.cumsum(steps)[:-1] > 0
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                row = (doc_id, len(data), len(data) - len(kept), runs, sha256(kept).hexdigest())
                rows.append((*row, kept) if with_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    joined = identified(docs).join(lists, "doc_id", "left").select("doc_id", "text", "spans", "copy")
    return anonymous(joined.mapInPandas(cut, schema))


def suffixes_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    return staged(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")), "suffixes")
