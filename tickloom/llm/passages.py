"""Substring dedup on words by compaction of a De Bruijn graph.

Exact copies of a smaller id's text go whole and take no part in the rest. A run of ``window`` words is an edge from its first ``window - 1`` words to its last; texts are walks. Only edges that
can repeat matter, and only those are made (see ``anchors``). They come as stretches, runs of edges that share their
anchor; equal stretches are one row from then on. Edges are grouped to count what comes before and after each: where an
edge has one follower, and that one has one forerunner, every text that holds either holds both. Joining this back cuts
the walks into the graph's nonbranching paths. All edges of a path occur in the same texts, so a path has one source,
the smallest id that holds it. The words at the source's coordinates are compared, by a digest of their text, with those
at each other place before anything is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.anchors import Block, copies, copy_mark, repeated_windows, text_key
from tickloom.llm.common import anonymous, identified, staged, text_bytes

WINDOW = 50
GRAM = 16


def stretches(docs: DataFrame, known: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, pos, n, stretch, edges): n edges from word pos on. ``edges`` has one more at both ends, zero for none,
    and is null where the same block has listed the same stretch before."""

    def emit(texts: pd.DataFrame, block: Block, lowest: np.ndarray, candidate: np.ndarray) -> pd.DataFrame:
        from xxhash import xxh3_64_intdigest

        names = ["doc_id", "text_key", "pos", "n", "stretch", "edges"]
        at = np.flatnonzero(candidate)
        if not len(at):
            return pd.DataFrame({name: pd.Series(dtype="object") for name in names})
        hashes = block.hashes(window) | np.uint64(1)
        padded = np.zeros(len(hashes) + 2, dtype=np.uint64)
        padded[1:-1] = np.where(candidate, hashes, np.uint64(0))
        text = block.text_of(at)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > 1) | (lowest[at][1:] != lowest[at][:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        first, last = at[begin], at[np.concatenate([begin[1:], [len(at)]]) - 1]
        # Windows that would run into the next text are no candidates, so texts are apart by zeros.
        seen: set[int] = set()
        rows = []
        own, pos = texts.iloc[text[begin]], first - block.first[text[begin]]
        columns = (own["doc_id"].tolist(), own["text_key"].tolist(), pos.tolist(), first.tolist(), last.tolist())
        for doc_id, text_mark, place, low, high in zip(*columns, strict=True):
            edges = padded[low : high + 3]
            key = xxh3_64_intdigest(edges.tobytes()) - (1 << 63)
            rows.append((doc_id, text_mark, place, high - low + 1, key, None if key in seen else edges.view(np.int64)))
            seen.add(key)
        return pd.DataFrame(rows, columns=names)

    schema = "doc_id long, text_key long, pos long, n long, stretch long, edges array<long>"
    return repeated_windows(docs, known, True, window, gram, emit, schema)


def paths(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, path, pos, n, source_id): nonbranching paths along every text, named by their first edge."""
    listed = found.where("edges is not null").groupBy("stretch", "n", "edges").agg(F.min("doc_id").alias("least_id"))
    three = F.arrays_zip(
        F.slice("edges", F.lit(1), F.col("n").cast("int")).alias("before"),
        F.slice("edges", F.lit(2), F.col("n").cast("int")).alias("edge"),
        F.slice("edges", F.lit(3), F.col("n").cast("int")).alias("after"),
    )
    steps = listed.select("stretch", "least_id", "n", F.posexplode(three).alias("place", "step"))
    # Twice the place, and one more for the last edge: rows are many, so they are kept narrow.
    spot = F.col("place").cast("long") * 2 + F.when(F.col("place") == F.col("n") - 1, 1).otherwise(0)
    steps = steps.select("stretch", "least_id", spot.alias("spot"), "step.*")
    graph = steps.groupBy("edge").agg(
        F.min("least_id").alias("source_id"),
        F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1"),
    )
    graph = graph.select(
        F.col("edge").alias("at_edge"),
        "source_id",
        ((F.col("b0") != F.col("b1")) | (F.col("b0") == 0)).alias("opens"),
        ((F.col("a0") != F.col("a1")) | (F.col("a0") == 0)).alias("closes"),
    )
    marks = steps.join(graph, F.col("edge") == F.col("at_edge"))
    marks = marks.where("opens or closes or spot < 2 or spot % 2 = 1").withColumn("place", F.expr("spot div 2"))
    marks = marks.groupBy("stretch").agg(
        F.collect_list(F.struct("place", "edge", "opens", "closes", "source_id")).alias("marks")
    )
    walks = found.select("doc_id", "text_key", "pos", "stretch").join(marks, "stretch")
    walks = walks.select("doc_id", "text_key", "pos", F.explode("marks").alias("mark"))
    walks = walks.select("doc_id", "text_key", (F.col("pos") + F.col("mark.place")).alias("at"), "mark.*")
    along = Window.partitionBy("doc_id", "text_key").orderBy("at")
    starts = F.col("opens") | F.coalesce(F.lag("closes").over(along), F.lit(True))
    walks = walks.withColumn("starts", starts)
    walks = walks.withColumn("turn", F.sum(F.col("starts").cast("long")).over(along))
    spans = walks.groupBy("doc_id", "text_key", "turn").agg(
        F.min(F.when(F.col("starts"), F.col("edge"))).alias("path"),
        F.min("at").alias("pos"),
        F.max("at").alias("last"),
        F.min("source_id").alias("source_id"),
    )
    return spans.select("doc_id", "text_key", "path", "pos", (F.col("last") - F.col("pos") + 1).alias("n"), "source_id")


def digests(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(path, n, digest) of the words at each (doc_id, text_key, pos, n) of ``wanted``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                words = text_bytes(text).split()
                mark = text_key(text_bytes(text))
                for span in spans:
                    if span["text_key"] != mark:
                        continue
                    part = words[span["pos"] : span["pos"] + span["n"] + window - 1]
                    rows.append((span["path"], span["n"], xxh3_128_digest(b" ".join(part))))
            yield pd.DataFrame(rows, columns=["path", "n", "digest"])

    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "path", "pos", "n")).alias("spans"))
    joined = docs.select("doc_id", "text").join(lists, "doc_id").select("text", "spans")
    return joined.mapInPandas(read, "path long, n long, digest binary")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept], and the columns of ``carry``) of every row.

    ``kept`` is the text as it was where nothing is removed, and else its remaining words with one space between.

    A word goes if a window that covers it also starts in a text with a smaller id. Null and empty texts have no words;
    rows without doc_id keep all theirs. Rows that repeat an id are no sources for each other, and if their texts
    differ each is judged by windows of smaller ids only. Other columns are ignored.
    """
    known = staged(copies(docs), "copies")
    found = staged(stretches(docs, known, window, gram), "stretches")
    spans = staged(paths(found), "paths")
    sources = spans.where("doc_id = source_id").groupBy("path", "n", "doc_id", "text_key").agg(
        F.min("pos").alias("pos")
    )
    repeats = spans.where("doc_id > source_id")
    needed = sources.join(repeats.select("path", "n").distinct(), ["path", "n"], "left_semi")
    proofs = digests(docs, needed, window).dropDuplicates(["path", "n"])
    proven = repeats.join(proofs, ["path", "n"]).select("doc_id", "text_key", "pos", "n", "digest")
    lists = proven.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "pos", "n", "digest")).alias("spans"))
    copied = known.groupBy("doc_id").agg(F.collect_list("copy_mark").alias("copy"))
    lists = lists.join(copied, "doc_id", "full_outer")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            columns = (batch["doc_id"].tolist(), batch["text"], batch["spans"], batch["copy"])
            for doc_id, text, spans, copy in zip(*columns, strict=True):
                words = text_bytes(text).split()
                total = len(words)
                if copy is not None and copy_mark(text_bytes(text)) in copy:
                    words = words if total < window else []
                elif spans is not None:
                    gone, mark = bytearray(total), text_key(text_bytes(text))
                    for span in spans:
                        if span["text_key"] != mark:
                            continue
                        low, high = span["pos"], span["pos"] + span["n"] + window - 1
                        if xxh3_128_digest(b" ".join(words[low:high])) == span["digest"]:
                            gone[low:high] = b"\x01" * (min(high, total) - low)
                    words = [word for word, hit in zip(words, gone, strict=True) if not hit]
                kept = b" ".join(words)
                row = (doc_id, total, total - len(words), sha256(kept).hexdigest())
                left = kept.decode("utf-8", "surrogatepass") if len(words) < total else text
                rows.append((*row, left) if with_text else row)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
            found = pd.DataFrame(rows, columns=names)
            yield found.assign(carried=batch["carried"]) if carry else found

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    # Carried columns pass through Python as one text, so that nulls and large numbers stay what they are.
    carried = F.to_json(F.struct(*carry)).alias("carried") if carry else None
    texts = identified(docs, *([carried] if carry else []))
    joined = texts.join(lists, "doc_id", "left").select(*texts.columns, "spans", "copy")
    found = anonymous(joined.mapInPandas(cut, schema + ", carried string" * bool(carry)))
    if not carry:
        return found
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in docs.select(*carry).dtypes)
    parsed = F.from_json("carried", kinds)
    return found.select(*[name for name in found.columns if name != "carried"], *[parsed[name].alias(name) for name in carry])


def passages_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of all documents."""
    return staged(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")), "passages")
