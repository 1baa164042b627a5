"""Which windows of texts can occur twice, found by anchors, so that only those need be compared in full.

A unit is a word or a byte; a window is ``window`` consecutive units of one text. Each window has an anchor, the gram
(``gram`` units) in it with the smallest hash. Equal windows have equal anchors: a window whose anchor occurs only once
in the whole collection is unique. About one unit in ``(window - gram) / 2`` is an anchor, so telling windows apart by
anchors costs a small part of looking at each.

Texts are dealt into blocks by their id. A block sends the distinct hashes of its anchors, a few bytes each, to buckets
by hash; a bucket answers each block with one bit a hash. Anchors that repeat inside a block are sent once, so a passage
that a third of all texts share sends a row per block and not per text. Exact copies of a text with a smaller id are
known beforehand and take no part; other texts of their ids do.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import text_bytes

BLOCK_BYTES = 1_000_000
BUCKET_ANCHORS = 1_000_000
SPARE_BITS = 14  # a unique anchor is taken for a repeated one once in 2 ** SPARE_BITS

COPIES = -1  # in place of a bucket, for rows that list a copy

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
STEP = 0xD1342543DE82EF95
SYMBOLS = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
POWERS: dict[str, np.ndarray] = {}  # of each worker


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """r ** i and r ** -i modulo 2 ** 64 for i below ``count``."""
    if len(POWERS.get("up", ())) < count:
        for name, base in (("up", STEP), ("down", pow(STEP, -1, 1 << 64))):
            steps = np.full(max(count, BLOCK_BYTES), base, dtype=np.uint64)
            steps[0] = 1
            POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return POWERS["up"], POWERS["down"]


def text_key(text: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text) - (1 << 63)


def copy_mark(text: bytes) -> int:
    """What Spark's xxhash64 gives for the text."""
    from xxhash import xxh64_intdigest

    mark = xxh64_intdigest(text, 42)
    return mark - (1 << 64) if mark >> 63 else mark


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(MULTIPLIER)
    return values ^ (values >> np.uint64(29))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order. Here a sort takes a small part of the time of numpy's own, which hashes them first."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def sliding(values: np.ndarray, width: int, choose: Callable) -> np.ndarray:
    """choose() of values[i : i + width] for each i that has so many."""
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        values = choose(values[:-step], values[step:])
        covered += step
    return values


class Block:
    """Texts of one block as units, one text after another, with hashes of unit ranges."""

    def __init__(self, texts: list[bytes], words: bool) -> None:
        if words:
            units = [text.split() for text in texts]
            self.counts = np.array([len(each) for each in units], dtype=np.int64)
            joined = b" ".join([word for each in units for word in each])
            data = np.frombuffer(joined, dtype=np.uint8)
            gaps = np.flatnonzero(data == 32)
            self.starts = np.concatenate([[0], gaps + 1])[: self.counts.sum()]
            self.ends = np.concatenate([gaps, [len(data)]])[: self.counts.sum()]
        else:
            self.counts = np.array([len(text) for text in texts], dtype=np.int64)
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            self.starts = self.ends = None
        self.data = data
        self.first = np.cumsum(self.counts) - self.counts  # unit at which each text begins
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(SYMBOLS[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, length: int, units: np.ndarray | None = None) -> np.ndarray:
        """Of the ``length`` units from each unit on, those that run into the next text included."""
        if units is not None:
            at = units if self.starts is None else self.starts[units]
            end = units + length if self.starts is None else self.ends[units + length - 1]
            return (self.sums[end] - self.sums[at]) * self.down[at]
        count = int(self.counts.sum()) - length + 1
        if count <= 0:
            return np.empty(0, dtype=np.uint64)
        if self.starts is None:
            return (self.sums[length : length + count] - self.sums[:count]) * self.down[:count]
        at = self.starts[:count]
        return (self.sums[self.ends[length - 1 : length - 1 + count]] - self.sums[at]) * self.down[at]

    def inside(self, length: int) -> np.ndarray:
        """Whether the ``length`` units from each unit on belong to one text."""
        count = max(0, int(self.counts.sum()) - length + 1)
        within = np.ones(int(self.counts.sum()) + 1, dtype=bool)
        for back in range(1, length):
            at = self.first + self.counts - back
            within[at[at >= self.first]] = False
        return within[:count]

    def text_of(self, units: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first + self.counts, units, side="right")


def anchors(block: Block, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each gram, half of its hash, and the smallest rank in each window; zero for windows of two texts."""
    ranks = ((block.hashes(gram) * np.uint64(MULTIPLIER)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    lowest = sliding(ranks, window - gram + 1, np.minimum) if len(ranks) > window - gram else ranks[:0]
    return ranks, np.where(block.inside(window), lowest, np.uint32(0))


def chosen_anchors(ranks: np.ndarray, lowest: np.ndarray, width: int) -> np.ndarray:
    """Places of grams that are the anchor of some window."""
    if not len(lowest):
        return np.empty(0, dtype=np.int64)
    padding = np.zeros(width - 1, dtype=np.uint32)
    highest = sliding(np.concatenate([padding, lowest, padding]), width, np.maximum)
    return np.flatnonzero((ranks == highest) & (highest > 0))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copy_mark) of rows whose text is also that of a smaller doc_id; each once. The mark is that of the text."""
    marked = docs.where("doc_id is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.xxhash64("text").alias("copy_mark"))
    first = marked.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    again = marked.join(first.where("rows > 1"), "text_hash").where("doc_id > first_id")
    return again.select("doc_id", "copy_mark").distinct()


def repeated_windows(
    docs: DataFrame,
    known: DataFrame,
    words: bool,
    window: int,
    gram: int,
    emit: Callable[[pd.DataFrame, Block, np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """What ``emit`` returns for every block of ``docs`` (doc_id, text).

    Rows without doc_id and those of ``known``, the copies, are left out.
    emit(rows in order with doc_id and text_key, block, lowest rank of each window, whether its anchor repeats). Rows that
    repeat are one here; texts that share an id are told apart by text_key.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, 2 * size // ((window - gram + 2) * (6 if words else 1)))
    buckets = expected // BUCKET_ANCHORS + 1
    digest_bytes = min(8, math.ceil((math.log2(expected) + SPARE_BITS) / 8))
    width = window - gram + 1
    blocks = size // BLOCK_BYTES + 1
    dealt = docs.where("doc_id is not null").select("doc_id", "text")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    known = known.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def opened(frame: pd.DataFrame, known_rows: pd.DataFrame):
        copied = set(zip(known_rows["doc_id"].tolist(), known_rows["copy_mark"].tolist(), strict=True))
        maybe = frame["doc_id"].isin(known_rows["doc_id"]).to_numpy(dtype=bool)
        for at in np.flatnonzero(maybe):
            maybe[at] = (int(frame["doc_id"].iloc[at]), copy_mark(text_bytes(frame["text"].iloc[at]))) in copied
        frame = frame[~maybe]
        frame = frame.drop_duplicates(["doc_id", "text"]).sort_values(["doc_id", "text"], kind="stable")
        texts = [text_bytes(text) for text in frame["text"]]
        block = Block(texts, words)
        ranks, lowest = anchors(block, window, gram)
        places = chosen_anchors(ranks, lowest, width)
        digests = mixed(block.hashes(gram, places)) >> np.uint64(64 - 8 * digest_bytes)
        rows = pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "text_key": [text_key(text) for text in texts]})
        return rows, block, ranks, lowest, places, digests

    def send(frame: pd.DataFrame, known_rows: pd.DataFrame) -> pd.DataFrame:
        digests = distinct(opened(frame, known_rows)[-1])
        bucket = ((digests >> np.uint64(max(0, 8 * digest_bytes - 32))).astype(np.int64) * buckets) >> 32
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        packed = np.ascontiguousarray(digests.view(np.uint8).reshape(-1, 8)[:, :digest_bytes])
        used = np.flatnonzero(np.diff(edges))
        return pd.DataFrame(
            {
                "block": frame["block"].iloc[0] if len(frame) else 0,
                "bucket": used,
                "digests": [packed[edges[at] : edges[at + 1]].tobytes() for at in used],
            }
        )

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(each) // digest_bytes for each in frame["digests"]]
        packed = np.frombuffer(b"".join(frame["digests"]), dtype=np.uint8).reshape(-1, digest_bytes)
        digests = np.zeros((len(packed), 8), dtype=np.uint8)
        digests[:, :digest_bytes] = packed
        digests = digests.view(np.uint64).ravel()
        order = np.argsort(digests)
        same = digests[order][1:] == digests[order][:-1]
        repeated = np.zeros(len(digests), dtype=bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        bits = [np.packbits(part).tobytes() for part in np.split(repeated, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "size": sizes, "bits": bits})

    def receive(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known_rows = answers[answers["bucket"] == COPIES][["known", "copy_mark"]].rename(columns={"known": "doc_id"})
        answers = answers[answers["bucket"] != COPIES]
        rows, block, ranks, lowest, places, digests = opened(frame, known_rows)
        found, back = np.unique(digests, return_inverse=True)
        # What one text alone repeats is no repeat: count texts, not places.
        pairs = distinct(back.astype(np.int64) * (len(rows) + 1) + block.text_of(places))
        counts = np.bincount(pairs // (len(rows) + 1), minlength=len(found))
        parts = [
            np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=size)
            for _, size, bits in sorted(zip(answers["bucket"], answers["size"], answers["bits"], strict=True))
        ]
        repeated = (counts > 1) | (np.concatenate(parts).astype(bool) if parts else np.zeros(len(counts), bool))
        at = places[repeated[back]]
        marked = np.full(len(ranks), np.uint32(2**32 - 1))
        marked[at] = ranks[at]
        nearest = sliding(marked, width, np.minimum)[: len(lowest)] if len(lowest) else lowest
        return emit(rows, block, lowest, (nearest == lowest) & (lowest > 0))

    by_block = dealt.groupBy("block")
    sent = by_block.cogroup(known.groupBy("block")).applyInPandas(send, "block long, bucket long, digests binary")
    answered = sent.groupBy("bucket").applyInPandas(answer, "block long, bucket long, size long, bits binary")
    nothing = F.lit(0).cast("long")
    replies = answered.withColumn("known", nothing).withColumn("copy_mark", nothing).unionByName(
        known.select(
            "block", F.lit(COPIES).cast("long").alias("bucket"), F.lit(0).cast("long").alias("size"),
            F.lit(b"").alias("bits"), F.col("doc_id").alias("known"), "copy_mark",
        )
    )
    return by_block.cogroup(replies.groupBy("block")).applyInPandas(receive, schema)
