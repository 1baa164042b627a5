"""SimHash near-duplicates found with pivot distance tables.

Every distinct fingerprint gets a table of Hamming distances to reference fingerprints, the pivots. Two fingerprints
within d bits differ by d at most in each column of the table, and by d at most in the sum of what a set of disjoint
pivots sees. Pairs are told apart by the table first and compared bit by bit last.

So that not all pairs meet, fingerprints are dealt by pivots too. The distances to the prefixes 0, 1, 11, 111, ... of
the bits fix the bits themselves: where two fingerprints have equal steps between the columns of a stretch, they agree
on that stretch. With d + 1 stretches, fingerprints within d bits agree on one at least. Within a bucket of equal
stretches a task sorts by one column, looks no further than d along it, and discards by the greatest difference in the
others. Buckets in which that still leaves too much to compare use the flips of up to d bits instead; both ways are exact.
A lot of buckets returns a forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import anonymous, identified, staged, text_bytes
from tickloom.llm.components import components, forest

BITS = 64
HASH_SEED = 42
PIVOTS = 32
PIVOT_SEED = 8
FLIPPED_FROM = 5000  # members of a bucket from which flipping bits is cheaper than walking along the table
BLOCK = 1 << 20  # pairs looked at together
LOT_ROWS = 10_000  # entries in buckets that a task takes at a time; a bucket is never split


def fingerprint(text: bytes, shingle_words: int) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxh64_intdigest(b" ".join(words), HASH_SEED)
    parts = zip(*[words[at:] for at in range(shingle_words)], strict=False)
    hashes = np.array([xxh64_intdigest(s, HASH_SEED) for s in map(b" ".join, parts)], dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint long with the bits of the unsigned value, and the texts of ``carry``) of every row."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [fingerprint(text_bytes(text), shingle_words) for text in batch["text"]]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": signed, **{name: batch[name] for name in carry}})

    schema = ", ".join(["doc_id long", "fingerprint long", *[f"{name} string" for name in carry]])
    return anonymous(identified(docs, *carry).mapInPandas(of, schema))


def pivots(number: int = PIVOTS, seed: int = PIVOT_SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, number, dtype=np.uint64)


def stretches(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of max_bits + 1 stretches that cover all bits."""
    edges = np.linspace(0, BITS, max_bits + 2).round().astype(int)
    return [(int(low), int(high - low)) for low, high in zip(edges, edges[1:], strict=False)]


def close_pairs(values: np.ndarray, max_bits: int, references: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in sorted distinct ``values`` (unsigned) within max_bits of each other, in blocks."""
    count = len(values)
    if count >= FLIPPED_FROM:
        varying = int(np.bitwise_or.reduce(values ^ values[0]))
        differing = [bit for bit in range(BITS) if varying >> bit & 1]  # a bucket's stretch is the same in all
        for number in range(1, max_bits + 1):
            for bits in combinations(differing, number):
                flipped = values ^ np.uint64(sum(1 << bit for bit in bits))
                at = np.searchsorted(values, flipped)
                at[at == count] = 0
                found = np.flatnonzero((values[at] == flipped) & (flipped > values))
                if len(found):
                    yield found, at[found]
        return
    table = np.bitwise_count(values[:, None] ^ references[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    column, rest, sorted_values = table[order, 0], table[order, 1:], values[order]
    ends = np.searchsorted(column, column + max_bits, side="right")
    lengths = ends - np.arange(1, count + 1)
    first = 0
    while first < count:
        last = first + max(1, int(np.searchsorted(np.cumsum(lengths[first:]), BLOCK, side="right")))
        lot = lengths[first:last]
        left = np.repeat(np.arange(first, min(last, count)), lot)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(lot) - lot, lot)
        for near in range(rest.shape[1]):  # a column at a time: most pairs are gone after the first few
            kept = np.abs(rest[left, near] - rest[right, near]) <= max_bits
            left, right = left[kept], right[kept]
        kept = np.bitwise_count(sorted_values[left] ^ sorted_values[right]) <= max_bits
        if kept.any():
            yield order[left[kept]], order[right[kept]]
        first = last


def fingerprint_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) with the components of all fingerprints (column fingerprint, no repeats) within max_bits."""
    keys = [
        F.struct(F.lit(at).alias("stretch"), _bits(F.col("fingerprint"), low, number).alias("bits"))
        for at, (low, number) in enumerate(stretches(max_bits))
    ]
    dealt = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key")).select("fingerprint", "key.*")
    lots = distinct.count() * len(keys) // LOT_ROWS + 1
    dealt = dealt.withColumn("lot", F.pmod(F.xxhash64("stretch", "bits"), F.lit(lots)))
    references = pivots()

    def linked(lot: pd.DataFrame) -> pd.DataFrame:
        values = lot["fingerprint"].to_numpy(np.int64).view(np.uint64)
        stretch, bits = lot["stretch"].to_numpy(np.int64), lot["bits"].to_numpy(np.int64)
        order = np.lexsort((values, bits, stretch))
        values, stretch, bits = values[order], stretch[order], bits[order]
        first = np.flatnonzero(np.concatenate([[True], (bits[1:] != bits[:-1]) | (stretch[1:] != stretch[:-1])]))
        last = np.append(first[1:], len(values))
        pairs = [np.empty((0, 2), dtype=np.uint64)]
        for low, high in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
            bucket = values[low:high]
            pairs += [np.stack([bucket[i], bucket[j]], axis=1) for i, j in close_pairs(bucket, max_bits, references)]
        names, places = np.unique(np.concatenate(pairs), return_inverse=True)
        members, roots = forest(len(names), *places.reshape(-1, 2).T)
        signed = names.view(np.int64)
        return pd.DataFrame({"a": signed[members], "b": signed[roots]})

    return dealt.groupBy("lot").applyInPandas(linked, "a long, b long").distinct()


def _bits(value, low: int, number: int):
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << number) - 1))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint long, component_id, component) of every row, and the texts of ``carry``.

    ``component_id`` is the smallest doc_id reachable by links; ``component``, a fingerprint, names the group even if
    none of its rows has an id.

    Null and empty texts have the fingerprint zero and link with each other like any other; rows that repeat get equal
    results; a null doc_id never names a component unless nothing else is in it. Other columns are ignored.
    """
    marked = staged(fingerprints(docs, shingle_words, carry), "fingerprints")
    classes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    classes = staged(classes, "fingerprint-classes")
    found = components(fingerprint_links(classes.select("fingerprint"), max_bits))
    grouped = classes.join(found, classes["fingerprint"] == found["node"], "left")
    grouped = grouped.select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(smallest, "component").select("fingerprint", "component_id", "component")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id", "component", *carry)


def simhash_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
