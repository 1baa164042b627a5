"""Best-fit packing planned on a histogram of lengths.

Documents become token ids; only those longer than a sequence are cut. The plan is best fit, longest first, over the
counts of each length: all pieces of a length that go to equally full sequences are one step, so its size follows the
number of lengths (4096 at most) and not the number of documents. Pieces then take planned places by joining on their
rank within their length.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import anonymous, identified, staged, text_bytes

CAPACITY = 4096
END_ID = 1
ID_BYTES = 4
CACHED_WORDS = 600_000  # words that a worker remembers, the first it meets; they are the frequent ones
CACHED_WORD_BYTES = 64
SPECIAL = b"<|"  # how the tokenizer's special tokens begin
RANKED_TOGETHER = 200_000  # pieces of a length that one task puts in order


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokens(dict):
    """Ids of words as bytes; a text's ids are those of its words, one after another.

    The tokenizer ignores case and white space and never joins what stands on both sides of white space. Words met
    before are not tokenized again, up to CACHED_WORDS of them. Words of Latin letters are one piece to the tokenizer,
    so its model alone is asked; a full stop or comma behind a letter is a piece of its own.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = (chr(code) for code in range(256) if chr(code).isalpha())
        self.letters = {ord(letter): written.pre_tokenize_str(letter)[0][0] for letter in letters}

    def __missing__(self, word: bytes) -> bytes:
        if word[-1:] in (b".", b",") and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1:]]
        elif word.isalpha():
            ids = pack_ids([token.id for token in self.model.tokenize(word.decode())])
        else:
            text = word.decode("utf-8", "replace").lower()
            if text.isalpha() and max(text) < "\u0100":
                ids = pack_ids([token.id for token in self.model.tokenize(text.translate(self.letters))])
            else:
                ids = pack_ids(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(word) <= CACHED_WORD_BYTES and len(self) < CACHED_WORDS:
            self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        if SPECIAL not in text:
            return b"".join(map(self.__getitem__, text.lower().split()))
        # Special tokens are found in their own spelling only, before case is dropped.
        words = [word if SPECIAL in word else word.lower() for word in text.split()]
        return b"".join(map(self.__getitem__, words))


TOKENIZERS: dict[str, WordTokens] = {}  # one in each worker process


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row; null texts count as empty: the end id alone."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = tokenizer_path(tokenizer)
        if path not in TOKENIZERS:
            TOKENIZERS[path] = WordTokens(path)
        end, span = END_ID.to_bytes(ID_BYTES, "little"), capacity * ID_BYTES
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = TOKENIZERS[path].of(text_bytes(text)) + end
                for piece, at in enumerate(range(0, len(ids), span)):
                    part = ids[at : at + span]
                    row = (doc_id, piece, at // ID_BYTES, len(part) // ID_BYTES, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return anonymous(identified(docs).mapInPandas(pieces, schema))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, rank after the last, pieces per sequence, first sequence, offset).

    Best fit, longest first: a piece goes to the fullest sequence that has room, and to a new one if none has.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free places -> runs of sequences (first, how many)
    sizes: list[int] = []
    steps, sequences = [], 0

    def free(places: int, first: int, number: int) -> None:
        if places:
            if places not in room:
                room[places] = []
                insort(sizes, places)
            room[places].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            places = sizes[at] if at < len(sizes) else capacity
            each = min(places // length, left)
            used = left // each
            if at < len(sizes):
                first, number = room[places].pop()
                used = min(used, number)
                if not room[places]:
                    del room[places]
                    sizes.pop(at)
                if used < number:
                    free(places, first + used, number - used)
            else:
                first, sequences = sequences, sequences + used
            steps.append((length, rank, rank + used * each, each, first, capacity - places))
            free(places - each * length, first, used)
            rank, left = rank + used * each, left - used * each
    return steps


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length. ``pieces`` must be stored: it is read twice.

    Ranks are counted per length and share of the ids, so that no task orders all pieces of a common length; the number
    of shares grows with the table.
    """
    spark = pieces.sparkSession
    shares = pieces.count() // RANKED_TOGETHER + 1
    shared = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)))
    counted = shared.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    histogram = {row["length"]: row["n"] for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = spark.createDataFrame(
        plan(histogram, capacity),
        "at_length long, first_rank long, end_rank long, each long, first_sequence long, first_offset long",
    )
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "share", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", *(["ids_crc32"] if "ids_crc32" in pieces.columns else []))
    ranked = shared.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    matches = (
        (F.col("length") == F.col("at_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("end_rank"))
    )
    place = F.col("rank") - F.col("first_rank")
    return ranked.join(steps, matches).select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + place % F.col("each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) with their places.

    No rows, no sequences. Null and empty texts are one piece of length one. Rows that repeat are packed as often as
    they come. Other columns are ignored.
    """
    return pack(staged(tokenize(docs, tokenizer, capacity), "pieces"), capacity)


def pack_query(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
