"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping, and how often token ids end together.

Every token points to its farthest-right overlapping token of the other tokenizer. Doubling these pointers leads all
tokens of a group, the bytes between two offsets where tokens of both end, to the group's last token, which labels it.

Neither tokenizer joins bytes across a single space between two words, so a text's groups are those of its words one
after the other, and a word met before need not be aligned again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import anonymous, identified, staged
from tickloom.llm.packing import tokenizer_path

# Documents are put together to blocks of about so many characters, within which pairs of ids are counted first.
BLOCK_CHARACTERS = 8 << 20
# A worker remembers so many words, and so many characters of them, before it starts anew.
WORDS_KEPT, CHARACTERS_KEPT = 500_000, 64 << 20

# Fixed value: how the byte-level tokenizer cuts text before it merges bytes.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Where a space has white space beside it, or an end of the text, the cut is looked for with care.
UNEVEN = re.compile(r"\s | \s|^ | $")
EVEN_SPACE = re.compile(r"(?<=\S) (?=\S)")

STAGED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, "
    "pairs array<long>, counts array<long>, sizes binary, links binary"
)


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the rest
    follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + at): byte for at, byte in enumerate(others)}


class ByteTokenizer:
    """A byte-level BPE vocabulary in JSON. ``entries`` has the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {token["content"] for token in described.get("added_tokens", [])}
        letters, vocabulary = byte_of_letter(), described["model"]["vocab"]
        self.entries = [b""] * (1 + max([*vocabulary.values(), *[token["id"] for token in described.get("added_tokens", [])]]))
        ranks = {}
        for entry, number in vocabulary.items():
            if entry not in special:
                self.entries[number] = bytes(letters[letter] for letter in entry)
                ranks[self.entries[number]] = number
        merges = [merge if isinstance(merge, list) else merge.split(" ") for merge in described["model"]["merges"]]
        made = [vocabulary["".join(merge)] for merge in merges]
        cut = described.get("pre_tokenizer") or {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if usual and not described.get("normalizer") and made == sorted(made) and len(set(made)) == len(made):
            import tiktoken  # merges by rank, and the ranks are the ids here

            own = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._one = own.encode_ordinary
        else:
            self._one = None
        self._path, self._whole = path, None

    def _by_whole_tokenizer(self, texts: Sequence[str]) -> list[list[int]]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
            self._whole.encode_special_tokens = True
        return [found.ids for found in self._whole.encode_batch(texts, add_special_tokens=False)]

    def _careful(self, text: str) -> list[int]:
        try:
            return self._one(text)
        except BaseException as error:  # white space without end overflows the stack that cuts the text, as a panic
            if type(error).__name__ not in ("PanicException", "ValueError"):
                raise
            return self._by_whole_tokenizer([text])[0]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self._by_whole_tokenizer(texts) if self._one is None else [self._careful(text) for text in texts]


class PieceTokenizer:
    """A sentence-piece model, which puts a space in front of what it encodes. ``entries`` has the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(number) for number in range(self._model.get_piece_size())]
        self.entries = [
            bytes([int(piece[1:-1], 16)]) if self._model.is_byte(number) else piece.replace("▁", " ").encode()
            for number, piece in enumerate(pieces)
        ]
        # Words can be looked up one by one if no piece goes on over a space.
        self.by_word = not any(re.search("[^▁]▁", piece) for piece in pieces)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self._model.encode(list(texts), num_threads=1)


def words_of(text: str) -> list[str]:
    """The text cut at single spaces that have no white space beside them; the spaces are left out."""
    return EVEN_SPACE.split(text) if UNEVEN.search(text) else text.split(" ")


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, last B token of each group), from the offsets where tokens end.

    The last token of one tokenizer that overlaps a token is the one that holds its last byte. A token of A that ends
    where a token of B does points to itself; all others point on, and the pointers are doubled until none moves.
    """
    n_a = len(ends_a)
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    own = np.arange(n_a)
    points = np.concatenate([np.where(ends_b[over_a] == ends_a, own, n_a + over_a), over_b]) if n_a else own
    while not np.array_equal(further := points[points], points):
        points = further
    last = np.flatnonzero(points[:n_a] == own)
    number = np.zeros(n_a, np.int64)
    number[last] = np.arange(len(last))
    return number[points[:n_a]], number[points[n_a:]], over_a[last]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Index(dict):
    """Numbers words in the order of their first lookup."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Lexicon:
    """Words that were aligned: sizes, the group text, and links as pairs of ids, each word's after the other's."""

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer):
        self._a, self._b = a, b
        self._lengths = [np.array([len(entry) for entry in tokenizer.entries]) for tokenizer in (a, b)]
        self._digits = [self._rows_of_digits(len(tokenizer.entries)) for tokenizer in (a, b)]
        self.clear()

    def clear(self) -> None:
        self.index, self.shown = Index(), []
        self.sizes = np.zeros((0, 3), np.int64)  # tokens of A, tokens of B, groups
        self.bad = np.zeros(0, bool)
        self.links, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.characters = 0

    @staticmethod
    def _rows_of_digits(number: int) -> np.ndarray:
        """Each id in decimal, as a row of bytes with zero bytes behind, and room for what follows it."""
        width = len(str(number)) + 1
        return np.array([str(at) for at in range(number)], f"S{width}").view(np.uint8).reshape(number, width)

    def learn(self) -> None:
        """Align the words that were looked up and are not known yet."""
        words, self.index.new = self.index.new, []
        if not words:
            return
        self.characters += sum(map(len, words))
        ids = self._a.encode([f" {word}" for word in words]), self._b.encode(words)
        raw = [f" {word}".encode() for word in words]
        self.bad = np.concatenate([self.bad, self._wrong(raw, ids)])
        good = ~self.bad[-len(words) :]
        counts = [np.array([len(one) for one in own]) * good for own in ids]
        flat = [np.fromiter((x for one, fine in zip(own, good) if fine for x in one), np.int64) for own in ids]
        ends = [np.cumsum(lengths[own]) for lengths, own in zip(self._lengths, flat)]
        group_a, group_b, last_b = groups_of(*ends)
        word_a = np.repeat(np.arange(len(words)), counts[0])
        last_a = np.flatnonzero(np.append(np.diff(group_a), 1)) if len(group_a) else np.zeros(0, np.int64)
        groups = np.bincount(word_a[last_a], minlength=len(words))
        pairs = flat[0][last_a] << 32 | flat[1][last_b]
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(groups) - groups])
        self.links = np.concatenate([self.links, pairs])
        self.sizes = np.concatenate([self.sizes, np.stack([*counts, groups], axis=1)])
        self.shown += self._show(flat, (group_a, group_b), counts, groups)

    def _wrong(self, raw: list[bytes], ids: tuple[list[list[int]], list[list[int]]]) -> np.ndarray:
        """Words whose tokens do not have the word's bytes, or that one of the tokenizers has no tokens for."""
        wrong = np.zeros(len(raw), bool)
        for tokenizer, own in zip((self._a, self._b), ids):
            entry = tokenizer.entries.__getitem__
            wrong |= np.array([b"".join(map(entry, one)) != word for one, word in zip(own, raw)])
        return wrong

    def _show(self, flat, group, counts, groups) -> list[bytes]:
        """Group text of each word: ids of A, then of B, commas between them, and semicolons between groups."""
        width = max(rows.shape[1] for rows in self._digits)
        total = int(groups.sum())
        per_group = [np.bincount(own, minlength=total) for own in group]
        before = [np.cumsum(own) - own for own in per_group]
        rows = np.zeros((len(flat[0]) + len(flat[1]), width), np.uint8)
        of_word = np.repeat(np.arange(len(groups)), groups)
        ends_word = np.append(np.diff(of_word), 1) != 0 if total else np.zeros(0, bool)
        # A group's ids of A come behind all ids of B of earlier groups, and its ids of B behind its ids of A.
        places = [np.arange(len(flat[0])) + before[1][group[0]], np.arange(len(flat[1])) + (before[0] + per_group[0])[group[1]]]
        for at, (place, own, digits) in enumerate(zip(places, flat, self._digits)):
            if not len(own):
                continue
            shown = digits[own]
            ends = np.append(np.diff(group[at]), 1) != 0
            behind = np.full(len(own), ord(","), np.uint8)
            behind[ends] = ord("|") if at == 0 else np.where(ends_word, 0, ord(";"))
            shown[:, -1] = behind
            rows[place, width - shown.shape[1] :] = shown
        used = (rows != 0).sum(axis=1)
        text = rows[rows != 0].tobytes()
        tokens = counts[0] + counts[1]
        bytes_before = np.concatenate([[0], np.cumsum(used)])
        stops = bytes_before[np.cumsum(tokens)]
        return [text[start:stop] for start, stop in zip([0, *stops[:-1].tolist()], stops.tolist())]


class Block:
    """Documents that are counted together."""

    def __init__(self, lexicon: Lexicon, by_word: bool):
        self._lexicon, self._by_word = lexicon, by_word
        self.characters, self._ids, self._codes, self._texts = 0, [], [], []

    def add(self, doc_id: int, text: str | None) -> None:
        text = text or ""
        words = (words_of(text) if self._by_word else [text]) if text else []
        self._ids.append(doc_id)
        self._texts.append(text)
        self._codes.append(np.fromiter(map(self._lexicon.index.__getitem__, words), np.int64, len(words)))
        self.characters += len(text)

    def rows(self, number: int) -> Iterator[pd.DataFrame]:
        """The documents of the block, and a row for the block itself."""
        lexicon = self._lexicon
        lexicon.learn()
        # A text with a word that either tokenizer changes is looked at as a whole; if that changes it, it has no tokens.
        odd = [at for at, codes in enumerate(self._codes) if lexicon.bad[codes].any()]
        for at in odd:
            self._codes[at] = np.array([lexicon.index[self._texts[at]]])
        lexicon.learn()
        for at in odd:
            if lexicon.bad[self._codes[at]].any():
                self._codes[at] = np.zeros(0, np.int64)
        lengths = np.array([len(codes) for codes in self._codes])
        codes = np.concatenate(self._codes)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sums = [np.bincount(owner, lexicon.sizes[codes, part], len(lengths)).astype(np.int64) for part in range(3)]
        shown = lexicon.shown.__getitem__
        digests = [hashlib.sha256(b";".join(map(shown, own.tolist()))).hexdigest() if len(own) else "" for own in self._codes]

        # Words by number of occurrences, so that most numbers are small and pack well.
        used = np.bincount(codes, minlength=len(lexicon.bad))
        local = np.argsort(-used, kind="stable")[: np.count_nonzero(used)]
        place = np.zeros(len(used), np.int32)
        place[local] = np.arange(len(local))
        sizes = lexicon.sizes[local, 2]
        pairs, links = np.unique(lexicon.links[ragged(lexicon.starts[local], sizes)], return_inverse=True)
        counts = np.bincount(links, np.repeat(used[local], sizes), len(pairs)).astype(np.int64)
        yield pd.DataFrame(
            {
                "block": number, "doc_id": self._ids, "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[2],
                "groups_sha256": digests, "words": [packed(place[own]) for own in self._codes],
                "pairs": None, "counts": None, "sizes": None, "links": None,
            }
        )
        if len(pairs):
            numbers = dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links"), [0])  # no nulls among whole numbers
            lists = {"pairs": [pairs], "counts": [counts], "sizes": [packed(sizes)], "links": [packed(links)]}
            yield pd.DataFrame({"block": [number], **numbers, "groups_sha256": [None], "words": [None], **lists})


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in 32 bits each, compressed, with their number in front."""
    raw = numbers.astype("<i4").tobytes()
    return len(numbers).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(stored: bytes) -> np.ndarray:
    number = int.from_bytes(stored[:8], "little")
    return np.frombuffer(pa.decompress(stored[8:], 4 * number, "zstd", asbytes=True), "<i4") if number else np.zeros(0, np.int32)


LEXICONS: dict[tuple[str, str], tuple[Lexicon, bool]] = {}


def lexicon_of(path_a: str, path_b: str) -> tuple[Lexicon, bool]:
    """The worker's lexicon. A name that is no path here is one of the public vocabularies, wherever they lie."""
    names = (path_a, path_b)
    if names not in LEXICONS:
        path_a, path_b = [path if os.path.exists(path) else tokenizer_path(path) for path in (path_a, path_b)]
        LEXICONS.clear()
        pieces = PieceTokenizer(path_b)
        LEXICONS[names] = Lexicon(ByteTokenizer(path_a), pieces), pieces.by_word
    return LEXICONS[names]


def align_blocks(docs: DataFrame, path_a: str, path_b: str, block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """Documents with their groups, and blocks of them with the pairs of ids that end together in each."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, by_word = lexicon_of(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        block = Block(lexicon, by_word)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                block.add(doc_id, text)
                if block.characters >= block_characters:
                    yield from block.rows(number)
                    if len(lexicon.index) > WORDS_KEPT or lexicon.characters > CHARACTERS_KEPT:
                        lexicon.clear()
                    number, block = number + 1, Block(lexicon, by_word)
        if block._ids:
            yield from block.rows(number)

    return identified(docs).mapInPandas(of, STAGED)


def link_totals(blocks: DataFrame) -> DataFrame:
    """(of_block, place, total, best) of the pairs of each block; the total is that of all blocks."""
    entries = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "entry"))
    entries = entries.select("block", "place", F.col("entry.pairs").alias("pair"), F.col("entry.counts").alias("n"))
    totals = staged(entries.groupBy("pair").agg(F.sum("n").alias("total")), "link-totals")
    of_b = F.col("pair").bitwiseAND((1 << 32) - 1)
    # One row per id of B, as many as its vocabulary has: small whatever the corpus.
    top = totals.groupBy(of_b.alias("b")).agg(F.max("total").alias("top"))
    judged = totals.join(F.broadcast(top), of_b == F.col("b")).select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    return entries.join(judged, "pair").select(F.col("block").alias("of_block"), "place", "total", "best")


def align_tokens(docs: DataFrame, path_a: str, path_b: str, block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """How the tokens of two tokenizers line up over each text.

    ``path_a`` names a byte-level BPE vocabulary in JSON, which encodes a space and the text, and ``path_b`` a
    sentence-piece model, which adds the space itself. Special tokens' strings are plain text. Returns doc_id, n_a, n_b,
    n_groups, n_links, n_best, count_sum and groups_sha256. A link is a token of A and one of B that end at the same
    byte; its count is how many links of all documents have these two ids; it is a best one if no other id of A has a
    higher count with its id of B, so ties are all best.

    Texts that are null or empty, or whose tokens' bytes are not those of the space and the text, have no tokens: zeros
    and an empty digest. Null ids stay null, repeated rows count as often as they come, an empty table gives no rows,
    and further columns are ignored. A text is encoded whole by one task, however long it is.
    """
    blocks = staged(align_blocks(docs, path_a, path_b, block_characters), "token-blocks")
    totals = link_totals(blocks)

    def finish(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        docs = rows[rows["words"].notna()].reset_index(drop=True)
        block = rows[rows["words"].isna()]
        codes = [unpacked(words) for words in docs["words"]]
        owner = np.repeat(np.arange(len(docs)), [len(own) for own in codes])
        sums = np.zeros((2, len(docs)), np.int64)
        if len(block):
            found = found.sort_values("place")
            sizes, links = unpacked(block["sizes"].iloc[0]), unpacked(block["links"].iloc[0])
            word = np.repeat(np.arange(len(sizes)), sizes)
            words = np.concatenate(codes)
            for at, value in enumerate((found["best"], found["total"])):
                of_word = np.zeros(len(sizes), np.int64)
                np.add.at(of_word, word, value.to_numpy(np.int64)[links])
                np.add.at(sums[at], owner, of_word[words])
        columns = {name: docs[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pd.DataFrame(columns | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs["groups_sha256"]})

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return anonymous(blocks.groupBy("block").cogroup(totals.groupBy("of_block")).applyInPandas(finish, schema))


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level vocabulary against the sentence-piece one, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokens(docs, "byte_bpe_50k.json", "piece_bpe_32k.model")
