"""Substring dedup on words and on bytes against brute force, and the order of suffixes against sorting."""

import random
import re
from hashlib import sha256

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import frame, of, plain_bytes, rows, words
from tickloom.llm import passages, suffixes
from tickloom.llm.anchors import Block, distinct, sliding


def covered(units, ids, window):
    """For each text the units that a window covers which starts in a smaller id too."""
    first = {}
    for doc_id, text in zip(ids, units, strict=True):
        for at in range(len(text) - window + 1 if doc_id is not None else 0):
            key = tuple(text[at : at + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    found = []
    for doc_id, text in zip(ids, units, strict=True):
        gone = [False] * len(text)
        for at in range(len(text) - window + 1 if doc_id is not None else 0):
            if first[tuple(text[at : at + window])] < doc_id:
                gone[at : at + window] = [True] * window
        found.append(gone)
    return found


def by_words(given, window):
    ids, units = [row[0] for row in given], [plain_bytes(row[1]).split() for row in given]
    for doc_id, text, gone in zip(ids, units, covered(units, ids, window), strict=True):
        kept = [word for word, hit in zip(text, gone, strict=True) if not hit]
        yield doc_id, len(text), len(text) - len(kept), sha256(b" ".join(kept)).hexdigest()


def by_bytes(given, window):
    ids, units = [row[0] for row in given], [plain_bytes(row[1]) for row in given]
    for doc_id, text, gone in zip(ids, units, covered(units, ids, window), strict=True):
        kept = bytes(byte for byte, hit in zip(text, gone, strict=True) if not hit)
        runs = len(re.findall("1+", "".join("01"[hit] for hit in gone)))
        yield doc_id, len(text), len(text) - len(kept), runs, sha256(kept).hexdigest()


def test_words(spark):
    found = of(passages.remove_repeats(frame(spark)))
    assert found == sorted(by_words(rows(), 50), key=repr)
    assert sum(row[2] for row in found) > 500


def one_id_with_two_texts():
    copied, own = words(20, 90), words(21, 90)
    texts = [(1, copied), (2, copied), (2, own), (2, None), (3, f"{words(22, 20)} {own}"), (3, copied), (4, words(23, 60))]
    return [(doc_id, text, None, None, None) for doc_id, text in texts]


def test_copies_are_rows_and_not_ids(spark):
    given = one_id_with_two_texts()
    found = of(passages.remove_repeats(frame(spark, given)))
    assert found == sorted(by_words(given, 50), key=repr) and (2, 90, 0) in {row[:3] for row in found}
    assert of(suffixes.remove_repeats(frame(spark, given))) == sorted(by_bytes(given, 50), key=repr)


def test_words_of_short_windows(spark):
    source = random.Random(5)
    given = [(at, " ".join(source.choice("abc") for _ in range(source.randrange(40))), None, None, None) for at in range(60)]
    found = of(passages.remove_repeats(frame(spark, given), window=6, gram=2))
    assert found == sorted(by_words(given, 6), key=repr)


def test_bytes(spark):
    found = of(suffixes.remove_repeats(frame(spark)))
    assert found == sorted(by_bytes(rows(), 50), key=repr)
    assert sum(row[2] for row in found) > 2000


def test_bytes_of_short_windows(spark):
    source = random.Random(6)
    given = [(at, "".join(source.choice("abé ") for _ in range(source.randrange(60))), None, None, None) for at in range(60)]
    found = of(suffixes.remove_repeats(frame(spark, given), window=12, gram=6))
    assert found == sorted(by_bytes(given, 12), key=repr)


def test_kept_text(spark):
    given = [(1, "a b c d e", None, None, None), (2, "x  b c d\ny", None, None, None)]
    assert of(passages.remove_repeats(frame(spark, given), 3, 2, True).select("doc_id", "kept")) == [(1, "a b c d e"), (2, "x y")]
    assert of(suffixes.remove_repeats(frame(spark, given), 5, 3, True).select("doc_id", "kept"))[1][1] in (b"x  \ny", b"x \ny")


def test_no_rows(spark):
    assert of(passages.remove_repeats(frame(spark, []))) == [] == of(suffixes.remove_repeats(frame(spark, [])))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=14).map(str.encode), min_size=1, max_size=12, unique=True))
def test_suffix_order(tmp_path_factory, strings):
    window = 4
    owners, starts, new = suffixes.ordered_windows(strings, window, str(tmp_path_factory.mktemp("columns")))
    assert owners.dtype == np.int64  # piece times length passes four bytes long before memory ends
    got = [strings[i][j:] for i, j in zip(owners, starts, strict=True)]
    wanted = sorted((i, j) for i, s in enumerate(strings) for j in range(len(s) - window + 1))
    assert sorted(zip(owners.tolist(), starts.tolist(), strict=True)) == wanted
    assert got == sorted(got)
    kinds = np.cumsum(new)
    for one, kind, two, other in zip(got, kinds, got[1:], kinds[1:], strict=False):
        assert (one[:window] == two[:window]) == (kind == other)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.integers(1, 9))
def test_sliding(values, width):
    values = np.array(values)
    wanted = [values[at : at + width].min() for at in range(len(values) - width + 1)]
    if len(values) >= width:
        assert sliding(values, width, np.minimum).tolist() == wanted


def test_block_hashes_tell_units_not_places():
    block = Block([b"a b  a\tb c", b"", b"x a b"], words=True)
    hashes = block.hashes(2)
    assert hashes[0] == hashes[2] == hashes[6] and len(set(hashes.tolist())) == 5
    assert block.inside(2).tolist() == [True, True, True, True, False, True, True]


def test_sources_are_placed_by_number_and_not_sorted(monkeypatch):
    rng = random.Random(11)
    text = bytes(rng.choice(b"abc\x00") for _ in range(400))
    given = sorted({text[at : at + rng.randrange(8, 15)] for at in range(0, 380, 3)})
    ids = [rng.randrange(40) for _ in given]
    monkeypatch.setattr(suffixes.np, "lexsort", None)
    found = suffixes.sources(pd.DataFrame({"piece": given, "piece_id": range(len(given)), "least_id": ids}), 8)
    least = {}
    for piece, own in zip(given, ids):
        for at in range(len(piece) - 7):
            least[piece[at : at + 8]] = min(own, least.get(piece[at : at + 8], own))
    spans = {(row.piece_id, at): row.source_id for row in found.itertuples() for at in range(row.low, row.high + 1)}
    assert spans == {(number, at): least[piece[at : at + 8]] for number, piece in enumerate(given) for at in range(len(piece) - 7)}


def test_columns_grow_by_what_has_begun(monkeypatch, tmp_path):
    """Strings begin in one column, so each adds its own length to the rounds, not that of the longest."""
    strings = [b"abcabcabcabd" * 5, *(b"%c%s" % (97 + at, b"bcabcab") for at in range(20))]
    wrote, write = [], suffixes.Column.write
    monkeypatch.setattr(suffixes.Column, "write", lambda self, values: (wrote.append(len(values)), write(self, values))[1])
    owners, starts, _ = suffixes.ordered_windows(strings, 6, str(tmp_path))
    assert len(set(zip(owners.tolist(), starts.tolist(), strict=True))) == len(owners) == sum(len(s) - 5 for s in strings)
    ends = len(strings) * (len(strings[0]) + 1)
    assert sum(wrote) == 2 * (ends + sum(len(s) * (len(s) + 1) // 2 for s in strings))


def test_distinct_values_are_those_of_numpy():
    for values in (np.array([], dtype=np.uint64), np.array([3, 1, 2**64 - 1, 3, 1], dtype=np.uint64)):
        assert distinct(values).tolist() == np.unique(values).tolist() and distinct(values).dtype == np.uint64
