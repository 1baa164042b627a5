"""The pipeline stage by stage against plain Python, and every registered query over the smallest tables."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.cases import frame, plain_bytes, rows, words
from tests.llm.test_groups import plain_fingerprint, smallest
from tests.llm.test_repeats import covered
from tests.llm.test_texts import check_places, plain_targets
from tickloom.llm.queries import ORACLES, QUERIES

GERMAN = str.maketrans("w", "ß")


def documents():
    made = [(at, words(at, 60 + at, 300), "en", f"s{at % 3}", 5) for at in range(40)]
    made += [(100 + at, words(at, 60 + at, 300).translate(GERMAN), "de" if at else "en", "s1", 5) for at in range(20)]
    shared = words(777, 70)
    made += [(200 + at, f"{words(300 + at, 40)} {shared} {words(400 + at, 30)}", "en", None, 5) for at in range(5)]
    made += [(300, made[7][1], "en", "s1", 5), (301, made[9][1] + " more", "en", "s2", 5), (302, shared, "en", "s2", 5)]
    made += [(303, "𐍈𐍇𐍆" * 400, None, "s0", 5), made[3], (None, made[5][1], "en", "s0", 5)]
    return made


def table(found):
    return sorted((tuple(row) for row in found.collect()), key=repr)


def test_stages(spark):
    docs = frame(spark, documents())
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    found = stages["language_id"](spark, docs, "")
    lang = {row[0]: "de" if row[0] is not None and 100 <= row[0] < 120 else "en" for row in documents()}
    wanted = [(*row[:2], lang[row[0]], *row[3:]) for row in documents() if row[0] != 303]
    assert found.columns == list(corpus_pipeline.COLUMNS) and table(found) == sorted(wanted, key=repr)

    kept, wanted = stages["simhash_near_dedup"](spark, found, ""), {}
    marks = {row[0]: plain_fingerprint(row[1]) for row in table(found) if row[0] is not None}
    links = [(a, b) for a in marks for b in marks if (marks[a] ^ marks[b]).bit_count() <= 2]
    group = smallest(marks, links)
    # The row without an id is a copy of one with an id.
    wanted = sorted({row for row in table(found) if row[0] is not None and group[row[0]] == row[0]}, key=repr)
    assert table(kept) == wanted and len(wanted) < len(marks)

    cut, given = stages["substring_dedup"](spark, kept, ""), table(kept)
    units = [plain_bytes(row[1]).split() for row in given]
    wanted = []
    for row, text, gone in zip(given, units, covered(units, [row[0] for row in given], 50), strict=True):
        left = b" ".join(word for word, hit in zip(text, gone, strict=True) if not hit).decode()
        if any(gone) and left:
            wanted.append((row[0], left, row[2], row[3], len(left)))
        elif not any(gone):
            wanted.append(row)
    assert table(cut) == sorted(wanted, key=repr) and wanted != given

    mixed, before = stages["source_mixing"](spark, cut, ""), table(cut)
    times, sizes, taken = Counter(table(mixed)), Counter(), Counter()
    assert set(times) <= set(before) and max(times.values()) <= 3
    for row in before:
        sizes[row[3]] += len(row[1].split())
        taken[row[3]] += len(row[1].split()) * times[row]
    for source, target in plain_targets(sizes, (1, 2, 3), 3).items():
        assert abs(taken[source] - target) <= 0.03 * target + 3

    packed = stages["best_fit_packing"](spark, mixed, "").collect()
    assert Counter(row["doc_id"] for row in packed) == Counter(row[0] for row in times.elements())
    check_places([(row["sequence_id"], row["offset"], row["length"]) for row in packed], 4096)


def test_a_row_stands_for_itself_and_not_for_its_id(spark):
    """Of an id with a copy and a text of its own the copy goes, and rows without an id stay if nothing equals them."""
    one, two, three, four = (words(500 + at, 70, 3000) for at in range(4))
    docs = [(1, one, "en", "s0", 5), (2, one, "en", "s0", 5), (2, two, "en", "s0", 5), (None, three, "en", "s1", 5), (None, four, "en", "s1", 5)]
    docs += [(None, three, "en", "s1", 5), (None, two, "en", "s1", 5)]
    stages = dict(corpus_pipeline.STAGES)
    assert len(table(stages["language_id"](spark, frame(spark, docs), ""))) == len(docs)
    kept = stages["simhash_near_dedup"](spark, frame(spark, docs), "")
    assert table(kept) == sorted([docs[0], docs[2], docs[3], docs[4]], key=repr)
    mixed = Counter(table(stages["source_mixing"](spark, frame(spark, docs + [docs[0]]), "")))
    taken = {row: times for row, times in mixed.items()}
    assert set(taken) <= set(docs) and taken[docs[0]] <= 6 and sum(times for row, times in taken.items() if row[3] == "s1") >= 4


def test_stages_without_documents(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_stages_take_nulls_and_ties(spark):
    docs = frame(spark, rows())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() > 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found)
    if name not in ORACLES:
        return
    database = duckdb.connect()
    for table_name in os.listdir(sf_dir):
        database.execute(f"create view {table_name[:-8]} as select * from '{sf_dir}/{table_name}'")
    wanted = database.execute(ORACLES[name]).df()[found.columns.tolist()]
    order = found.columns.tolist()
    one, two = (part.sort_values(order, ignore_index=True) for part in (found, wanted))
    assert all(np.array_equal(one[column], two[column]) for column in order)


def test_pipeline(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
