"""The filter audit against brute force, with ids that arrive in any order and batches that are repeated."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tests.llm.cases import frame, of, words
from tickloom.llm.filter_audit import Audit, audit_filters, flags, report

LABELS = "doc_id long, quality int, toxic int, source string"


def failed(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = {
        "A": len(found) < 50, "B": 100 * len(set(found)) < 65 * len(found), "D": bool(re.search(r"[#$%&*|]", text)),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
    }
    return {letter for letter, does in fails.items() if does}


def plain(docs, labels):
    good = {doc_id for doc_id, quality, _, _ in labels if quality == 1 and doc_id is not None}
    toxic = {doc_id for doc_id, _, bad, _ in labels if bad == 1 and doc_id is not None}
    judged = []
    for doc_id, text, source in docs:
        ids = [other for other, same, _ in docs if (same or "") == (text or "") and other is not None]
        repeat = bool(ids) and (doc_id is None or min(ids) < doc_id)
        judged.append((doc_id, source or "", failed(text or "") | ({"E"} if repeat else set())))
    found = []
    for part in {part for _, part, _ in judged}:
        rows, removed_by, at = [row for row in judged if row[1] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, letter in enumerate(order, 1):
                removed = [row for row in left if letter in row[2]]
                failing = [row for row in rows if letter in row[2]]
                left = [row for row in left if letter not in row[2]]
                removed_by[letter] += len(removed)
                lost = [sum(row[0] in some for row in removed) for some in (good, toxic)]
                at.append((part, order, step, len(left), len(removed), len(failing) - len(removed), sum(row[2] == {letter} for row in failing), *lost))
        found += [(*row, removed_by[row[1][row[2] - 1]]) for row in at]
    return sorted(found, key=repr)


def given():
    clean, other = words(1, 90, 5000), words(2, 70, 5000)
    texts = [
        clean, clean, other, None, "", "Few words # here", "AB " * 80, "again and again " * 60, clean + " &", other, words(3, 49, 5000),
        words(3, 50, 5000), " ".join(f"w{at % 65}" for at in range(100)), " ".join(f"w{at % 64}" for at in range(100)), "é" * 95 + "ABCDE", "é" * 94 + "ABCDEF",
        words(4, 20000, 10**6), words(4, 20000, 10**6), "once#", "once#",
    ]
    docs = [(7 * at % 23, text, f"s{at % 3}" if at % 4 else None) for at, text in enumerate(texts)]
    docs += [docs[0], (docs[3][0], other, "s1"), (None, clean, "s0"), (None, "nobody else", "s0"), (None, "nobody else", ""), (None, "once#", "s2")]
    labels = [(at, at % 2, at % 3 == 0, None) for at in range(0, 23, 2)] + [(4, 0, 1, "s"), (4, 1, 0, "s"), (6, None, None, "s"), (None, 1, 1, "s")]
    return docs, [(doc_id, quality, None if bad is None else int(bad), source) for doc_id, quality, bad, source in labels]


def as_docs(spark, rows):
    return frame(spark, [(doc_id, text, "en", source, None) for doc_id, text, source in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_like_brute_force(spark, tmp_path, seed):
    docs, labels = given()
    random.Random(seed).shuffle(docs)
    for at in range(0, len(docs), 4):
        as_docs(spark, docs[at : at + 4]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    found = audit_filters(spark, f"{tmp_path}/documents.parquet", spark.createDataFrame(labels, LABELS), batches=7)
    assert of(found) == plain(docs, labels)


def test_a_repeated_batch_counts_once_and_smaller_ids_retract(spark, tmp_path):
    labels = flags(spark.createDataFrame([(5, 1, 0, None)], LABELS))
    audit = Audit(spark, str(tmp_path), labels)
    steps = [[(5, "same", "a"), (9, "same", "b")], [(3, "same", "b")], [(4, "same", "a"), (3, "same", "c")]]
    for at, docs in enumerate(steps):
        for _ in range(2):
            audit.take(as_docs(spark, docs), at)
            seen = [doc for step in steps[: at + 1] for doc in step]
            assert of(report(audit.counters())) == plain(seen, [(5, 1, 0, None)])


def test_no_documents(spark, tmp_path):
    as_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert audit_filters(spark, f"{tmp_path}/documents.parquet", spark.createDataFrame([], LABELS)).count() == 0
