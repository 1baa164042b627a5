"""Line deduplication against brute force, and the runs it keeps."""

import hashlib
from collections import defaultdict

from tests.llm.cases import frame, of
from tickloom.llm.lines import BLANKS, LOWER, UPPER, Runs, dedup_lines, line_keys, with_text

FOLD = str.maketrans(UPPER, LOWER)
LONG = "a line that is long enough"


def plain_keys(text):
    return [line.strip(BLANKS).translate(FOLD) for line in (text or "").split("\n")]


def plain(rows):
    first = {}
    for doc_id, text in rows:
        for key in plain_keys(text):
            if len(key) >= 10:
                first.setdefault(key, doc_id)
                if doc_id is not None and (first[key] is None or doc_id < first[key]):
                    first[key] = doc_id
    found = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line, key in zip(lines, plain_keys(text)) if first.get(key, doc_id) == doc_id]
        whole = "\n".join(kept)
        found.append((doc_id, len(lines), len(lines) - len(kept), whole, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(found, key=repr)


def given():
    rows = [
        (3, f"{LONG}\nshort\n {LONG.upper()}\t\n"), (1, f"first\n{LONG}\n{LONG}"), (2, None), (7, ""), (9, "\n\n"),
        (4, f"{LONG}\n{LONG}"), (5, "über dem ÄTHER\nnine char"), (6, "über dem äTHER\n  über dem äther\x0b\nnine char"),
        (8, "é" * 10), (10, "é" * 10 + "\r"), (11, " " + LONG), (5, "another text of five\n" + LONG), (4, f"{LONG}\n{LONG}"),
        (None, LONG + "\nonly rows without an id"), (None, "only rows without an id"), (-5, "nothing else holds this one"),
        (12, "\n".join(f"line number {at % 700}" for at in range(4000))), (13, "\n".join(f"line number {at}" for at in range(650, 760))),
    ]
    return rows + [(100 + at, f"{LONG}\nheader of page {at % 6}\nown text number {at}\nheader of page {at % 6}") for at in range(60)]


def as_docs(spark, rows):
    return frame(spark, [(doc_id, text, "en", "s", None) for doc_id, text in rows])


def test_lines_like_brute_force(spark):
    rows = given()
    for batches, fan_in in ((4, 3), (9, 2), (1, 2)):
        assert of(dedup_lines(as_docs(spark, rows), batches, fan_in)) == plain(rows)


def test_no_documents_and_no_lines(spark):
    assert dedup_lines(as_docs(spark, [])).count() == 0
    rows = [(None, None), (None, "short"), (None, LONG)]
    assert of(dedup_lines(as_docs(spark, rows))) == plain(rows)


def test_runs_are_levelled_and_earlier_batches_win(spark):
    runs = Runs(spark, fan_in=2)
    for at in range(7):
        batch = with_text(as_docs(spark, [(10 - at, f"common line of all batches\nown line of batch {at}")]))
        gone = runs.add(line_keys(batch)).collect()
        assert [row.pos for row in gone] == ([0] if at else [])
    # Seven runs, put together two by two before each batch: the last one, and one of each level below six.
    assert [len(level) for level in runs._levels] == [1, 1, 1]
    held = [spark.table(name) for level in runs._levels for name in level]
    assert sum(table.count() for table in held) == 8
    runs.close()
    assert not [table for table in spark.catalog.listTables() if "line_runs" in table.name]


def test_runs_are_not_shuffled_again(spark):
    runs = Runs(spark)
    for at in range(2):
        runs.add(line_keys(with_text(as_docs(spark, [(at, f"a line of batch {at}")])))).count()
    one, two = [spark.table(name) for name in runs._levels[0]]
    merged = one.join(two.hint("merge").select("h1", "h2"), ["h1", "h2"], "left_anti")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


def test_a_line_of_many_documents_is_spread(spark):
    rows = [(at, f"{LONG}\nown line number {at}") for at in range(3000)]
    found = dedup_lines(as_docs(spark, rows), 2).collect()
    assert sum(row.n_dropped for row in found) == 2999 and {row.n_lines for row in found} == {2}
    assert defaultdict(int, {row.doc_id: row.n_dropped for row in found})[0] == 0
