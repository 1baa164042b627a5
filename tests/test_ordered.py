"""Cut and uncut layouts must both give what a plain walk over each key gives."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators.ordered import Layout, lagged, plan_layout, running_sum

SCHEMA = "k STRING, at BIGINT, id BIGINT, v DOUBLE"


def skewed(n=3000, seed=3):
    """One key with most rows, one null key with many, times that repeat, missing values, and a tiny key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choices(["hot", None, "warm", "cold"], [60, 25, 14, 1])[0]
        rows.append((key, rng.randrange(n // 8), i, None if rng.random() < 0.1 else float(rng.randrange(1000))))
    return rows


def walk(rows):
    keys = {}
    for row in sorted(rows, key=lambda row: (row[1], row[2])):
        keys.setdefault(row[0], []).append(row)
    return keys


def expected_lag(rows, offset):
    return {
        row[2]: series[i - offset][3] if 0 <= i - offset < len(series) else None
        for series in walk(rows).values()
        for i, row in enumerate(series)
    }


def expected_sum(rows):
    result = {}
    for series in walk(rows).values():
        total = None
        for row in series:
            total = total if row[3] is None else (total or 0.0) + row[3]
            result[row[2]] = total
    return result


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module", params=[10_000, 200, 40], ids=["whole", "cut", "cut small"])
def laid_out(request, frame):
    layout = plan_layout(frame, "k", ("at", "id"), request.param)
    return layout.assign(frame), layout


def test_only_large_keys_are_cut_and_segments_are_bounded(frame):
    assert plan_layout(frame, "k", ("at", "id"), 3000).splits is None
    layout = plan_layout(frame, "k", ("at", "id"), 200)
    cut = {row.k for row in layout.splits.collect()}
    assert "hot" in cut and None in cut and "cold" not in cut
    sizes = layout.assign(frame).groupBy("_series").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 600 and sizes[1] == 3000


def test_segments_keep_the_order(frame):
    layout = plan_layout(frame, "k", ("at", "id"), 200)
    spans = (
        layout.assign(frame)
        .groupBy("_series")
        .agg(F.min(F.struct("at", "id")).alias("low"), F.max(F.struct("at", "id")).alias("high"))
        .orderBy("_series.key", "_series.segment")
        .collect()
    )
    for before, after in zip(spans, spans[1:]):
        if before._series.key == after._series.key:
            assert tuple(before.high) < tuple(after.low)


@pytest.mark.parametrize("offsets", [(1,), (1, 2, 7), (10,), (-1,), (-3, -10), (500,)])
def test_lags(laid_out, rows, offsets):
    assigned, layout = laid_out
    got = lagged(assigned, layout, {f"o{i}": ("v", offset) for i, offset in enumerate(offsets)}).collect()
    assert len(got) == len(rows)
    for i, offset in enumerate(offsets):
        assert {row.id: row[f"o{i}"] for row in got} == expected_lag(rows, offset)


def test_lags_of_two_columns(laid_out, rows):
    assigned, layout = laid_out
    got = lagged(assigned, layout, {"a": ("v", 1), "b": ("id", 3)}).collect()
    ids = {row[2]: row for row in rows}
    assert {row.id: row.a for row in got} == expected_lag(rows, 1)
    shifted = expected_lag([(key, at, i, i) for key, at, i, _ in rows], 3)
    assert {row.id: row.b for row in got} == shifted and len(ids) == len(got)


def test_running_sums(laid_out, rows):
    assigned, layout = laid_out
    got = running_sum(assigned, layout, {"total": "v"}).collect()
    assert {row.id: row.total for row in got} == expected_sum(rows)


def test_lags_of_one_call_look_one_way(laid_out):
    assigned, layout = laid_out
    for offsets in ((1, -1), (0,)):
        with pytest.raises(ValueError):
            lagged(assigned, layout, {f"o{i}": ("v", offset) for i, offset in enumerate(offsets)})


def test_facts_of_a_key_reach_all_its_segments(frame):
    layout = plan_layout(frame, "k", ("at", "id"), 40)
    facts = frame.groupBy("k").agg(F.count("*").alias("n"))
    joined = layout.release(layout.join_per_key(layout.assign(frame), facts))
    got = {row.k: (row.least, row.most) for row in joined.groupBy("k").agg(F.min("n").alias("least"), F.max("n").alias("most")).collect()}
    sizes = {row.k: row.n for row in facts.collect()}
    assert got == {key: (n, n) for key, n in sizes.items()}


def test_cut_rows_are_shuffled_once_for_window_and_join(spark, frame):
    layout = plan_layout(frame, "k", ("at", "id"), 200)
    spread = running_sum(layout.assign(frame), layout, {"total": "v"})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # the split points fit, the sums per segment do not
    try:
        plan = spread._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    left = plan[plan.index("SortMergeJoin") : plan.index("partial_sum")]
    # One for the rows, one for the bases by segment, and one for the window over a key's segments.
    assert left.count("Exchange hashpartitioning") <= 4 and "SinglePartition" not in plan
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning(_series" in line]
    assert len(lines) == 3


def test_rows_the_order_leaves_equal_are_spread_too(spark):
    rows = spark.range(20_000).selectExpr("'hot' as k", "7L as at", "1L as id", "id * 1.0 as v", "id as n")
    layout = plan_layout(rows, "k", ("at", "id"), 400)
    assigned = layout.assign(rows)
    sizes = assigned.groupBy("_series").count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    assert sizes[0] <= 1600 and sizes[1] == 20_000 and sizes[2] > 20
    shifted = lagged(assigned, layout, {"before": ("n", 1)})
    got = [row.before for row in layout.release(shifted).collect()]
    assert len(got) == 20_000 and len(set(got)) == 20_000, "each row is the one before of one other row"
    total = running_sum(assigned, layout, {"total": "v"}).agg(F.max("total"), F.count("*")).first()
    assert tuple(total) == (20_000 * 19_999 / 2, 20_000)


def test_rows_equal_in_all_columns_stay_together(spark):
    rows = spark.range(3000).selectExpr("'hot' as k", "7L as at", "1L as id", "2.0D as v")
    layout = plan_layout(rows, "k", ("at", "id"), 100)
    assert running_sum(layout.assign(rows), layout, {"total": "v"}).agg(F.max("total"), F.count("*")).first()[:2] == (6000.0, 3000)


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    layout = plan_layout(empty, "k", ("at", "id"), 10)
    assert layout == Layout("k", ("at", "id"))
    assert lagged(layout.assign(empty), layout, {"l": ("v", 1)}).isEmpty()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 5)), min_size=1, max_size=60), st.integers(1, 4))
def test_any_rows(spark, points, offset):
    rows = [(key, at, i, float(i)) for i, (key, at) in enumerate(points)]
    frame = spark.createDataFrame(rows, SCHEMA)
    layout = plan_layout(frame, "k", ("at", "id"), 8)
    got = lagged(layout.assign(frame), layout, {"l": ("v", offset)}).collect()
    assert {row.id: row.l for row in got} == expected_lag(rows, offset)
