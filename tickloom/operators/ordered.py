"""Ordered computations per key that stay parallel when one key holds much of the data.

``Window.partitionBy(key)`` puts a key in one task. A layout cuts each key with too many rows into consecutive
segments of bounded size, so a window runs per key and segment. What a row needs from earlier segments (the last few
rows, a running total) is computed from one small row per segment and joined back. The join keys are the window's
partition keys, so the data is shuffled once. Results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import fresh_folder, shared_folder

SERIES, TIE = "_series", "_tie"
ROWS_PER_SEGMENT = 4_000_000
_SAMPLES_PER_SEGMENT = 16


@dataclass(frozen=True)
class Layout:
    """How the rows of a key are ordered and, where ``splits`` is set, cut into segments.

    ``splits`` has one row per cut key: the key and ``_splits``, the sorted points at which a segment begins.
    A segment is named by the struct column ``_series`` of key and number; as a struct it joins null keys too.
    Rows of a cut key that the order leaves equal are told apart by ``_tie``, a hash of ``tied_by``. Rows that agree in
    those columns too are interchangeable, and stay together.
    """

    key: str
    order: tuple[str, ...]
    splits: DataFrame | None = None
    depth: int = 0
    tied_by: tuple[str, ...] = ()

    @property
    def by(self) -> str:
        """The column to group, window and join by."""
        return self.key if self.splits is None else SERIES

    def _series(self, number: Column) -> Column:
        return F.struct(F.col(self.key).alias("key"), number.alias("segment")).alias(SERIES)

    def window(self, descending: bool = False) -> WindowSpec:
        names = self.order if self.splits is None else (*self.order, TIE)
        order = [F.col(name).desc() if descending else F.col(name).asc() for name in names]
        return Window.partitionBy(self.by).orderBy(*order)

    def across_segments(self, descending: bool = False) -> WindowSpec:
        """Window over one row per segment."""
        number = F.col(f"{SERIES}.segment")
        return Window.partitionBy(f"{SERIES}.key").orderBy(number.desc() if descending else number.asc())

    def assign(self, rows: DataFrame) -> DataFrame:
        """Add the segment, found by binary search among the key's split points, and the tie.

        Split points lie in files whose size Spark knows: it sends them to every task if they are small, and else joins
        them by key, where adaptive execution splits a key with many rows.
        """
        if self.splits is None:
            return rows
        splits = self.splits.withColumnRenamed(self.key, "_cut_key")
        tied = rows.withColumn(TIE, F.xxhash64(*self.tied_by))
        found = tied.join(splits, F.col(self.key).eqNullSafe(F.col("_cut_key")), "left")
        found = found.withColumn("_number", F.lit(0))
        place = F.struct(*self.order, TIE)
        for bit in reversed(range(self.depth)):
            further = F.col("_number") + F.lit(1 << bit)
            passed = F.get("_splits", further - 1) <= place
            found = found.withColumn("_number", F.when(passed, further).otherwise(F.col("_number")))
        return found.select(*tied.columns, self._series(F.col("_number")))

    def settle(self, rows: DataFrame) -> DataFrame:
        """Store the rows of a cut layout in the checkpoint folder.

        Each step over a cut layout reads its input twice, so a chain of steps would repeat the early ones again and
        again. Without cut keys a step reads its input once, and the rows are passed on as they are.
        """
        if self.splits is None:
            return rows
        shared_folder(rows.sparkSession)
        return rows.checkpoint()

    def release(self, rows: DataFrame) -> DataFrame:
        """Drop the segment and the tie."""
        return rows.drop(SERIES, TIE)

    def segments(self) -> DataFrame:
        """Every segment of the cut keys."""
        numbers = F.explode(F.sequence(F.lit(0), F.size("_splits"))).alias("_number")
        return self.splits.select(self.key, numbers).select(self._series(F.col("_number")))

    def join_per_key(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        """Left join facts that have one row per key. A cut key's facts are repeated for each of its segments, so
        its rows stay spread; without cut keys this is a join on the key. Null keys find their facts too."""
        if self.splits is not None:
            last = self.splits.select(F.col(self.key).alias("_cut_key"), F.size("_splits").alias("_last"))
            named = facts.join(last, F.col(self.key).eqNullSafe(F.col("_cut_key")), "left")
            numbers = F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0)))).alias("_number")
            others = [name for name in facts.columns if name != self.key]
            facts = named.select(*facts.columns, numbers).select(self._series(F.col("_number")), *others)
        facts = facts.withColumnRenamed(self.by, "_fact_key")
        joined = rows.join(facts, F.col(self.by).eqNullSafe(F.col("_fact_key")), "left")
        return joined.select(*rows.columns, *[name for name in facts.columns if name != "_fact_key"])


def plan_layout(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> Layout:
    """Cut the keys that have about ``rows_per_segment`` rows or more.

    Rows are counted per key first, which reads no other column; where no key has more, that is all. Only the rows of
    longer keys are sampled, picked by a hash of whole rows, so that split points are the same on every retry, whatever
    the order leaves equal. A segment gets ``_SAMPLES_PER_SEGMENT`` sampled rows, so a key's list of them has one entry
    for each ``rows_per_segment / _SAMPLES_PER_SEGMENT`` rows. Split points are a table in the shared folder: a lost
    executor cannot change them.
    """
    order, tied_by = tuple(order), tuple(rows.columns)
    counts = rows.groupBy(F.col(key).alias("_long_key")).agg(F.count(F.lit(1)).alias("_rows"))
    long_keys = counts.where(F.col("_rows") > rows_per_segment).select("_long_key")
    if long_keys.isEmpty():
        return Layout(key, order)
    one_in = max(1, rows_per_segment // _SAMPLES_PER_SEGMENT)
    tied = rows.select(key, *[name for name in order if name != key], F.xxhash64(*tied_by).alias(TIE))
    sampled = tied.where(F.pmod(F.xxhash64(TIE), F.lit(one_in)) == 0)
    sampled = sampled.join(long_keys, F.col(key).eqNullSafe(F.col("_long_key")), "left_semi")
    points = F.sort_array(F.collect_list(F.struct(*order, TIE)))
    every_nth = F.array_distinct(F.filter(points, lambda point, i: i % _SAMPLES_PER_SEGMENT == _SAMPLES_PER_SEGMENT - 1))
    cut = sampled.groupBy(key).agg(every_nth.alias("_splits")).where(F.size("_splits") > 0)
    folder = fresh_folder(rows.sparkSession, "splits")
    cut.write.parquet(folder)
    splits = rows.sparkSession.read.schema(cut.schema).parquet(folder)
    most = splits.agg(F.max(F.size("_splits"))).first()[0]
    return Layout(key, order) if most is None else Layout(key, order, splits, int(most).bit_length(), tied_by)


def lagged(rows: DataFrame, layout: Layout, outputs: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Add columns from earlier rows of the key: ``{new name: (column, how many rows back)}``.

    Negative numbers look forward. All numbers of one call have the same sign.
    """
    offsets = [offset for _, offset in outputs.values()]
    descending = offsets[0] < 0
    if any(offset == 0 or (offset < 0) != descending for offset in offsets):
        raise ValueError("offsets must not be 0 and must have one sign")
    window = layout.window(descending)
    if layout.splits is None:
        lags = [F.lag(column, abs(offset)).over(window).alias(name) for name, (column, offset) in outputs.items()]
        return rows.select("*", *lags)

    reach = max(abs(offset) for offset in offsets)
    columns = sorted({column for column, _ in outputs.values()})
    # The rows nearest to the next segment: a partial top-k runs before the shuffle.
    ends = (
        rows.select(layout.by, *columns, F.row_number().over(layout.window(not descending)).alias("_rank"))
        .where(F.col("_rank") <= reach)
        .groupBy(layout.by)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", *columns))).alias("_ends"))
    )
    nearest = layout.across_segments(not descending).rowsBetween(1, reach)
    carry = F.slice(F.flatten(F.collect_list("_ends").over(nearest)), 1, reach)
    carried = ends.select(layout.by, carry.alias("_carry"))

    inside = [
        F.lag(column, abs(offset)).over(window).alias(f"_in_{name}") for name, (column, offset) in outputs.items()
    ]
    ranked = rows.select("*", *inside, F.row_number().over(window).alias("_rank"))
    joined = ranked.join(carried, layout.by, "left")

    def value(name: str, column: str, offset: int) -> Column:
        reached = F.get("_carry", F.lit(abs(offset)) - F.col("_rank")).getField(column)
        return F.when(F.col("_rank") > abs(offset), F.col(f"_in_{name}")).otherwise(reached).alias(name)

    return joined.select(*rows.columns, *[value(name, column, offset) for name, (column, offset) in outputs.items()])


def running_sum(rows: DataFrame, layout: Layout, outputs: Mapping[str, str]) -> DataFrame:
    """Add running totals of each key in order: ``{new name: column}``."""
    window = layout.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {name: F.sum(column).over(window) for name, column in outputs.items()}
    if layout.splits is None:
        return rows.select("*", *[total.alias(name) for name, total in sums.items()])
    before = layout.across_segments().rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(layout.by).agg(*[F.sum(column).alias(f"_sum_{name}") for name, column in outputs.items()])
    bases = totals.select(layout.by, *[F.sum(f"_sum_{name}").over(before).alias(f"_base_{name}") for name in outputs])
    inside = rows.select("*", *[total.alias(f"_in_{name}") for name, total in sums.items()])
    joined = inside.join(bases, layout.by, "left")

    def total(name: str) -> Column:
        base, added = F.col(f"_base_{name}"), F.col(f"_in_{name}")
        return F.coalesce(base + added, base, added).alias(name)

    return joined.select(*rows.columns, *[total(name) for name in outputs])
