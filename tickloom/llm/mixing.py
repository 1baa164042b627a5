"""Mixing sources to target weights by capped water-filling.

Every source gets a target in proportion to its weight, clamped at ``max_epochs`` times its size; what is clamped off
goes to the other sources by weight until none is above its clamp. With sources in order of clamp by weight, the level
of the water follows from two running sums, so it is one query over a table of one row per source.

A document is repeated whole ``floor(target / source size)`` times, and once more if it ends before the cut of its
source's seeded order, or is the one behind it whose size comes nearest to the gap that is left. The cut is found without sorting a source in one task: the order begins with a hash prefix, sums
per prefix give each prefix its start, and only documents of one prefix are put in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD_PATTERN, staged

PREFIX_DIGITS = 3  # hexadecimal; 4096 parts of each source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights repeat over the sources in order of code point, null last. A source of size zero has the target zero.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    weighed = weighed.withColumn("clamp", F.col("source_size") * F.lit(float(max_epochs)))
    filled = Window.orderBy(F.col("clamp") / F.col("weight"), "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    throughout = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source, in filling order, whose clamp is not below its share sets the level for itself and all after.
    level = F.when(F.col("clamp") >= level * F.col("weight"), level)
    settled = weighed.withColumn("level", level)
    settled = settled.withColumn("level", F.first("level", ignorenulls=True).over(throughout))
    target = F.coalesce(F.least("clamp", F.col("level") * F.col("weight")), F.col("clamp"))
    return settled.select("source", "source_size", target.alias("target"))


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(source, doc_id, size, source_size, target, repeats, and the columns of ``carry``) of every row of ``docs``.

    Size is the number of words; null and empty texts have none and are taken as often as any of their source. Rows
    that repeat are counted, and placed, one by one. Other columns are ignored. Runs agree: the order is
    ``md5(seed:doc_id)``, then doc_id and size. Only whole documents are taken.
    """
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place.alias("place"), *carry)
    sized = staged(sized.withColumn("part", F.substring("place", 1, PREFIX_DIGITS)), "mix-sizes")
    parts = staged(sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "mix-parts")
    totals = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    goals = targets(totals, weights, max_epochs).withColumnRenamed("source", "goal_source")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    starts = starts.join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
    starts = starts.select(
        F.col("source").alias("in_source"), F.col("part").alias("in_part"), "part_start", "source_size", "target"
    )
    within = Window.partitionBy("source", "part").orderBy("place", "doc_id", "size")
    ordered = sized.withColumn("end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ordered.join(starts, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("part") == F.col("in_part")))
    ratio = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0)
    placed = joined.withColumn("whole", whole).select(
        "source", "doc_id", "size", "source_size", "target", "whole", "place", *carry,
        (F.col("part_start") + F.col("end")).alias("end"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"),
    )
    placed = staged(placed, "mix-placed")
    gaps = placed.groupBy("source", "need").agg(
        F.coalesce(F.max(F.when(F.col("end") <= F.col("need"), F.col("end"))), F.lit(0)).alias("reached")
    )
    gaps = gaps.select(F.col("source").alias("in_source"), (F.col("need") - F.col("reached")).alias("gap"))
    later = placed.where("end > need").join(gaps, F.col("source").eqNullSafe(F.col("in_source")))
    later = later.where(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
    last = later.groupBy("in_source").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "place", "doc_id", "size", "end")).alias("last")
    )
    last = last.select("in_source", F.col("last.end").alias("last_end"))
    chosen = placed.join(last, F.col("source").eqNullSafe(F.col("in_source")), "left")
    again = (F.col("end") <= F.col("need")) | ((F.col("end") == F.col("last_end")) & (F.col("size") > 0))
    repeats = F.least(F.col("whole") + F.coalesce(again, F.lit(False)).cast("int"), F.lit(max_epochs)).cast("int")
    return chosen.select("source", "doc_id", "size", "source_size", "target", repeats.alias("repeats"), *carry)


def mix_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    planned = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.col("size") * F.col("repeats")
    return planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "repeats")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS clamp, place,
         (place % 3 + 1)::DOUBLE AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source)),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(clamp) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS water
  FROM weighed
  WINDOW before AS (ORDER BY clamp / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         coalesce(least(clamp, first_value(CASE WHEN clamp >= water * weight THEN water END IGNORE NULLS) OVER
                               (ORDER BY clamp / weight, place
                                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight), clamp) AS target
  FROM filled),
ordered AS (
  SELECT s.*, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ending
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
needed AS (SELECT *, target - whole * source_size AS need FROM ordered),
gaps AS (
  SELECT source, need - coalesce(max(CASE WHEN ending <= need THEN ending END), 0) AS gap
  FROM needed GROUP BY source, need),
fillers AS (
  SELECT n.source, n.ending, row_number() OVER (PARTITION BY n.source
           ORDER BY abs(size - gap), place, doc_id, size, ending) AS nearest
  FROM needed n JOIN gaps g ON n.source IS NOT DISTINCT FROM g.source
  WHERE ending > need AND abs(size - gap) < gap),
chosen AS (
  SELECT n.*, CAST(least(whole + CASE WHEN n.ending <= need OR (f.ending IS NOT NULL AND size > 0) THEN 1 ELSE 0 END, 3)
                 AS INTEGER) AS repeats
  FROM needed n LEFT JOIN fillers f
    ON n.source IS NOT DISTINCT FROM f.source AND n.ending = f.ending AND f.nearest = 1)
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken, source, repeats FROM chosen
"""
