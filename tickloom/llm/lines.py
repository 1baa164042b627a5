"""Line deduplication by levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, with the smallest document that holds each. Documents come
in batches. A batch's hashes are merged against all runs, those that no run holds become a run of their own, and a line
stays where the new run names its document. After a few runs of one level they are compacted to one of the next level,
so that a batch meets few runs however many came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import staged
from tickloom.session import discard_folder, fresh_folder, session_settings

# A line counts if its key has this many code points or more.
LEAST_LENGTH = 10
# Batches a table is taken in, and how many runs of a level are compacted to one of the next.
BATCHES, FAN_IN = 4, 3

# What is stripped from both ends of a line, and the letters that are folded.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HASH = ("h1", "h2")
# A row of the table: its id, and its text by hash, as ids can repeat with other texts.
ROW = ("doc_id", "t1", "t2")
# The files of a run hold one bucket each, so a scan has the order that they were written in.
RUN_SETTINGS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def hashes(text: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits of a text, as two numbers."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]


def with_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t1, t2), null texts as empty ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return named.select("*", *hashes(F.col("text"), ROW[1:]))


def line_keys(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2) of the lines that count. ``docs`` come from ``with_text``."""
    lines = docs.select(*ROW, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select(*ROW, "pos", F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER).alias("key"))
    return keyed.where(F.char_length("key") >= least).select(*ROW, "pos", *hashes(F.col("key"), HASH))


class Runs:
    """Levelled runs of line hashes, below the shared folder, that batches are checked against and added to.

    Earlier batches win over later ones, whatever the ids; within a batch the smallest id wins, and rows without an id
    come last. A run has as many buckets as the session has shuffle partitions when the first one is written, so a batch
    that is dealt by hash meets all runs without another shuffle of them.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self._spark, self._fan_in = spark, max(2, fan_in)
        self._folder = fresh_folder(spark, "line-runs")
        self._levels: list[list[str]] = [[]]
        self._written = 0
        first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        self._buckets = int(first or spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"{self._folder.rpartition('/')[2].replace('-', '_')}_{self._written}"
        self._written += 1
        writer = rows.write.bucketBy(self._buckets, *HASH).sortBy(*HASH).format("parquet")
        with session_settings(self._spark, RUN_SETTINGS):
            writer.option("path", f"{self._folder}/{name}").saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self._spark.sql(f"drop table if exists {name}")
        discard_folder(self._spark, f"{self._folder}/{name}")

    def add(self, lines: DataFrame) -> DataFrame:
        """The lines that an earlier batch, or an earlier document of this one, holds; the rest become known.

        ``lines`` has the columns of ``line_keys`` and is read twice. Minima are combined before the shuffle by hash.
        Lines then meet their new run by hash *and* document, so a line of many documents is spread by document.
        """
        self._compact()
        new = lines.groupBy(*HASH).agg(F.min("doc_id").alias("first"))
        for level in self._levels:
            for name in level:
                new = new.join(self._spark.table(name).select(*HASH), [*HASH], "left_anti")
        name = self._write(new)
        run = self._spark.table(name).select(*[F.col(part).alias(f"of_{part}") for part in HASH], "first")
        same = [F.col(part) == F.col(f"of_{part}") for part in HASH]
        dropped = staged(lines.join(run, [*same, F.col("doc_id").eqNullSafe(F.col("first"))], "left_anti"), "dropped-lines")
        self._levels[0].append(name)
        return dropped

    def _compact(self) -> None:
        """Runs share no hash, so they are put together and sorted."""
        for depth, level in enumerate(self._levels):  # a level that is added here is looked at as well
            if len(level) < self._fan_in:
                continue
            together = self._spark.table(level[0])
            for name in level[1:]:
                together = together.union(self._spark.table(name))
            if depth + 1 == len(self._levels):
                self._levels.append([])
            self._levels[depth + 1].append(self._write(together.repartition(self._buckets, *HASH)))
            self._levels[depth] = []
            for name in level:
                self._forget(name)

    def close(self) -> None:
        """Remove all runs."""
        for level in self._levels:
            for name in level:
                self._forget(name)
        discard_folder(self._spark, self._folder)


def cut_by_id(docs: DataFrame, batches: int) -> Column:
    """Number of a document's batch: stretches of ids with about as many documents each, rows without id in the last."""
    shares = [at / batches for at in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares).alias("cuts")).first()["cuts"] if shares else None
    number = F.lit(0)
    for cut in sorted(set(cuts or [])):
        number = number + F.when(F.col("doc_id") < cut, 0).otherwise(1)
    return number


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fan_in: int = FAN_IN, least: int = LEAST_LENGTH) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds.

    Returns doc_id, n_lines, n_dropped, kept (the text that is left) and kept_sha256 (of its UTF-8, lowercase hex), one
    row per row of ``docs``. Texts are split at line feeds; lines are compared without blanks at both ends and with A-Z
    lower-cased, if that leaves ``least`` code points. The smallest id that holds a line keeps all its copies of it.

    Null and empty texts are one empty line. Rows without an id count as one document that comes after all others. Rows
    that share an id never drop each other's lines; each is judged by its own text. Very long texts are one row's work
    in each step and are read whole. An empty table gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    rows = with_text(docs)
    folder = fresh_folder(spark, "line-hashes")
    line_keys(rows, least).withColumn("batch", cut_by_id(docs, batches)).write.partitionBy("batch").parquet(folder)
    schema = "doc_id long, t1 long, t2 long, pos int, h1 long, h2 long, batch int"
    lines = spark.read.schema(schema).parquet(folder)
    runs = Runs(spark, fan_in)
    dropped = None
    for batch in range(batches):
        found = runs.add(lines.where(F.col("batch") == batch).drop("batch"))
        dropped = found if dropped is None else dropped.union(found)
    runs.close()
    discard_folder(spark, folder)

    places = dropped.groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    places = places.select(*[F.col(name).alias(f"of_{name}") for name in ROW], "gone")
    same = [F.col(name).eqNullSafe(F.col(f"of_{name}")) for name in ROW]
    # A mark for each line up to the last one that goes; lines after it have none.
    gap = lambda place, at: place - F.coalesce(F.get("gone", at - 1), F.lit(-1)) - 1
    marks = F.flatten(F.transform("gone", lambda place, at: F.concat(F.array_repeat(F.lit(False), gap(place, at)), F.array(F.lit(True)))))
    split = F.split("text", "\n", -1)
    rest = F.array_join(F.zip_with(split, marks, lambda line, mark: F.when(mark, None).otherwise(line)), "\n")
    kept = rows.join(places, same, "left").select(
        "doc_id", F.size(split).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("kept"),
    )
    return kept.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256))


def lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of all documents."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


LINES_SQL = f"""
with lines as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key
  from (
    select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
),
first as (select key, min(doc_id) as first from lines where length(key) >= {LEAST_LENGTH} group by 1),
judged as (select l.*, coalesce(first < doc_id, false) as dropped from lines l left join first f on l.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from judged group by 1
""".strip()
