"""What each of five filters removes in every order, counted by an incremental stream over the documents' files.

All files are processed as available-now micro-batches. A document first counts as a repeat. The document with the
smallest id of a text is none: its count moves from the mask with the repeat bit to the one without. State keyed by text
holds these documents, and when a smaller id of a text arrives in a later batch, the earlier move is retracted.
"""

from __future__ import annotations

from itertools import permutations
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import PYTHON_SETTINGS, WORD_PATTERN, staged
from tickloom.session import discard_folder, fresh_folder, session_settings
from tickloom.streaming.sinks import start_query
from tickloom.streaming.state import BatchTable

# The filters' letters, their limits, and the patterns.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 50, 65, 5
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BIT = {letter: 1 << at for at, letter in enumerate(FILTERS)}
REPEAT = BIT["E"]
ORDERS = ["".join(order) for order in permutations(FILTERS)]

# The files are taken in about this many micro-batches.
BATCHES = 4

HOLDER = "text_key BINARY, first LONG, part STRING, mask INT, good BOOLEAN, toxic BOOLEAN, n LONG"
COUNTER = "part STRING, mask INT, good BOOLEAN, toxic BOOLEAN, n LONG"
GROUP = ("part", "mask", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, BLANKS), lambda word: word != "")
    number, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    points = F.char_length(text).cast("long")
    upper = points - F.char_length(F.translate(text, UPPER, ""))
    fails = {
        "A": number < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT_PERCENT * number,
        "C": 100 * upper > MOST_UPPER_PERCENT * points,
        "D": text.rlike(SYMBOLS),
    }
    mask = F.lit(0)
    for letter, failed in fails.items():
        mask = mask + F.when(failed, BIT[letter]).otherwise(0)
    return mask


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, text_key): what the rest needs of a document."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return named.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("text_key"))


def flags(labels: DataFrame) -> DataFrame:
    """(of_id, good, toxic) per labelled id; of several labels of an id any that says so counts."""
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of_id"))
    return named.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )


class Audit:
    """Counters per part and mask, kept up to date batch by batch. ``counters`` has one row of changes per batch and group."""

    def __init__(self, spark: SparkSession, folder: str, labels: DataFrame):
        self._spark, self._labels = spark, labels
        self._holders = BatchTable(spark, f"{folder}/holders", HOLDER)
        self._changes = BatchTable(spark, f"{folder}/changes", COUNTER)

    def take(self, docs: DataFrame, batch_id: int) -> None:
        """One micro-batch. Repeated after a failure, it does the same again.

        Of a text's rows only those with its smallest id matter further on; they are found by the text's key *and* id,
        so a text that many documents have is spread over tasks.
        """
        narrow = staged(judged(docs), "judged", self._spark)
        labelled = narrow.join(self._labels, F.col("doc_id") == F.col("of_id"), "left").select(
            "text_key", "doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
        )
        labelled = staged(labelled, "labelled")
        firsts = labelled.groupBy(F.col("text_key").alias("of_key")).agg(F.min("doc_id").alias("first"))
        same = (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("first"))
        arrived = labelled.join(firsts, same).groupBy("text_key", "first", *GROUP).agg(F.count(F.lit(1)).alias("n"))

        earlier = self._holders.before(batch_id).withColumn("known", F.lit(True))
        by_text = Window.partitionBy("text_key")
        # A null id comes after all others: it is a text's smallest only if the text has no other.
        settled = earlier.unionByName(arrived.withColumn("known", F.lit(False))).select(
            "*",
            F.min(F.when(F.col("known"), F.col("first"))).over(by_text).alias("before"),
            F.min("first").over(by_text).alias("now"),
        )
        holds = F.col("first").eqNullSafe(F.col("now"))
        arrives = ~F.col("known") & holds
        retracted = F.col("known") & F.col("first").eqNullSafe(F.col("before")) & ~holds
        moved = staged(settled.where(arrives | retracted), "moved-masks")
        held = moved.where(~F.col("known"))
        self._holders.write(batch_id, held.select("text_key", "first", *GROUP, "n"))

        sign = F.when(F.col("known"), -1).otherwise(1)
        changes = labelled.select("part", (F.col("mask") + REPEAT).alias("mask"), "good", "toxic", F.lit(1).cast("long").alias("n"))
        changes = changes.unionByName(moved.select(*GROUP, (sign * F.col("n")).alias("n")))
        changes = changes.unionByName(moved.select("part", (F.col("mask") + REPEAT).alias("mask"), "good", "toxic", (-sign * F.col("n")).alias("n")))
        self._changes.write(batch_id, changes.groupBy(*GROUP).agg(F.sum("n").alias("n")))

    def counters(self) -> DataFrame:
        """(part, mask, good, toxic, n) over all batches so far."""
        return self._changes.rows().groupBy(*GROUP).agg(F.sum("n").alias("n"))


def report(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step. A part is one row of 32 counts, and each step sums over these."""
    masks = counters.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = parts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bits(letters: Column) -> Column:
        total = F.lit(0)
        for letter, bit in BIT.items():
            total = total + F.when(F.contains(letters, F.lit(letter)), bit).otherwise(0)
        return total

    order, step = F.col("filter_order"), F.col("step")
    placed = steps.select("*", bits(F.substring(order, step, F.lit(1))).alias("own"), bits(F.substring(order, F.lit(1), step - 1)).alias("gone"))
    own, gone = F.col("own"), F.col("gone")

    def total(value: str, which) -> Column:
        def add(sofar: Column, one: Column) -> Column:
            return sofar + F.when(which(one["mask"]), one[value]).otherwise(0)

        return F.aggregate("masks", F.lit(0).cast("long"), add)

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(own) != 0

    def passed(mask: Column) -> Column:
        return mask.bitwiseAND(gone) == 0

    # A filter removes what it fails if it comes first among the filters that this fails: in 1 of so many orders.
    def in_all_orders(sofar: Column, one: Column) -> Column:
        share = (F.lit(len(ORDERS)) / F.bit_count(one["mask"])).cast("long")
        return sofar + F.when(fails(one["mask"]), one["n"] * share).otherwise(0)

    return placed.select(
        "part", "filter_order", "step",
        total("n", lambda mask: mask.bitwiseAND(own.bitwiseOR(gone)) == 0).alias("kept"),
        total("n", lambda mask: fails(mask) & passed(mask)).alias("removed"),
        total("n", lambda mask: fails(mask) & ~passed(mask)).alias("redundant"),
        total("n", lambda mask: mask == own).alias("unique_fails"),
        total("good", lambda mask: fails(mask) & passed(mask)).alias("good_lost"),
        total("toxic", lambda mask: fails(mask) & passed(mask)).alias("toxic_lost"),
        F.aggregate("masks", F.lit(0).cast("long"), in_all_orders).alias("shapley"),
    )


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """What each filter removes, keeps and finds gone already, per part and order of the filters.

    ``path`` names Parquet files with doc_id, text and source; ``labels`` has doc_id, quality and toxic. The columns
    returned are part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    Null texts are empty, null sources the empty part. A row without an id fails E if any row with an id has its text;
    rows that share an id and a text do not fail it because of each other. Very long texts are read whole, as one row.
    An empty table has no parts and gives no rows. Further columns are not read.
    """
    docs = spark.read.parquet(path).select("doc_id", "text", "source")
    files = max(1, ceil(len(docs.inputFiles()) / max(1, batches)))
    folder = fresh_folder(spark, "filter-audit")
    audit = Audit(spark, folder, staged(flags(labels), "label-flags"))
    # A stream takes a single file for its base folder, and fails, unless the path is a pattern.
    pattern = path.rstrip("/")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(f"{pattern[:-1]}[{pattern[-1]}]")
    with session_settings(spark, PYTHON_SETTINGS):
        start_query(stream, "filter-audit", audit.take, f"{folder}/checkpoints").awaitTermination()
    counters = staged(audit.counters(), "filter-counters")
    discard_folder(spark, folder)
    return report(counters)


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, orders and steps of the whole documents table."""
    return audit_filters(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _audit_sql() -> str:
    letters = ", ".join(f"('{letter}', {bit})" for letter, bit in BIT.items())
    return f"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') as words from documents
),
judged as (
  select doc_id, part,
    case when len(words) < {LEAST_WORDS} then {BIT["A"]} else 0 end
    + case when 100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words) then {BIT["B"]} else 0 end
    + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_UPPER_PERCENT} * length(text) then {BIT["C"]} else 0 end
    + case when regexp_matches(text, '{SYMBOLS}') then {BIT["D"]} else 0 end
    + case when doc_id > min(doc_id) over (partition by text) then {BIT["E"]} else 0 end as mask
  from words
),
flagged as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by 1),
counted as (
  select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from judged left join flagged using (doc_id) group by 1, 2
),
letters(letter, bit) as (values {letters}),
steps as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, step,
    list_extract([a.bit, b.bit, c.bit, d.bit, e.bit], step) as own,
    list_sum(list_slice([a.bit, b.bit, c.bit, d.bit, e.bit], 1, step - 1)) as before
  from letters a, letters b, letters c, letters d, letters e, (select unnest(range(1, 6)) as step)
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
),
placed as (select filter_order, cast(step as int) as step, own, cast(coalesce(before, 0) as int) as gone from steps),
summed as (
  select part, filter_order, step, own,
    cast(sum(case when mask & (own | gone) = 0 then n else 0 end) as bigint) as kept,
    cast(sum(case when mask & own <> 0 and mask & gone = 0 then n else 0 end) as bigint) as removed,
    cast(sum(case when mask & own <> 0 and mask & gone <> 0 then n else 0 end) as bigint) as redundant,
    cast(sum(case when mask = own then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when mask & own <> 0 and mask & gone = 0 then good else 0 end) as bigint) as good_lost,
    cast(sum(case when mask & own <> 0 and mask & gone = 0 then toxic else 0 end) as bigint) as toxic_lost
  from counted, placed group by all
)
select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) as shapley from summed
""".strip()


AUDIT_SQL = _audit_sql()
