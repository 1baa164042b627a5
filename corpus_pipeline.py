"""A corpus pipeline of stages, each written as Parquet and read again as the documents of the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import staged
from tickloom.llm.language import decide_documents, row_key
from tickloom.llm.mixing import plan_mix
from tickloom.llm.packing import pack_documents
from tickloom.llm.passages import remove_repeats
from tickloom.llm.simhash import near_duplicates
from tickloom.session import local_folder_if_unset, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def document_key() -> Column:
    """128 bits of all columns, null or not: what tells two rows apart where ids lack or repeat."""
    parts = [part for name in COLUMNS for part in (F.col(name), F.col(name).isNull())]
    return F.concat(F.hex(F.xxhash64(*parts)), F.lit(":"), F.hex(F.xxhash64(F.lit(1), *parts)))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus declares, with the language found.

    Those that fit chance better than any language go. Rows without an id are judged like any other.
    """
    found = decide_documents(docs, docs)
    known = docs.select(*COLUMNS, row_key().alias("row_key"))
    languages = known.select("row_key", "lang").distinct().withColumnRenamed("lang", "lang_before")
    changed = found.join(languages, "row_key").where(~F.col("accepted") | ~F.col("lang_found").eqNullSafe(F.col("lang_before")))
    changed = staged(changed.select("row_key", "lang_found", "accepted"), "language-changes")
    judged = known.join(changed, "row_key", "left").where(F.coalesce("accepted", F.lit(True)))
    return judged.withColumn("lang", F.coalesce("lang_found", "lang")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose fingerprints link, the one with the smallest id; rows without an id come last, and ties go by key.

    A row stands for itself and not for its id, so of an id with two texts each can be the one that its group keeps.
    """
    keyed = docs.select(*COLUMNS, document_key().alias("row_key"))
    found = near_duplicates(keyed, carry=("row_key",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    kept = found.groupBy("component").agg(first.alias("first")).select("first.row_key")
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller id has too; those of which nothing is left go."""
    found = remove_repeats(docs, with_text=True, carry=("lang", "source", "n_chars"))
    found = found.where("n_removed = 0 or n_removed < n_words").withColumnRenamed("kept", "text")
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", size).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go. Rows that agree in all columns are one row
    that is taken as often as all of them."""
    keyed = docs.select(*COLUMNS, document_key().alias("row_key"))
    repeats = plan_mix(keyed, carry=("row_key",)).groupBy("row_key").agg(F.sum("repeats").cast("int").alias("repeats"))
    taken = keyed.dropDuplicates(["row_key"]).join(repeats.where("repeats > 0"), "row_key")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("time")).drop("time")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", in_a_language),
    ("simhash_near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # SQL has neither the tokenizer nor the fitted likelihoods; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    local_folder_if_unset(spark)
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
