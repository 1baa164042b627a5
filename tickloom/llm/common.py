"""What several operators share: stored intermediate tables, words, and the parameters of the Python steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import fresh_folder, session_settings

# A word is a run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 text at the same characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# Rows handed to a Python worker at once: few enough that a batch of very long texts still fits in memory.
PYTHON_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.parquet.compression.codec": "zstd",
}


def staged(frame: DataFrame, purpose: str, reader: SparkSession | None = None, folder: str | None = None) -> DataFrame:
    """The rows of ``frame``, written to the shared folder and read again.

    Cuts the lineage, so that a lost executor costs its running tasks only, and nothing is computed twice. The folder
    lies below ``spark.checkpoint.dir``, where every executor reaches it. Rows of a micro-batch can be read again by
    another session, ``reader``: the one of the stream plans without adaptive execution. Who wants to discard them names
    the ``folder``, a fresh one.
    """
    spark = frame.sparkSession
    folder = folder or fresh_folder(spark, purpose)
    with session_settings(spark, PYTHON_SETTINGS):
        frame.write.parquet(folder)
    return (reader or spark).read.schema(frame.schema).parquet(folder)


NO_ID = -(2**63)  # stands for a null id in Python steps: pandas would turn a column with nulls into inexact floats


def identified(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text) and more columns for a Python step; ``anonymous`` puts the nulls back."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", *more)


def anonymous(frame: DataFrame) -> DataFrame:
    return frame.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; none for null."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def remainder(column: str, divisor: int) -> Column:
    """CRC-32 of an id as text, modulo ``divisor``. Null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor
