"""What a streaming query remembers from one micro-batch to the next, as tables that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import delete_folder

BATCH = "batch_id"


class BatchTable:
    """Rows that micro-batches leave behind, one folder per batch, below a folder that all executors reach.

    A batch reads what the batches before it have left and writes its own folder. A batch that is repeated after a
    failure reads the same and replaces its folder, so its result is the same and nothing is counted twice. ``kept``
    limits how many batches' folders stay, for tables of which each batch writes the whole; two are enough for a repeat.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, kept: int | None = None):
        self._spark, self._folder, self._kept = spark, folder.rstrip("/"), kept
        if kept is not None and kept < 2:
            raise ValueError("a repeated batch needs the folder of the batch before it")
        self._schema = schema
        # Readers find a folder before the first batch has written one; it is never read as a batch.
        none = spark.createDataFrame([], schema)
        none.write.mode("overwrite").parquet(f"{self._folder}/{BATCH}=-1")

    def _all(self) -> DataFrame:
        return self._spark.read.schema(f"{self._schema}, {BATCH} LONG").parquet(self._folder)

    def before(self, batch_id: int) -> DataFrame:
        """Rows of all batches before this one."""
        return self._all().where(F.col(BATCH) < batch_id).drop(BATCH)

    def newest_before(self, batch_id: int) -> DataFrame:
        """Rows of the last batch before this one; for tables of which each batch writes the whole."""
        return self._spark.read.schema(self._schema).parquet(f"{self._folder}/{BATCH}={max(batch_id, 0) - 1}")

    def rows(self) -> DataFrame:
        """Rows of all batches."""
        return self._all().drop(BATCH)

    def write(self, batch_id: int, rows: DataFrame) -> None:
        """Make these the rows of the batch, and forget those of batches that are no longer needed."""
        rows.write.mode("overwrite").parquet(f"{self._folder}/{BATCH}={batch_id}")
        if self._kept is not None and batch_id >= self._kept:
            delete_folder(self._spark, f"{self._folder}/{BATCH}={batch_id - self._kept}")
