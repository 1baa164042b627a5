"""A stored history of quotes by day, in few folders, that readers see whole or not at all."""

from __future__ import annotations

from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.schemas import TIMESTAMP
from tickloom.session import delete_folder
from tickloom.streaming.sinks import DATE, run_of

ENTRY = "date STRING, part STRING"
# How many manifests are kept: readers that have just read one still find its files.
MANIFESTS = 3


class HistoryTable:
    """Rows laid out by date and then by part, with a manifest of the parts that count.

    Each micro-batch writes a part of each of its days and then a new manifest, a single file, so that readers see all
    of a batch or nothing. A repeated batch replaces its parts. When a day has ``compact_after`` parts, they are put
    together to one, but for the newest batch's, which could be repeated; so the manifest, and what a reader lists, grows
    with the days and not with the batches. One query writes a table; any number reads it.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_after: int = 64, name: str = "history"):
        if compact_after < 2:
            raise ValueError("compaction needs two parts at least")
        self.name = name
        self._spark, self._folder, self._compact_after = spark, folder.rstrip("/"), compact_after

    def _manifests(self) -> DataFrame | None:
        try:
            return self._spark.read.schema(f"{ENTRY}, version LONG").parquet(f"{self._folder}/manifest")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _entries(self, since: str | None = None, until: str | None = None) -> tuple[int, dict[int, set[tuple[str, str]]]]:
        """Number of the newest manifest, and the entries of those that are kept, of some days or of all."""
        manifests = self._manifests()
        if manifests is None:
            return -1, {}
        wanted = manifests
        if since is not None:
            wanted = manifests.where(F.col("date").isNull() | F.col("date").between(since, until))
        found: dict[int, set[tuple[str, str]]] = {}
        for row in wanted.collect():
            entries = found.setdefault(row.version, set())
            if row.part is not None:
                entries.add((row.date, row.part))
        return max(found, default=-1), found

    def _place(self, date: str, part: str) -> str:
        return f"{self._folder}/data/{DATE}={date}/part={part}"

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        """Add a micro-batch; the same again if it is repeated. Goes through ``rows`` once."""
        part = f"{run_of(rows.sparkSession)}-{batch_id}"
        dated = rows.withColumn(DATE, F.to_date(TIMESTAMP)).where(F.col(DATE).isNotNull()).withColumn("part", F.lit(part))
        seen = Observation()
        writer = dated.observe(seen, F.collect_set(DATE).alias("days")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE, "part")
        writer.parquet(f"{self._folder}/data")
        days = {(str(date), part) for date in seen.get.get("days") or ()}
        newest, known = self._entries()
        kept = {entry for entry in known.get(newest, set()) if entry[1] != part}
        self._commit(newest + 1, self._compacted(kept, newest + 1, rows.schema) | days, known)

    def _compacted(self, entries: set[tuple[str, str]], version: int, schema: StructType) -> set[tuple[str, str]]:
        """The entries, with one part instead of many for days that have many."""
        for date, number in Counter(date for date, _ in entries).items():
            if number >= self._compact_after:
                old = {entry for entry in entries if entry[0] == date}
                together = self._read(old, schema).drop(DATE, "part")
                together.coalesce(max(1, together.rdd.getNumPartitions() // 4)).write.mode("overwrite").parquet(self._place(date, f"c{version}"))
                entries = (entries - old) | {(date, f"c{version}")}
        return entries

    def _commit(self, version: int, entries: set[tuple[str, str]], known: dict[int, set[tuple[str, str]]]) -> None:
        rows = sorted(entries) or [(None, None)]  # a table without rows has a manifest too
        manifest = self._spark.createDataFrame(rows, ENTRY).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self._folder}/manifest/version={version}")
        # Folders that only manifests no longer kept name are read by nobody.
        gone = [number for number in known if number <= version - MANIFESTS]
        needed = entries.union(*[known[number] for number in known if number not in gone])
        for number in gone:
            for date, part in known[number] - needed:
                delete_folder(self._spark, self._place(date, part))
            delete_folder(self._spark, f"{self._folder}/manifest/version={number}")

    def _read(self, entries: set[tuple[str, str]], schema: StructType | None = None) -> DataFrame:
        reader = self._spark.read.option("basePath", f"{self._folder}/data")
        if schema is not None:
            reader = reader.schema(StructType(schema.fields).add(DATE, "date").add("part", "string"))
        return reader.parquet(*[self._place(*entry) for entry in sorted(entries)])

    def parts(self, since: str, until: str) -> list[str]:
        """The folders that a reader of these days lists."""
        newest, found = self._entries(since, until)
        return [self._place(*entry) for entry in sorted(found.get(newest, set()))]

    def days(self, since: str, until: str) -> DataFrame | None:
        """The rows of the days from ``since`` to ``until``, both as yyyy-mm-dd and included; nothing if there are none."""
        newest, found = self._entries(since, until)
        entries = found.get(newest, set())
        return self._read(entries).drop("part") if entries else None
