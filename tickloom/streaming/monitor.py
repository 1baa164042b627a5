"""What running queries report: rows that came too late, the size of their state, and how long batches take."""

from __future__ import annotations

import threading
import time
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

AUDIT = "operator_id LONG, operator STRING, batch_id LONG, partitions LONG, keys LONG, most_keys LONG, empty LONG"
PROGRESS = "query_name STRING, batch_id LONG, input_rows LONG, late_rows LONG, state_rows LONG, millis LONG"


@dataclass
class Totals:
    """Of one named query, over all its batches since the log was attached."""

    batches: int = 0
    input_rows: int = 0
    late_rows: int = 0
    state_rows: int = 0
    recent: deque = field(default_factory=lambda: deque(maxlen=1000))


def state_keys(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """(partition_id, key, value) of what a stateful step of a stopped or running query has committed last."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint)


def audit_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per stateful step of a query: operator_id, operator, batch_id, partitions, keys, most_keys and empty.

    ``partitions`` is what the first start has fixed, ``most_keys`` the number of keys in the fullest of them and
    ``empty`` how many hold none: a few full ones among empty ones are keys that were not dealt evenly, or partitions that
    are too few for a larger load or too many for this one.
    """
    rows = spark.read.format("state-metadata").load(checkpoint).collect()
    found = None
    for row in rows:
        own = state_keys(spark, checkpoint, row.operatorId).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))
        counted = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most_keys"), F.count(F.lit(1)).alias("used"))
        told = counted.select(
            F.lit(row.operatorId).cast("long").alias("operator_id"), F.lit(row.operatorName).alias("operator"),
            F.lit(row.maxBatchId).cast("long").alias("batch_id"), F.lit(row.numPartitions).cast("long").alias("partitions"),
            "keys", "most_keys", (F.lit(row.numPartitions) - F.col("used")).alias("empty"),
        )
        found = told if found is None else found.unionByName(told)
    return spark.createDataFrame([], AUDIT) if found is None else found


class ProgressLog(StreamingQueryListener):
    """Counts per named query, and the last thousand batches of each.

    Late rows are those that a stateful step has dropped because the watermark had passed them. Windows drop what is
    left after rows of a window are put together, so a late row there is a ticker and window that got late quotes.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._totals: dict[str, Totals] = {}
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._totals.setdefault(event.name or str(event.id), Totals())

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(step.numRowsDroppedByWatermark for step in progress.stateOperators)
        state = sum(step.numRowsTotal for step in progress.stateOperators)
        name = progress.name or str(progress.id)
        with self._lock:
            totals = self._totals.setdefault(name, Totals())
            totals.batches += 1
            totals.input_rows += progress.numInputRows
            totals.late_rows += late
            totals.state_rows = state
            totals.recent.append((name, progress.batchId, progress.numInputRows, late, state, progress.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))

    def totals(self) -> dict[str, Totals]:
        with self._lock:
            return dict(self._totals)

    def table(self, spark: SparkSession) -> DataFrame:
        """The last batches of all queries."""
        with self._lock:
            rows = [row for totals in self._totals.values() for row in totals.recent]
        return spark.createDataFrame(rows, PROGRESS)

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Return when all that an ended query has reported is counted; reports come a moment after the fact."""
        until = time.monotonic() + seconds
        while time.monotonic() < until:
            with self._lock:
                if str(query.runId) in self._ended:
                    return
            time.sleep(0.05)
        raise TimeoutError(f"no report of the end of {query.name}")
