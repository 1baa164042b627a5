"""Views that follow a stream: after each micro-batch what a query over all rows so far would give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.schemas import TICKER, TIMESTAMP
from tickloom.streaming.state import BatchTable


class RunningView:
    """The newest quote of each ticker, a recent stretch of each series, or whatever else needs its own result only.

    ``keep`` turns rows to those that are shown, of the same columns, and what it leaves out must not come back as rows
    are added: ``latest_quote`` and ``retain_recent`` are such. Then the view of all rows is that of the view before and
    the batch's rows, and nothing else is kept. A repeated batch gives the same again. Tickers without a row in the
    ``idle_minutes`` before the newest row of all are dropped; one that comes back starts anew.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: StructType,
        keep: Callable[[DataFrame], DataFrame],
        idle_minutes: int | None = None,
    ):
        ddl = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        self._view, self._names = BatchTable(spark, folder, ddl, kept=3), schema.names
        self._keep, self._idle = keep, idle_minutes

    def take(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The view with the batch's rows."""
        columns = [F.col(f"`{name}`") for name in self._names]
        both = self._view.newest_before(batch_id).select(*columns).unionByName(rows.select(*columns))
        shown = self._keep(both).select(*columns)
        if self._idle is not None:
            # One row per ticker decides, so the newest time of all is that of few rows.
            last = shown.groupBy(F.col(TICKER).alias("_ticker")).agg(F.max(TIMESTAMP).alias("_last"))
            newest = last.agg(F.max("_last").alias("_newest"))
            alive = last.join(newest, F.col("_last") >= F.col("_newest") - F.make_dt_interval(mins=F.lit(self._idle)), "left_semi")
            shown = shown.join(alive, F.col(TICKER).eqNullSafe(F.col("_ticker")), "left_semi").select(*columns)
        self._view.write(batch_id, shown)
        return self._view.newest_before(batch_id + 1)
