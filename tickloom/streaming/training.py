"""What a training query keeps between micro-batches: the last quotes of each ticker, and moments of training rows.

With the first, a quote's label can lie in an earlier batch. With the second, a model of the last minutes follows from
what batches have left behind, and no quote is read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.ordered import ROWS_PER_SEGMENT, lagged, plan_layout
from tickloom.plans.elastic import MOMENTS, ElasticNet, fit, merged, moments
from tickloom.plans.model import FILL_IN, LABEL_HORIZON, filled
from tickloom.schemas import PRICE, TICKER, TIMESTAMP
from tickloom.sources.messages import FILE_SEQUENCE
from tickloom.streaming.state import BatchTable

# Moments are kept per span of so many seconds; what a model looks back on is cut to whole spans.
SPAN_SECONDS = 60
SPAN = "span"
_KNOWN = "_known"


def run_folder(folder: str, run: str) -> str:
    return f"{folder.rstrip('/')}/run={run}"


class LabelState:
    """Labels across micro-batches, from the last rows of each ticker.

    A label lies ``horizon`` rows away within the ticker, in the order of time and ``sequence``; below 0 earlier, above
    0 later. The state is a table of the ``abs(horizon)`` newest rows of each ticker. Each batch reads the one that the
    batch before it has left and writes its own, so that a repeated batch gives the same again.

    Batches that are cut by time give the training rows of one table, whatever the cut. A quote older than all that is
    kept of its ticker cannot be labelled any more and is left out; one that is late by less takes its place in order,
    and labels given before stay as they are.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: StructType,
        horizon: int = LABEL_HORIZON,
        sequence: Sequence[str] = FILE_SEQUENCE,
        rows_per_segment: int = ROWS_PER_SEGMENT,
    ):
        if horizon == 0:
            raise ValueError("a label cannot be the row's own price")
        ddl = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        self._newest = BatchTable(spark, folder, ddl, kept=3)
        self._horizon, self._sequence, self._rows_per_segment = horizon, tuple(sequence), rows_per_segment

    def label(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The training rows that this batch completes; its newest rows are kept for the next. Reads ``rows`` repeatedly."""
        number, order = abs(self._horizon), (TIMESTAMP, *self._sequence)
        before = self._newest.newest_before(batch_id).select(*rows.columns)
        place = F.struct(*order)
        oldest = before.groupBy(F.col(TICKER).alias("_ticker")).agg(F.min(place).alias("_oldest"), F.count(F.lit(1)).alias("_kept"))
        timely = rows.join(oldest, F.col(TICKER).eqNullSafe(F.col("_ticker")), "left")
        lost = F.coalesce((F.col("_kept") >= number) & (place < F.col("_oldest")), F.lit(False))
        both = timely.where(~lost).select(*rows.columns, F.lit(False).alias(_KNOWN))
        both = both.unionByName(before.withColumn(_KNOWN, F.lit(True)))

        newest = Window.partitionBy(TICKER).orderBy(*[F.desc(name) for name in order])
        kept = both.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= number)
        self._newest.write(batch_id, kept.select(*rows.columns))

        layout = plan_layout(both, TICKER, order, self._rows_per_segment)
        found = lagged(layout.assign(both), layout, {"label": (PRICE, -self._horizon)})
        # Looking back, kept rows have had their labels; looking ahead, they are kept because they have none yet.
        ready = F.col("label").isNotNull() & (F.lit(self._horizon > 0) | ~F.col(_KNOWN))
        return layout.release(found.where(ready)).drop(_KNOWN)


class TrainingState:
    """Labels and moments of a training query, below a folder that all executors reach and under the query's run.

    Each batch adds the moments of its training rows to those before it, per span of time, and drops spans that are
    older than ``minutes``; the table stays as small as the number of spans, whatever the number of quotes.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        minutes: int = 60,
        horizon: int = LABEL_HORIZON,
        sequence: Sequence[str] = FILE_SEQUENCE,
        rows_per_segment: int = ROWS_PER_SEGMENT,
        missing: str = FILL_IN,
    ):
        self._spark, self._folder, self._minutes = spark, folder, minutes
        self._label = {"horizon": horizon, "sequence": sequence, "rows_per_segment": rows_per_segment}
        self._missing = missing
        self._runs: dict[str, tuple[LabelState, BatchTable]] = {}

    def _of_run(self, run: str, schema: StructType) -> tuple[LabelState, BatchTable]:
        if run not in self._runs:
            folder = run_folder(self._folder, run)
            labels = LabelState(self._spark, f"{folder}/newest", schema, **self._label)
            self._runs[run] = labels, BatchTable(self._spark, f"{folder}/moments", f"{SPAN} LONG, {MOMENTS}", kept=3)
        return self._runs[run]

    def training_rows(self, rows: DataFrame, batch_id: int, run: str = "") -> DataFrame:
        return self._of_run(run, rows.schema)[0].label(rows, batch_id)

    def learn(self, rows: DataFrame, batch_id: int, run: str = "") -> DataFrame:
        """Take a batch's quotes in; the moments of all training rows of the last ``minutes``, one row per pair."""
        table = self._of_run(run, rows.schema)[1]
        training = filled(self.training_rows(rows, batch_id, run), self._missing)
        span = F.floor(F.unix_seconds(TIMESTAMP) / SPAN_SECONDS).cast("long")
        new = moments(training.withColumn(SPAN, span), SPAN)
        # A few rows per span; the newest span decides which are still in time.
        every = merged(table.newest_before(batch_id).unionByName(new.select(SPAN, *_names())), SPAN)
        newest = F.max(SPAN).over(Window.partitionBy("feature", "other"))
        timely = every.withColumn("_newest", newest).where(F.col(SPAN) > F.col("_newest") - self._minutes * 60 // SPAN_SECONDS)
        table.write(batch_id, timely.select(SPAN, *_names()))
        return merged(table.newest_before(batch_id + 1))

    def model(self, rows: DataFrame, batch_id: int, run: str = "", reg_param: float = 0.1, elastic_net_param: float = 0.8) -> ElasticNet | None:
        """The model as of this batch; none as long as no quote has a label."""
        return fit(self.learn(rows, batch_id, run), reg_param, elastic_net_param)


def _names() -> list[str]:
    return [part.split()[0] for part in MOMENTS.split(", ")]
