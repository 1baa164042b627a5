"""The queries of a running quote service, and the function that starts them all."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.clean import clean_quotes
from tickloom.operators.ordered import ROWS_PER_SEGMENT
from tickloom.plans.model import FILL_IN, LABEL_HORIZON, LEAVE_OUT, ModelStore, fitted, ols_signal, score, train_elastic_net, training_set
from tickloom.plans.signals import gen_signal
from tickloom.schemas import CLEAN_TOPIC, OLS_TOPIC, SIGNAL_TOPIC, TICKER, TIMESTAMP
from tickloom.session import session_settings
from tickloom.sources.messages import BROKER_SEQUENCE, FILE_SEQUENCE, broker_options, decode_messages, read_messages
from tickloom.streaming.history import HistoryTable
from tickloom.streaming.monitor import ProgressLog
from tickloom.streaming.sinks import DATE, Sink, collection_sink, fan_out, run_of, start_query, topic_sink
from tickloom.streaming.training import TrainingState

# Seconds between batches of each kind of query, window length and late-data allowance.
CLEAN_INTERVAL = 3
SIGNAL_INTERVAL = 10
TRAINING_INTERVAL = 180
WINDOW_SECONDS = 300
WATERMARK = "1 second"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_settings(partitions: int, rocksdb: bool = True) -> dict[str, str]:
    """Settings to start a windowed query with. Its state keeps the number of partitions of the first start, so
    choose it for the number of tickers, not for today's load. RocksDB keeps large state out of the heap."""
    settings = {"spark.sql.shuffle.partitions": str(partitions)}
    if rocksdb:
        settings["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB
    return settings


def train_on_batch(
    store: ModelStore,
    horizon: int = LABEL_HORIZON,
    sequence: Sequence[str] = FILE_SEQUENCE,
    rows_per_segment: int = ROWS_PER_SEGMENT,
    history: str | HistoryTable | None = None,
    minutes: int = 60,
    missing: str = FILL_IN,
    state: TrainingState | None = None,
) -> Callable[[DataFrame, int], None]:
    """Micro-batch function: fit a model on the batch's own rows and store it under the batch number.

    With ``state`` labels reach into earlier batches, and the model is that of all quotes of the state's last minutes,
    from the moments that were kept; the settings of labels are then the state's.

    With ``history``, clean quotes laid out by date, the batch only sets the time, and the model is fit on
    the stored quotes of the last ``minutes``. Without a labelled row the stored models stay as they are.
    """

    def train(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            if state is not None:
                run = run_of(rows.sparkSession)
                model = state.model(rows, batch_id, run)
                if model is not None:
                    store.save(model, batch_id, run)
                return
            recent = rows if history is None else recent_history(rows, history, minutes)
            training = training_set(recent, horizon, sequence, rows_per_segment)
            if missing == LEAVE_OUT and not training.isEmpty():  # rows left out are logged; without any other the model is zero
                model = train_elastic_net(training, missing=missing)
            else:
                model = fitted(training, missing=missing)
            if model is not None:
                store.save(model, batch_id, run_of(rows.sparkSession))
        finally:
            rows.unpersist()

    return train


def recent_history(rows: DataFrame, history: str | HistoryTable, minutes: int) -> DataFrame:
    """Stored clean quotes of the ``minutes`` up to the newest of the rows, or the rows as long as nothing is stored.

    Only the days in question are read, and of a ``HistoryTable`` only they are listed.
    """
    newest = rows.agg(F.unix_micros(F.max(TIMESTAMP))).first()[0]
    if newest is None:
        return rows
    until = F.timestamp_micros(F.lit(newest))
    since = F.timestamp_micros(F.lit(newest) - F.lit(minutes * 60_000_000))
    in_time = (F.col(TIMESTAMP) > since) & (F.col(TIMESTAMP) <= until)
    if isinstance(history, HistoryTable):
        first, last = rows.sparkSession.range(1).select(F.to_date(since).cast("string"), F.to_date(until).cast("string")).first()
        stored = history.days(first, last)
        return rows if stored is None else stored.where(in_time)
    try:
        stored = rows.sparkSession.read.parquet(history)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return rows
        raise
    return stored.where((F.col(DATE) >= F.to_date(since)) & (F.col(DATE) <= F.to_date(until)) & in_time)


def score_batch(
    store: ModelStore, sinks: Sequence[Sink], sequence: Sequence[str] = FILE_SEQUENCE
) -> Callable[[DataFrame, int], None]:
    """Micro-batch function: score the batch's tickers with the newest model, and write the signals to all sinks.

    The model is read once per batch, and a batch that comes before the first model is passed over.
    """
    write = fan_out(sinks)

    def run(rows: DataFrame, batch_id: int) -> None:
        model = store.newest()
        if model is not None:
            write(ols_signal(score(rows, model, sequence)), batch_id)

    return run


@dataclass
class Service:
    """What the service reads, where it writes, and where it keeps its progress and models.

    ``use_panes`` aggregates quotes to panes before windows: far less state work for busy tickers, and windows that
    may come out one batch later. With ``history``, a ``HistoryTable`` among the quote sinks or the path of a ``by_date``
    file sink there, models are trained on the stored quotes of the last ``minutes`` and not on the batch alone. ``horizon`` is the label's. With
    ``training_state`` they are trained on the last minutes without reading any quote again. ``monitor`` counts late rows,
    state and batches of all four queries.
    """

    quotes: DataFrame
    checkpoints: str
    models: ModelStore
    quote_sinks: Sequence[Sink]
    signal_sinks: Sequence[Sink]
    ols_sinks: Sequence[Sink]
    sequence: Sequence[str] = FILE_SEQUENCE
    use_panes: bool = True
    history: str | HistoryTable | None = None
    minutes: int = 60
    horizon: int = LABEL_HORIZON
    monitor: ProgressLog | None = None
    training_state: TrainingState | None = None
    state_settings: dict[str, str] = field(default_factory=lambda: stateful_settings(200))

    def start(self) -> list[StreamingQuery]:
        """Start the four queries. Each reads the source once per batch, however many sinks it has."""
        quotes, checkpoints = self.quotes, self.checkpoints
        if self.monitor is not None:
            quotes.sparkSession.streams.addListener(self.monitor)
        seconds = "{} seconds".format
        queries = [
            start_query(
                quotes,
                "training",
                train_on_batch(
                    self.models, self.horizon, self.sequence, history=self.history, minutes=self.minutes, state=self.training_state
                ),
                checkpoints,
                seconds(TRAINING_INTERVAL),
            ),
            start_query(
                quotes,
                "ols-signal",
                score_batch(self.models, self.ols_sinks, self.sequence),
                checkpoints,
                seconds(SIGNAL_INTERVAL),
            ),
            start_query(quotes, "clean-quotes", fan_out(self.quote_sinks), checkpoints, seconds(CLEAN_INTERVAL)),
        ]
        signals = gen_signal(
            quotes,
            WINDOW_SECONDS,
            SIGNAL_INTERVAL,
            sequence=self.sequence,
            watermark=WATERMARK,
            use_panes=self.use_panes,
        )
        with session_settings(quotes.sparkSession, self.state_settings):
            write = fan_out(self.signal_sinks)
            queries.append(start_query(signals, "rsi-mac-signal", write, checkpoints, seconds(SIGNAL_INTERVAL)))
        return queries


def broker_service(
    spark: SparkSession,
    servers: str,
    checkpoints: str,
    models: str,
    database: str = "stock",
    uri: str | None = None,
    history: str | None = None,
    minutes: int = 60,
    horizon: int = LABEL_HORIZON,
    most_per_batch: int | None = None,
    training_state: str | None = None,
) -> Service:
    """The service over a message broker and a document store. Their connectors must be on the classpath.

    ``most_per_batch`` is how many messages a batch takes at most, so that the first one after an outage is not all that
    has piled up; the rest follow in later batches. With ``history`` clean quotes are also stored there by date.
    ``training_state`` is a folder for what training keeps between batches.
    """
    limit = {} if most_per_batch is None else {"maxOffsetsPerTrigger": str(most_per_batch)}
    messages = read_messages(spark, "kafka", broker_options(servers, **limit))
    named = (TICKER, TIMESTAMP)
    kept = None if training_state is None else TrainingState(spark, training_state, minutes, horizon, BROKER_SEQUENCE)
    table = None if history is None else HistoryTable(spark, history)
    return Service(
        quotes=clean_quotes(decode_messages(messages, BROKER_SEQUENCE)),
        checkpoints=checkpoints,
        models=ModelStore(spark, models),
        quote_sinks=[
            topic_sink(servers, CLEAN_TOPIC),
            collection_sink(database, "real-time-stock-data", uri, (*named, *BROKER_SEQUENCE)),
            *([] if table is None else [table]),
        ],
        signal_sinks=[topic_sink(servers, SIGNAL_TOPIC), collection_sink(database, SIGNAL_TOPIC, uri, named)],
        ols_sinks=[topic_sink(servers, OLS_TOPIC), collection_sink(database, OLS_TOPIC, uri, named)],
        sequence=BROKER_SEQUENCE,
        history=table,
        minutes=minutes,
        horizon=horizon,
        monitor=ProgressLog(),
        training_state=kept,
    )


def run_until_failure(spark: SparkSession, service: Service) -> None:
    """Start the service and wait. The first query that fails stops the others and raises its error."""
    queries = service.start()
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for query in queries:
            query.stop()
