"""Where results go: broker topics, document collections, files and the console, from streams and from batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.messages import encode_for_topic
from tickloom.schemas import TIMESTAMP
from tickloom.sources.messages import PROBLEM

DATE = "date"
FILE_FORMATS = ("parquet", "orc", "json", "csv")


@dataclass(frozen=True)
class Sink:
    """A place to write to. ``topic`` asks for message encoding; ``path`` is for file formats, and ``by_date`` puts
    each day's rows in a folder of their own there, so that a reader of some days skips the rest."""

    name: str
    fmt: str
    options: Mapping[str, str] = field(default_factory=dict)
    topic: str | None = None
    path: str | None = None
    by_date: bool = False

    def shape(self, rows: DataFrame) -> DataFrame:
        """The rows as this sink wants them."""
        if self.by_date:
            rows = rows.withColumn(DATE, F.to_date(TIMESTAMP))
        return rows if self.topic is None else encode_for_topic(rows, self.topic)

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        """Write one micro-batch. In files each batch of each run has its own folder, so a repeated batch replaces
        itself, and a query that starts anew with another checkpoint leaves what is there. Brokers get a repeated batch
        again; a collection replaces documents by its key, if it has one."""
        writer = self.shape(rows).write.format(self.fmt).options(**dict(self.options))
        if self.fmt in FILE_FORMATS:
            if self.by_date:
                writer = writer.partitionBy(DATE)
            writer.mode("overwrite").save(f"{self.path}/run={run_of(rows.sparkSession)}/batch_id={batch_id}")
        else:
            writer.mode("append").save()


def run_of(spark: SparkSession) -> str:
    """Identity of the streaming query that is running this micro-batch function; its checkpoint keeps it."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def topic_sink(servers: str, topic: str) -> Sink:
    return Sink(f"topic {topic}", "kafka", {"kafka.bootstrap.servers": servers, "topic": topic}, topic=topic)


def collection_sink(database: str, collection: str, uri: str | None = None, key: Sequence[str] = ()) -> Sink:
    """Document collection. The connection URI holds a password: give it, or set TICKLOOM_DOCUMENT_URI.

    With ``key``, columns that name a document, a batch written again replaces its documents.
    """
    options = {
        "spark.mongodb.connection.uri": uri or os.environ["TICKLOOM_DOCUMENT_URI"],
        "spark.mongodb.database": database,
        "spark.mongodb.collection": collection,
    }
    if key:
        options |= {"operationType": "replace", "upsertDocument": "true", "idFieldList": ",".join(key)}
    return Sink(f"collection {collection}", "mongodb", options)


def file_sink(name: str, path: str, fmt: str = "parquet", topic: str | None = None, by_date: bool = False) -> Sink:
    """Files below a path. Messages have no date of their own, so ``by_date`` is for rows only."""
    if topic is not None and by_date:
        raise ValueError("encoded messages cannot be laid out by date")
    return Sink(name, fmt, topic=topic, path=path, by_date=by_date)


def console_sink() -> Sink:
    return Sink("console", "console", {"truncate": "false"})


def fan_out(sinks: Sequence[Sink]) -> Callable[[DataFrame, int], None]:
    """Micro-batch function that computes a batch once and writes it to every sink."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            for sink in sinks:
                sink.write_batch(rows, batch_id)
        finally:
            rows.unpersist()

    return write


def quarantine(readable: Callable[[DataFrame, int], None], unreadable: Sequence[Sink]) -> Callable[[DataFrame, int], None]:
    """Micro-batch function for checked messages (``problem``): those without a problem go on, the others to sinks of
    their own as they came, with the reason. The batch is computed once."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            readable(rows.where(F.col(PROBLEM).isNull()).drop(PROBLEM), batch_id)
            for sink in unreadable:
                sink.write_batch(rows.where(F.col(PROBLEM).isNotNull()), batch_id)
        finally:
            rows.unpersist()

    return write


def start_query(
    rows: DataFrame,
    name: str,
    target: Sink | Callable[[DataFrame, int], None],
    checkpoints: str,
    interval: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Start a named query with its own checkpoint, so that it resumes where it stopped.

    ``target`` is a sink or a micro-batch function. ``interval`` is the time between batches; without one the
    query processes what is there, in the source's batch size, and stops.
    """
    if isinstance(target, Sink):
        rows = target.shape(rows)
    writer = rows.writeStream.queryName(name).outputMode(mode)
    writer = writer.option("checkpointLocation", f"{checkpoints.rstrip('/')}/{name}")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    if not isinstance(target, Sink):
        return writer.foreachBatch(target).start()
    writer = writer.format(target.fmt).options(**dict(target.options))
    if target.by_date:
        writer = writer.partitionBy(DATE)
    return writer.start(target.path) if target.path else writer.start()
