"""A file sink that publishes a micro-batch as a whole and once, as a data source with commit messages."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tickloom.session import ship_package

FORMAT = "tickloom_once"


def _system(path: str):
    """The store of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: the name of its file, none for a task without rows."""

    name: str | None
    rows: int


class OnceWriter(DataSourceStreamArrowWriter):
    """Tasks write files under names of their own, which nobody reads yet. The driver then writes one file that names
    those of all tasks of the batch: from then on they count. Tasks that fail or run twice leave files that are never
    named, and a batch that is repeated after it was published is not published again."""

    def __init__(self, path: str, run: str):
        self._path, self._run = path.rstrip("/"), run

    def write(self, iterator: Iterator) -> Written:  # of Arrow batches
        from pyarrow import parquet

        system, root = _system(self._path)
        name, total, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if writer is None:
                    system.create_dir(f"{root}/files")
                    writer = parquet.ParquetWriter(f"{root}/files/{name}", batch.schema, filesystem=system)
                writer.write_batch(batch)
                total += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if total else None, total)

    def _commit_file(self, batch_id: int) -> str:
        return f"published/{self._run}-{batch_id}.json"

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        from pyarrow import fs

        system, root = _system(self._path)
        place = f"{root}/{self._commit_file(batchId)}"
        names = [message.name for message in messages if message is not None and message.name]
        if system.get_file_info(place).type != fs.FileType.NotFound:
            self._remove(names)
            return
        system.create_dir(f"{root}/published")
        begun = f"{root}/published/.{uuid.uuid4().hex}"
        lines = [json.dumps({"run": self._run, "batch_id": batchId, "name": name}) for name in names]
        with system.open_output_stream(begun) as out:
            out.write("\n".join(lines).encode())
        system.move(begun, place)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._remove([message.name for message in messages if message is not None and message.name])

    def _remove(self, names: list[str]) -> None:
        system, root = _system(self._path)
        for name in names:
            system.delete_file(f"{root}/files/{name}")


class OnceSource(DataSource):
    """``path`` is a folder that all executors reach; ``run`` tells apart queries that count batches from 0 again."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> OnceWriter:  # noqa: N802
        return OnceWriter(self.options["path"], self.options.get("run", "0"))


def publish_once(rows: DataFrame, name: str, path: str, checkpoints: str, run: str = "0", interval: str | None = None) -> StreamingQuery:
    """Start a named query that publishes each micro-batch of a stream below ``path`` as a whole and once.

    A query with a checkpoint of its own needs a ``run`` of its own. Without ``interval`` it takes what is there and stops.
    """
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(OnceSource)
    writer = rows.writeStream.queryName(name).format(FORMAT).option("path", path).option("run", run)
    writer = writer.option("checkpointLocation", f"{checkpoints.rstrip('/')}/{name}")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def published(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all published batches."""
    path = path.rstrip("/")
    names = spark.read.schema("run STRING, batch_id LONG, name STRING").json(f"{path}/published").where("name is not null")
    files = [f"{path}/files/{row.name}" for row in names.select("name").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
