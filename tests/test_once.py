"""The sink that publishes a batch as a whole and once."""

import glob
import os

import pyarrow
import pytest
from pyspark.sql import functions as F

from tickloom.session import fresh_folder
from tickloom.streaming.once import OnceWriter, publish_once, published

SCHEMA = "a LONG, b STRING, at TIMESTAMP"


def rows(spark, first, number):
    return spark.range(first, first + number).select(F.col("id").alias("a"), F.concat(F.lit("x"), "id").alias("b"), F.timestamp_seconds("id").alias("at"))


def run(spark, folder, name="once", run_name="0"):
    source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    query = publish_once(source, name, f"{folder}/out", f"{folder}/checkpoints", run_name)
    query.awaitTermination()
    return query


def found(spark, folder):
    return sorted(row.a for row in published(spark, f"{folder}/out", rows(spark, 0, 1).schema).collect())


def local(folder):
    return folder.removeprefix("file:")


def test_each_batch_once_though_it_is_repeated(spark):
    folder = fresh_folder(spark, "once")
    for at in range(3):
        rows(spark, 100 * at, 100).repartition(4).write.mode("append").parquet(f"{folder}/in")
        run(spark, folder)
        assert found(spark, folder) == [*range(100 * (at + 1))]
    # The query forgets that its last batch has ended, as if the driver had been lost then, and does it again.
    newest = max(glob.glob(f"{local(folder)}/checkpoints/once/commits/[0-9]*"), key=lambda path: int(os.path.basename(path)))
    for path in (newest, f"{os.path.dirname(newest)}/.{os.path.basename(newest)}.crc"):
        os.remove(path)
    assert run(spark, folder).recentProgress[0].numInputRows == 100
    assert found(spark, folder) == [*range(300)]
    assert len(os.listdir(f"{local(folder)}/out/published")) == 3
    # Another query counts its batches from 0 again.
    run(spark, folder, "other", "1")
    assert found(spark, folder) == sorted([*range(300)] * 2)


def test_a_task_that_fails_halfway_publishes_nothing(spark):
    folder = local(fresh_folder(spark, "once"))
    writer = OnceWriter(folder, "0")
    batch = pyarrow.RecordBatch.from_pydict({"a": [1, 2]})

    def lost():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(lost())
    retried, other, empty = writer.write(iter([batch, batch])), writer.write(iter([batch])), writer.write(iter([]))
    assert len(os.listdir(f"{folder}/files")) == 3 and (retried.rows, other.rows, empty.name) == (4, 2, None)
    schema = spark.createDataFrame([], "a LONG").schema
    writer.commit([retried, None, empty], 0)
    assert published(spark, folder, schema).count() == 4
    writer.commit([other], 0)  # the batch again
    assert published(spark, folder, schema).count() == 4 and len(os.listdir(f"{folder}/files")) == 2
    aborted = writer.write(iter([batch]))
    writer.abort([aborted, None], 1)
    assert published(spark, folder, schema).count() == 4 and len(os.listdir(f"{folder}/files")) == 2
    writer.commit([], 1)
    assert published(spark, folder, schema).count() == 4
