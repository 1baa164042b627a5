"""What the library needs from a Spark session: a shared folder, and settings that hold for one call."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the queries rely on. Times are read and shown in UTC. A projection of a whole quote compiles to one method
# too long for the JVM to optimize (8000 bytes of bytecode); over that limit Spark generates shorter ones instead.
QUERY_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Bucketed tables of this library have one file a bucket, so a scan has the order they were written in.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}

# For a large cluster: plan again with real sizes at run time, split what is skewed, and aim at partitions that fit
# in an executor's share of memory. The number of shuffle partitions is an upper limit; small ones are merged.
CLUSTER_SETTINGS = {
    **QUERY_SETTINGS,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    for name, value in settings.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir``. Intermediate tables have no other place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def local_folder_if_unset(spark: SparkSession) -> None:
    """On one machine, where a temporary folder is shared by all, let ``spark.checkpoint.dir`` be one if it is unset."""
    if not spark.conf.get("spark.checkpoint.dir", None) and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tickloom-"))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, where they would not find it by themselves.

    In local mode they do from the driver's working folder or PYTHONPATH. On a cluster neither need be theirs, so it is
    sent to them.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    application = spark.sparkContext.applicationId
    local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if application in _SHIPPED or local and any(path and os.path.realpath(path) == os.path.realpath(root) for path in found):
        return
    package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix=f"{package}-"), package), "zip", root, package)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


_SHIPPED: set[str] = set()


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """New folder name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tickloom-{purpose}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies. Whoever still reads it fails."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``fresh_folder`` named, or one in it, once its last reader has written its result."""
    inside = folder.removeprefix(shared_folder(spark).rstrip("/")).strip("/").split("/")[0]
    if not re.fullmatch(r"tickloom-.+-[0-9a-f]{32}", inside):
        raise ValueError(f"not a folder of this library: {folder}")
    delete_folder(spark, folder)


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Apply settings for the duration of a block, then restore what was there."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
