"""Quote messages from a broker or from files, and their decoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import KEY_SCHEMA, MESSAGE_FILE_SCHEMA, RAW_SCHEMA, RAW_TOPIC, TIMESTAMP

# The columns that tell two messages of one instant apart.
BROKER_SEQUENCE = ("partition", "offset")
FILE_SEQUENCE = ("event_id",)


def broker_options(servers: str, topic: str = RAW_TOPIC, **more: str) -> dict[str, str]:
    """Options of a topic subscription that starts at the newest message and survives lost data."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
        **more,
    }


def read_messages(
    spark: SparkSession,
    fmt: str,
    options: Mapping[str, str] | None = None,
    path: str | None = None,
    streaming: bool = True,
) -> DataFrame:
    """Key, value and timestamp of every message, as a stream or as a table.

    ``kafka`` brings its own schema. File formats are read with a declared one and never inferred.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt).options(**dict(options or {}))
    if fmt != "kafka":
        reader = reader.schema(MESSAGE_FILE_SCHEMA)
    return reader.load(path) if path else reader.load()


def decode_messages(messages: DataFrame, sequence: Sequence[str] = FILE_SEQUENCE) -> DataFrame:
    """Flatten key and value JSON to columns. JSON that does not parse gives nulls.

    ``sequence`` names the columns to keep for ordering messages of one instant.
    """
    key = F.from_json(F.col("key").cast("string"), KEY_SCHEMA)
    value = F.from_json(F.col("value").cast("string"), RAW_SCHEMA)
    return messages.select(TIMESTAMP, *sequence, key.alias("key"), value.alias("value")).select(
        TIMESTAMP, *sequence, "key.*", "value.*"
    )


# Why a message cannot be read.
NO_VALUE, NOT_JSON, NO_OBJECT, NO_TICKER = "no value", "not JSON", "not an object", "no ticker"
PROBLEM = "problem"


def check_messages(messages: DataFrame) -> DataFrame:
    """Add ``problem``: why a message cannot be decoded, null if it can.

    Text is parsed to a variant, which tells broken JSON from JSON of another shape. Fields that lack or are null are no
    problem, as pages leave some out. In the same pass as ``decode_messages`` with ``problem`` among its kept columns.
    """
    key, value = (F.try_parse_json(F.col(name).cast("string")) for name in ("key", "value"))
    kind = F.schema_of_variant(value)
    ticker = F.try_variant_get(key, f"$.{KEY_SCHEMA.names[0]}", "string")
    problem = (
        F.when(F.col("value").isNull(), NO_VALUE)
        .when(value.isNull(), NOT_JSON)
        .when(~kind.startswith("OBJECT"), NO_OBJECT)
        .when(ticker.isNull(), NO_TICKER)
    )
    return messages.withColumn(PROBLEM, problem)
