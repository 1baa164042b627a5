"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores. Each query runs once to warm up and
then BENCH_RUNS times; the best run counts. Results go to Spark's ``noop`` sink, so every row is computed.

The tables are single files of one row group, which only one core could read, so they are first laid out as a file for
each core in a local temporary folder. That is fine here, where everything runs on one machine.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tickloom.plans.queries import comparable_queries  # noqa: E402
from tickloom.sources import samples  # noqa: E402

HEADLINE = (
    "clean_quotes",
    "decode_messages",
    "extract_quote_fields",
    "encode_quotes",
    "multiplex_messages",
    "sliding_stats",
    "sliding_stats_panes",
    "gen_signal",
    "consensus_signal",
    "interpolate_signal",
    "interpolate_signal_segmented",
    "retain_recent",
    "latest_quote",
    "feature_snapshot",
    "training_set",
    "training_set_segmented",
    "grouped_ols",
    "backtest",
    "backtest_segmented",
    "trade_markers",
    "train_elastic_net",
    "score_elastic_net",
)
STREAMS = ("stream_clean_quotes", "stream_gen_signal", "stream_gen_signal_panes")


def session(cpus: str) -> SparkSession:
    built = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickloom-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    return built


def laid_out(spark: SparkSession, folder: str, cpus: str) -> str:
    """The tables the queries read, as several files each."""
    place = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in ("events", "orders", "pages"):
        spread = samples.table(spark, folder, name).repartition(int(cpus) if cpus.isdigit() else 8)
        spread.write.parquet(f"{place}/{name}.parquet")
    return place


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or [*HEADLINE, *STREAMS]
    spark = session(cpus)
    queries = comparable_queries()
    scale, folder = folder.rstrip("/").rsplit("sf", 1)[-1], laid_out(spark, folder, cpus)
    seconds = {}
    for name in chosen:
        repeats = 1 if name in STREAMS else runs
        if name not in STREAMS:
            timed(lambda: queries[name](spark, folder))
        seconds[name] = round(min(timed(lambda: queries[name](spark, folder)) for _ in range(repeats)), 3)
    quotes = samples.table(spark, folder, "events").count()
    rates = {name: round(quotes / seconds[name]) for name in STREAMS if name in seconds}
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "stream_rows_per_sec": rates,
                "sf": scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
