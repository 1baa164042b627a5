"""Work on tables that lie in one file, and on micro-batches, is dealt over tasks and done once."""

from pyspark.sql import functions as F

from tickloom.operators.clean import clean_quotes
from tickloom.session import fresh_folder, session_settings
from tickloom.sources import samples
from tickloom.streaming import live, service
from tickloom.streaming.history import HistoryTable


def test_history_goes_through_a_batch_once(spark):
    seen, schema = spark.sparkContext.accumulator(0), "event_id LONG, timestamp TIMESTAMP"

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(90).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_709_251_200) + F.col("id") * 3600).alias("timestamp"))
    rows = rows.unionByName(spark.createDataFrame([(90, None)], schema))
    table = HistoryTable(spark, fresh_folder(spark, "test"))
    table.write_batch(rows.mapInPandas(counted, schema), 0)
    assert seen.value == 91
    table.write_batch(spark.createDataFrame([], schema), 1)
    table.write_batch(rows.where("event_id is null"), 2)
    found = table.days("2024-01-01", "2024-12-31")
    assert found.count() == 90 and [row[0].isoformat() for row in found.select("date").distinct().orderBy("date").collect()] == [f"2024-03-0{day}" for day in range(1, 5)]


def test_quotes_of_one_file_are_dealt_over_tasks(spark, sf_dir):
    with session_settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        quotes = samples.raw_quotes(spark, sf_dir)
        tasks = quotes.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(tasks) == 4 and max(row["count"] for row in tasks) < 0.4 * quotes.count()


def test_prices_of_one_file_can_be_dealt_over_tasks(spark, sf_dir):
    with session_settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        prices = samples.prices(spark, sf_dir, spread=True)
        tasks = prices.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(tasks) == 4 and prices.exceptAll(samples.prices(spark, sf_dir)).isEmpty()


def test_live_dispatch_parses_a_message_once_for_its_kind(spark):
    values = ['{"regular_market_price":1.5}', '{"rsi_signal":1}', '{"other":1}', None]
    rows = spark.createDataFrame([(value,) for value in values], "value STRING").repartition(2)
    seen = {}

    class Target:
        def __init__(self, kind):
            self.kind = kind

        def write_batch(self, own, batch_id):
            plan = own._jdf.queryExecution().optimizedPlan().toString()
            seen[self.kind] = [row.value for row in own.collect()], plan.count("get_json_object(value")

    live.dispatch_to({kind: [Target(kind)] for kind in ("quote", "signal")})(rows, 0)
    assert {kind: found for kind, (found, _) in seen.items()} == {"quote": values[:1], "signal": values[1:2]}
    assert seen["quote"][1] == 2  # one for each kind; later plans show the stored rows' plan twice


def test_training_goes_through_its_rows_once(spark, sf_dir, monkeypatch):
    saved, original = [], service.training_set

    def asked_once(*given):
        found = original(*given)
        found.isEmpty = None
        return found

    class Store:
        def save(self, model, *version):
            saved.append(model)

    quotes = clean_quotes(samples.raw_quotes(spark, sf_dir))
    monkeypatch.setattr(service, "training_set", asked_once)
    service.train_on_batch(Store())(quotes, 0)
    service.train_on_batch(Store())(quotes.limit(0), 1)
    assert len(saved) == 1
    monkeypatch.undo()
    service.train_on_batch(Store(), missing="leave out")(quotes.limit(0), 2)
    assert len(saved) == 1
