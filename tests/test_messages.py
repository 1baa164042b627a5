import json

from tickloom.operators import messages as msg
from tickloom.schemas import CLEAN_TOPIC, OLS_TOPIC, QUOTE_MESSAGE, SIGNAL_TOPIC
from tickloom.sources.messages import BROKER_SEQUENCE, broker_options, decode_messages

SIGNALS = "ticker_symbol STRING, timestamp TIMESTAMP, regular_market_price DOUBLE, moving_avg_price DOUBLE, rsi DOUBLE, rsi_signal INT, mac_signal INT"


def signals(spark):
    rows = [("A", "2024-01-01 00:00:10", 1.0, 2.0, None, 0, 1), ("B", "2024-01-01 00:00:20", 3.0, 4.0, 50.0, 0, -1)]
    schema = SIGNALS.replace("timestamp TIMESTAMP", "timestamp STRING")
    frame = spark.createDataFrame(rows, schema)
    return frame.withColumn("timestamp", frame.timestamp.cast("timestamp"))


def test_signal_message_has_no_price_and_drops_nulls(spark):
    rows = [json.loads(row.value) for row in msg.encode_signals(signals(spark)).orderBy("key").collect()]
    assert rows[0] == {
        "timestamp": "2024-01-01T00:00:10.000Z", "moving_avg_price": 2.0, "mac_signal": 1, "rsi_signal": 0,
    }
    assert set(rows[1]) == {"timestamp", "moving_avg_price", "rsi", "mac_signal", "rsi_signal"}


def test_quote_message_fields(spark, sf_dir):
    from tickloom.operators.clean import clean_quotes
    from tickloom.sources import samples

    row = msg.encode_quotes(clean_quotes(samples.raw_quotes(spark, sf_dir))).first()
    assert set(json.loads(row.value)) <= set(QUOTE_MESSAGE) and set(json.loads(row.key)) == {"ticker_symbol"}


def test_topics(spark):
    rows = signals(spark)
    assert msg.encode_for_topic(rows, SIGNAL_TOPIC).columns == ["value", "key"]
    assert msg.encode_for_topic(rows, "any other").columns == rows.columns
    assert set(msg.TOPIC_FIELDS) == {CLEAN_TOPIC, SIGNAL_TOPIC, OLS_TOPIC}


def test_dispatch_by_shape(spark):
    values = ['{"regular_market_price": 1.0, "rsi_signal": 1}', '{"rsi_signal": 0}', '{"beta": 1.0}', "junk"]
    rows = spark.createDataFrame([(value,) for value in values], "value STRING")
    got = {row.value: row.kind for row in msg.dispatch(rows).collect()}
    assert got == {values[0]: "quote", values[1]: "signal"}


def test_broker_messages_decode_from_bytes(spark):
    frame = spark.createDataFrame(
        [(bytearray(b'{"ticker_symbol": "A"}'), bytearray(b'{"bid": "1 x 2"}'), 0, 7)],
        "key BINARY, value BINARY, partition INT, offset BIGINT",
    ).selectExpr("*", "timestamp'2024-01-01 00:00:00' AS timestamp")
    row = decode_messages(frame, BROKER_SEQUENCE).first()
    assert (row.ticker_symbol, row.bid, row.partition, row.offset) == ("A", "1 x 2", 0, 7)


def test_subscription_options():
    options = broker_options("host:9092")
    assert options["subscribe"] == "real-time-stock-data"
    assert options["startingOffsets"] == "latest" and options["failOnDataLoss"] == "false"


def test_json_parse_reads_only_what_is_asked_for(spark):
    from tickloom.operators.clean import clean_quotes

    messages = spark.createDataFrame([], "key STRING, value STRING, timestamp TIMESTAMP, event_id BIGINT")
    narrow = clean_quotes(decode_messages(messages), ("beta",)).select("beta")
    plan = narrow._jdf.queryExecution().analyzed().toString()
    assert "StructField(eps" in plan
    assert "StructField(eps" not in narrow._jdf.queryExecution().optimizedPlan().toString()
