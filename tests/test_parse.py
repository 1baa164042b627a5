import pytest

from tickloom.functions import parse
from tickloom.operators.clean import clean_quotes
from tickloom.schemas import CLEAN_FIELDS, CLEAN_TYPES, RAW_FIELDS
from tickloom.sources.messages import decode_messages

CASES = {
    parse.grouped_double: [("1,234.50", 1234.5), ("--", None), (None, None), ("", None), ("1,234,567", 1234567.0)],
    parse.signed_double: [("+1.25", 1.25), ("-0.5", -0.5), ("1,234.5", None), (None, None)],
    parse.percent_points: [("(+0.52%)", 0.52), ("(-1.10%)", -1.1), ("--", None), (None, None)],
    parse.pair_price: [
        ("173.20 x 1000", 173.2), ("1,173.20 x 1,000", 1173.2), ("--", 0.0), ("5.0", 5.0), (None, None), ("", None),
    ],
    parse.pair_size: [
        ("173.20 x 1000", 1000), ("1,173.20 x 1,000", 1000), ("--", 0), ("5.0", None), (None, None), ("5 x 10.0", 10),
    ],
    parse.grouped_long: [("12,345,678", 12345678), ("--", None), (None, None), ("12,345.9", 12345), ("1e3", None)],
    parse.magnitude_mantissa: [
        ("2.1T", 2.1), ("950.5B", 950.5), ("12.0M", 12.0), ("7K", 7.0), ("123", 123.0), ("--", None), (None, None),
    ],
    parse.magnitude_code: [("2.1T", 4), ("950.5B", 3), ("12.0M", 2), ("7K", 1), ("123", 0), ("--", 0), (None, 0), ("", 0)],
    parse.dash_zero_double: [("1.2", 1.2), ("--", 0.0), ("-0.5", -0.5), ("1,200.0", None), (None, None)],
    parse.grouped_or_dash_zero: [("1,234.5", 1234.5), ("--", 0.0), (None, None), ("junk", None)],
}


@pytest.mark.parametrize("function", CASES, ids=lambda function: function.__name__)
def test_literal_cases(spark, function):
    cases = CASES[function]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i INT, text STRING")
    got = [row.value for row in rows.select("i", function(rows.text).alias("value")).orderBy("i").collect()]
    assert got == [expected for _, expected in cases]


def test_ansi_mode_is_on(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_missing_keys_and_malformed_json_give_nulls(spark):
    messages = spark.createDataFrame(
        [('{"ticker_symbol": "A"}', '{"beta": "1.5", "other": 1}', 1), ("junk", "junk", 2), (None, None, 3)],
        "key STRING, value STRING, event_id BIGINT",
    ).selectExpr("*", "timestamp'2024-01-01 00:00:00' AS timestamp")
    rows = clean_quotes(decode_messages(messages)).orderBy("event_id").collect()
    assert [row.ticker_symbol for row in rows] == ["A", None, None]
    assert [row.beta for row in rows] == [1.5, None, None]
    for row in rows:
        empty = set(CLEAN_FIELDS) - {"beta", "market_cap_type"}
        assert all(row[name] is None for name in empty) and row.market_cap_type == 0


def test_clean_quote_has_declared_types(spark):
    raw = spark.createDataFrame([], ", ".join(f"`{name}` STRING" for name in ("ticker_symbol", *RAW_FIELDS)))
    cleaned = clean_quotes(raw)
    assert dict(cleaned.dtypes) == {"ticker_symbol": "string", **CLEAN_TYPES}


def test_cleaning_is_one_projection_without_shuffle(spark, sf_dir):
    from tickloom.sources import samples

    plan = clean_quotes(samples.raw_quotes(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
