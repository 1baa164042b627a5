from tickloom.schemas import RAW_FIELDS
from tickloom.sources.pages import LISTED_FIELDS, MARKET_ATTRIBUTES, SUMMARY_ATTRIBUTES, extract_quotes


def page(left_out=(), symbol_last=False, nested=False, ticker="T.X"):
    parts = ["<nav><li><a href='/'>home</a></li></nav>"]
    for name, mark in (MARKET_ATTRIBUTES | SUMMARY_ATTRIBUTES).items():
        for symbol, text in (("OTHER", "0"), (ticker, "" if name in left_out else name)):
            own = f'data-symbol="{symbol}"'
            attributes = f'class="a" {mark} {own} x="1"' if symbol_last else f'class="a" {own} {mark} x="1"'
            inner = f"<span><b> {text} </b></span>" if nested else text
            parts.append(f"<fin-streamer {attributes}>{inner}</fin-streamer>")
    names = {place: name for name, place in LISTED_FIELDS.items()}
    for place in range(1, 17):
        text = "" if names.get(place) in left_out else names.get(place, "n/a")
        inner = f"<fin-streamer active>{text}</fin-streamer>" if nested else text
        parts.append(f'<li class="b"><span>label</span> <span class="v">{inner}</span></li>')
    return "".join(parts)


def extract(spark, *pages, ticker="T.X"):
    frame = spark.createDataFrame([(ticker, i, html) for i, html in enumerate(pages)], "ticker_symbol STRING, i INT, html STRING")
    return extract_quotes(frame, keep=("i",)).orderBy("i").collect()


def test_fields_are_found_whatever_the_order_and_nesting(spark):
    for row in extract(spark, page(), page(symbol_last=True), page(nested=True), page(symbol_last=True, nested=True)):
        assert {name: row[name] for name in RAW_FIELDS} == {name: name for name in RAW_FIELDS}


def test_other_symbols_are_not_taken(spark):
    rows = extract(spark, page(), ticker="T")
    assert all(rows[0][name] is None for name in RAW_FIELDS)


def test_groups_come_whole_or_not_at_all(spark):
    market, summary = RAW_FIELDS[:3], RAW_FIELDS[3:]
    without_market, without_bid, empty, missing = extract(
        spark, page(left_out=("regular_market_change",)), page(left_out=("bid",)), "", None
    )
    assert all(without_market[name] is None for name in market) and without_market["eps"] == "eps"
    assert all(without_bid[name] is None for name in summary) and without_bid["regular_market_price"] is not None
    assert all(empty[name] is None and missing[name] is None for name in RAW_FIELDS)
