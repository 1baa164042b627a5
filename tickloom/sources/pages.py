"""Raw quotes from the HTML of quote pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import RAW_FIELDS, TICKER

# The page attribute that marks each field.
MARKET_ATTRIBUTES = {
    "regular_market_price": 'data-testid="qsp-price"',
    "regular_market_change": 'data-field="regularMarketChange"',
    "regular_market_change_percent": 'data-testid="qsp-price-change-percent"',
}
SUMMARY_ATTRIBUTES = {
    "regular_market_previous_close": 'data-field="regularMarketPreviousClose"',
    "regular_market_open": 'data-field="regularMarketOpen"',
    "regular_market_volume": 'data-field="regularMarketVolume"',
    "average_volume": 'data-field="averageVolume"',
    "market_cap": 'data-field="marketCap"',
    "1y_target_est": 'data-field="targetMeanPrice"',
}
# Fields without an attribute, by their place in the page's list of label and value, from 1.
LISTED_FIELDS = {"bid": 3, "ask": 4, "beta": 10, "pe_ratio": 11, "eps": 12}

# A tag from its symbol on: symbol, later attributes, tags that open right behind it, text up to the next tag. Patterns
# that begin with fixed text of some length are found by skipping; quantifiers never give back what they took.
_TEXT = r'[^>]*+>(?:\s*+<[a-zA-Z][^>]*+>)*+'
_SYMBOL = r'data-symbol="([^"]*+"'
_TAGGED = _SYMBOL + _TEXT + "[^<]*+)"
# A list item of two spans; the text of the second one.
_LISTED = r"<li[^>]*+>\s*+<span[^>]*+>[^<]*+</span>\s*+<span[^>]*+>(?:\s*+<[a-zA-Z][^>]*+>)*+([^<]*+)<"


def _tagged_text(html: Column, attribute: str) -> Column:
    """Text of the page's first own tag with the attribute, empty or null where there is none.

    The symbol mostly comes before the other attributes. Where it does not, the page is searched once more.
    """
    text = F.regexp_extract(F.col("_tags"), attribute + _TEXT + "([^<]*+)", 1)
    symbol_last = F.regexp_extract_all(html, F.lit(attribute + "[^>]*?" + _TAGGED), F.lit(1))
    own = F.get(F.filter(symbol_last, lambda tag: F.startswith(tag, F.col("_own"))), F.lit(0))
    return F.when(text != "", text).otherwise(F.substring_index(own, ">", -1))


def _unless_blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _all_or_nothing(texts: dict[str, Column]) -> dict[str, Column]:
    """Each text where all texts of the group are there, else null."""
    complete = F.lit(True)
    for text in texts.values():
        complete = complete & text.isNotNull()
    return {name: F.when(complete, text) for name, text in texts.items()}


def extract_quotes(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw quote of each page: ``ticker_symbol``, the kept columns and the 14 text fields.

    Two patterns read the page, one for tagged texts and one for the list; the fields are then picked from the short
    texts these give. A page shows other symbols too, so tags must name the page's own. The market fields come all
    or not at all, and so do the summary fields.
    """
    page = F.col(html)
    arrays = pages.select(
        TICKER,
        *keep,
        page,
        F.concat(TICKER, F.lit('"')).alias("_own"),
        F.regexp_extract_all(page, F.lit(_TAGGED), F.lit(1)).alias("_tags"),
        F.regexp_extract_all(page, F.lit(_LISTED), F.lit(1)).alias("_items"),
    )
    own_tags = F.filter("_tags", lambda tag: F.startswith(tag, F.col("_own")))
    arrays = arrays.withColumn("_tags", F.array_join(own_tags, "</"))
    market = {name: _tagged_text(page, mark) for name, mark in MARKET_ATTRIBUTES.items()}
    summary = {name: _tagged_text(page, mark) for name, mark in SUMMARY_ATTRIBUTES.items()}
    summary |= {name: F.get("_items", F.lit(place - 1)) for name, place in LISTED_FIELDS.items()}
    found = arrays.select(TICKER, *keep, *[text.alias(name) for name, text in (market | summary).items()])
    texts = found.select(TICKER, *keep, *[_unless_blank(F.col(name)).alias(name) for name in market | summary])
    gated = _all_or_nothing({name: F.col(name) for name in market})
    gated |= _all_or_nothing({name: F.col(name) for name in summary})
    return texts.select(TICKER, *keep, *[gated[name].alias(name) for name in RAW_FIELDS])
