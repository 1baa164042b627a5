"""Turn the display text of a quote page into numbers.

Every function maps a text column to a number column with built-in expressions only. Text that is not a number
becomes null under ANSI mode as well, and null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASHES = "--"

# The magnitude letter at the end of a market cap and the code it is stored as.
MAGNITUDES = {"K": 1, "M": 2, "B": 3, "T": 4}


def _ungrouped(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def _zero_if_dashes(text: Column, otherwise: Column) -> Column:
    return F.when(text == DASHES, F.lit("0")).otherwise(otherwise)


def _whole(text: Column, kind: str) -> Column:
    """Whole number of the text; a fraction such as ``.0`` is dropped, where a plain ``try_cast`` gives null."""
    without_fraction = F.regexp_extract(text, r"^\s*([+-]?\d+)\.\d*\s*$", 1)
    return F.coalesce(text.try_cast(kind), without_fraction.try_cast(kind))


def grouped_double(text: Column) -> Column:
    """``1,234.50`` -> 1234.5"""
    return _ungrouped(text).try_cast("double")


def grouped_long(text: Column) -> Column:
    """``12,345,678`` -> 12345678"""
    return _whole(_ungrouped(text), "bigint")


def signed_double(text: Column) -> Column:
    """``+1.25`` -> 1.25; thousands separators are not accepted here."""
    return text.try_cast("double")


def percent_points(text: Column) -> Column:
    """``(+0.52%)`` -> 0.52"""
    return F.translate(text, "%()", "").try_cast("double")


def pair_price(text: Column) -> Column:
    """``173.20 x 1000`` -> 173.2, and ``--`` -> 0"""
    bare = _ungrouped(text)
    return _zero_if_dashes(bare, F.substring_index(bare, " x ", 1)).try_cast("double")


def pair_size(text: Column) -> Column:
    """``173.20 x 1000`` -> 1000, ``--`` -> 0, and null where the text has no size."""
    bare = _ungrouped(text)
    return _whole(_zero_if_dashes(bare, F.split_part(bare, F.lit(" x "), F.lit(2))), "int")


def magnitude_mantissa(text: Column) -> Column:
    """``2.1T`` -> 2.1"""
    return F.translate(text, "," + "".join(MAGNITUDES), "").try_cast("double")


def magnitude_code(text: Column) -> Column:
    """``2.1T`` -> 4; 0 where no known letter ends the text, also for null."""
    letter = F.right(text, F.lit(1))
    code = F.lit(0)
    for name, value in MAGNITUDES.items():
        code = F.when(letter == name, F.lit(value)).otherwise(code)
    return code


def dash_zero_double(text: Column) -> Column:
    """``1.2`` -> 1.2 and ``--`` -> 0; thousands separators are not accepted here."""
    return F.replace(text, F.lit(DASHES), F.lit("0")).try_cast("double")


def grouped_or_dash_zero(text: Column) -> Column:
    """``1,234.5`` -> 1234.5 and ``--`` -> 0"""
    return _zero_if_dashes(text, _ungrouped(text)).try_cast("double")
