"""Typing of loose listing values.

A failed conversion gives NULL and never raises. "Falsy" values (NULL, empty, zero) pass
through unconverted; an empty string in a numeric column is NULL, as the column cannot hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from dwellspark.functions.text import strip_whitespace

# The marks removed from a price before it is read as a whole number.
PRICE_MARKS = [",", "ש״ח"]

_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL = r"(?i)^([+-]?(nan|inf|infinity))$"


def clean_price(price: Column, kind: T.DataType) -> Column:
    """Whole number after dropping thousands commas and the currency word."""
    if isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return price.try_cast("int")
    if isinstance(kind, T.StringType):
        for mark in PRICE_MARKS:
            price = F.replace(price, F.lit(mark), F.lit(""))
        return strip_whitespace(price).try_cast("int")
    # A fractional number prints with a point, which is no whole number; zero passes.
    return F.when(price == 0, F.lit(0))


def clean_rooms(rooms: Column, kind: T.DataType) -> Column:
    """Floating number; ``nan`` and ``inf`` parse too and are rejected by the table later."""
    if not isinstance(kind, T.StringType):
        return rooms.cast("double")
    bare = strip_whitespace(rooms)
    return F.when(bare.rlike(_FLOAT) | bare.rlike(_SPECIAL), bare.try_cast("double"))


def clean_size(size: Column, kind: T.DataType) -> Column:
    """Whole number; a fractional number is cut, a fractional text fails."""
    return (strip_whitespace(size) if isinstance(kind, T.StringType) else size).try_cast("int")


def clean_flag(flag: Column, kind: T.DataType) -> Column:
    """NULL is false, else truthiness: any non-empty text is true, even ``'false'``."""
    if isinstance(kind, T.StringType):
        flag = F.length(flag) > 0
    elif not isinstance(kind, T.BooleanType):
        flag = flag != 0
    return F.coalesce(flag, F.lit(False))
