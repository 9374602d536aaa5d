"""Search filters as one pushable predicate.

Every condition is a plain comparison on a stored column, so Catalyst hands it to the
Parquet scan; also where the columns sit inside the ``payload`` struct.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

# Request parameter -> (listing column, comparison).
FILTERS = {
    "price_min": ("price", "ge"),
    "price_max": ("price", "le"),
    "rooms_min": ("rooms", "ge"),
    "rooms_max": ("rooms", "le"),
    "city": ("city", "eq"),
    "location": ("location", "eq"),
    "has_parking": ("has_parking", "flag"),
    "has_elevator": ("has_elevator", "flag"),
    "furnished": ("furnished", "flag"),
}
FILTER_COLUMNS = list(dict.fromkeys(column for column, _ in FILTERS.values()))


def filter_range(column: Column, low: Any = None, high: Any = None) -> Column | None:
    """Inclusive on both sides, either side optional; NULL never matches."""
    sides = []
    if low is not None:
        sides.append(column >= low)
    if high is not None:
        sides.append(column <= high)
    return reduce(Column.__and__, sides) if sides else None


def filter_eq(column: Column, value: str | None) -> Column | None:
    """Exact and case-sensitive; an empty value is no filter."""
    return column == value if value else None


def filter_flag(column: Column, value: bool | None) -> Column | None:
    """``False`` is a filter too, and an unknown flag counts as false."""
    if value is None:
        return None
    return column == F.lit(True) if value else (column == F.lit(False)) | column.isNull()


def drop_none_filters(parameters: Mapping[str, Any]) -> dict[str, Any] | None:
    """Only the parameters that were given; none at all is None."""
    return {name: value for name, value in parameters.items() if value is not None} or None


COMPARE = {
    "ge": lambda column, value: filter_range(column, low=value),
    "le": lambda column, value: filter_range(column, high=value),
    "eq": filter_eq,
    "flag": filter_flag,
}


def build_filter(parameters: Mapping[str, Any] | None, prefix: str = "") -> Column | None:
    """AND of all given conditions; None if there is nothing to filter by."""
    given = drop_none_filters(parameters or {}) or {}
    conditions = [
        COMPARE[kind](F.col(prefix + column), given[name])
        for name, (column, kind) in FILTERS.items()
        if name in given
    ]
    conditions = [c for c in conditions if c is not None]
    return reduce(Column.__and__, conditions) if conditions else None
