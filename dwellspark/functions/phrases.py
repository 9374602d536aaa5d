"""The structured sentence of a listing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The words of the sentence. ``{}`` is where the value goes.
PHRASES = {
    "rooms": "{} חדרים",
    "has_parking": "עם חניה",
    "has_elevator": "עם מעלית",
    "furnished": "מרוהט",
    "has_balcony": "עם מרפסת",
    "has_storage": "עם מחסן",
    "price": "{} ש״ח",
    "size_sqm": "{} מ״ר",
    "ground": "קרקע",
    "below": "קומה {} למטה",
    "above": "קומה {}",
    "fallback": "דירה",
}


def plain_number(value: Column) -> Column:
    """``2.0`` prints as ``2``, ``3.5`` as ``3.5``."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def filled(template: str, value: Column) -> Column:
    head, tail = template.split("{}")
    return F.concat(F.lit(head), value.cast("string"), F.lit(tail))


def present(name: str) -> Column:
    """A text column with the empty string counted as missing."""
    return F.nullif(F.col(name), F.lit(""))


def structured_text(phrases: dict[str, str] = PHRASES) -> Column:
    """Comma-separated parts in fixed order; ``concat_ws`` skips the missing ones."""
    floor = F.col("floor")
    flags = [
        F.when(F.col(flag), F.lit(phrases[flag]))
        for flag in ("has_parking", "has_elevator", "furnished", "has_balcony", "has_storage")
    ]
    parts = F.concat_ws(
        ", ",
        filled(phrases["rooms"], plain_number(F.col("rooms"))),
        present("city"),
        F.coalesce(present("neighborhood"), present("location")),
        *flags,
        filled(phrases["price"], thousands(F.col("price"))),
        F.when(F.col("size_sqm") != 0, filled(phrases["size_sqm"], F.col("size_sqm"))),
        F.when(floor == 0, F.lit(phrases["ground"]))
        .when(floor < 0, filled(phrases["below"], F.abs(floor)))
        .when(floor > 0, filled(phrases["above"], floor)),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit(phrases["fallback"]))
