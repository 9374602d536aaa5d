"""Texts of a result card."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dwellspark.functions.phrases import filled, plain_number, present, thousands

# The words on the card.
UNKNOWN = "לא צוין"
NO_TITLE = "ללא כותרת"
YES = "כן"
NO = "לא"
CURRENCY = "₪{}"
SIZE = "{} מ²"
FLOOR = "קומה {}"
TOTAL_FLOORS = "מתוך {} קומות"
FEATURES = {
    "has_parking": "🚗 חניה",
    "has_elevator": "🛗 מעלית",
    "has_balcony": "🌳 מרפסת",
    "has_storage": "📦 מחסן",
    "furnished": "🛋️ מרוהט",
    "pets_allowed": "🐾 חיות מחמד",
}


def format_price(price: Column) -> Column:
    return F.coalesce(filled(CURRENCY, thousands(price)), F.lit(UNKNOWN))


def format_rooms(rooms: Column) -> Column:
    return F.coalesce(plain_number(rooms), F.lit(UNKNOWN))


def format_size(size: Column) -> Column:
    return F.coalesce(F.when(size != 0, filled(SIZE, size)), F.lit(UNKNOWN))


def format_flag(flag: Column) -> Column:
    return F.when(flag.isNull(), F.lit(UNKNOWN)).when(flag, F.lit(YES)).otherwise(F.lit(NO))


def place_line() -> Column:
    return F.concat_ws(", ", present("city"), present("location"), present("neighborhood"))


def floor_line() -> Column:
    return F.concat_ws(", ", filled(FLOOR, F.col("floor")), filled(TOTAL_FLOORS, F.col("total_floors")))


def feature_line() -> Column:
    return F.concat_ws(" | ", *[F.when(F.col(flag), F.lit(label)) for flag, label in FEATURES.items()])


def score_percent(score: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(score * 100, digits), F.lit("%"))


def card_title(rank: Column, title: Column, score: Column) -> Column:
    """Heading of a card: rank, title and the similarity in percent."""
    return F.concat(
        F.lit("#"), rank.cast("string"), F.lit(" - "), F.coalesce(title, F.lit(NO_TITLE)),
        F.lit(" | דמיון: "), score_percent(score),
    )
