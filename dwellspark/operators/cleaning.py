"""Cleaning and typing of raw listings: one narrow projection, no row dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dwellspark.functions.coerce import clean_flag, clean_price, clean_rooms, clean_size
from dwellspark.functions.text import clean_text
from dwellspark.schema import DATA_FIELDS, FLAG_FIELDS, KEY, LISTING, TEXT_FIELDS

NUMBERS = {"price": clean_price, "rooms": clean_rooms, "size_sqm": clean_size}


def clean_text_columns(df: DataFrame, names: list[str] = TEXT_FIELDS) -> DataFrame:
    """Cleans the text columns that exist. NULL stays NULL, white space alone becomes ``''``."""
    present = [name for name in names if name in df.columns]
    return df.withColumns(
        {name: F.when(F.col(name) != "", clean_text(F.col(name))).otherwise(F.col(name)) for name in present}
    )


def clean_listings(raw: DataFrame) -> DataFrame:
    """Text, numbers and flags of raw listings; other columns pass through untouched."""
    kinds = {field.name: field.dataType for field in raw.schema}
    typed = {name: clean(F.col(name), kinds[name]) for name, clean in NUMBERS.items() if name in kinds}
    typed |= {name: clean_flag(F.col(name), kinds[name]) for name in FLAG_FIELDS if name in kinds}
    return clean_text_columns(raw).withColumns(typed)


def reject_reason(require: list[str]) -> Column:
    """Why a cleaned row cannot be stored; NULL for a good row."""
    blank = {name: F.coalesce(F.trim(F.col(name)) == "", F.lit(True)) for name in require}
    rooms = F.col("rooms").cast("double")
    reason = F.lit(None).cast("string")
    reason = F.when(rooms.isNotNull() & rooms.try_cast(T.DecimalType(3, 1)).isNull(), F.lit("rooms out of range")).otherwise(reason)
    for name, is_blank in reversed(blank.items()):
        reason = F.when(is_blank, F.lit(f"blank {name}")).otherwise(reason)
    return reason


def to_table_types(cleaned: DataFrame, require: list[str] = [KEY, "description"]) -> DataFrame:
    """Cleaned rows in the types of the table, with the ``reason`` a row cannot be stored.

    Still one projection: a bad row is marked by itself and fails no other.
    """
    types = {name: LISTING[name].dataType for name in [KEY, *DATA_FIELDS]}
    absent = {name: F.lit(None).cast(kind) for name, kind in types.items() if name not in cleaned.columns}
    marked = cleaned.withColumns(absent).withColumn("reason", reject_reason(require))
    typed = {name: F.col(name).try_cast(kind) for name, kind in types.items()}
    typed |= {name: F.coalesce(typed[name], F.lit(False)) for name in FLAG_FIELDS}
    return marked.withColumns(typed)


def split_rejects(cleaned: DataFrame, require: list[str] = [KEY, "description"]) -> tuple[DataFrame, DataFrame]:
    """Rows fit for the table, and the others with their values as they came and a ``reason``."""
    good = to_table_types(cleaned, require).where("reason is null").drop("reason")
    absent = {name: F.lit(None).cast("string") for name in ["rooms", *require] if name not in cleaned.columns}
    bad = cleaned.withColumns(absent).withColumn("reason", reject_reason(require)).where("reason is not null")
    return good, bad
