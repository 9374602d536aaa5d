"""Shapes of a listing: index payload, point, plain record, response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.functions.phrases import present
from dwellspark.schema import DATA_FIELDS, FLAG_FIELDS, KEY, LISTING, PAYLOAD, TIME_FIELDS

RESPONSE_FIELDS = ["id", KEY, *DATA_FIELDS, *TIME_FIELDS]


def build_payload() -> Column:
    """The filterable fields of a listing; a NULL field stands for an absent key.

    Flags are always there, false by default; whether pets are allowed may stay unknown.
    """
    texts = {"city", "location", "neighborhood"}
    fields = []
    for field in PAYLOAD:
        if field.name in texts:
            value = present(field.name)
        elif field.name in FLAG_FIELDS:
            value = F.coalesce(F.col(field.name), F.lit(False))
        else:
            value = F.col("id" if field.name == "listing_id" else field.name)
        fields.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*fields)


def payload_json() -> Column:
    """The payload as JSON text, absent keys left out."""
    return F.to_json(build_payload())


def build_points(embedded: DataFrame) -> DataFrame:
    """Rows of the vector index: id, both unit vectors, payload."""
    return embedded.select(
        "id",
        F.col("structured_vector").alias("structured"),
        F.col("description_vector").alias("description"),
        build_payload().alias("payload"),
    )


def nested_point() -> Column:
    """An index row as one ``{id, vector: {structured, description}, payload}`` value."""
    return F.struct("id", F.struct("structured", "description").alias("vector"), "payload")


def listing_to_record(listings: DataFrame) -> DataFrame:
    """Plain export record: rooms as a float (zero becomes NULL), times as ISO texts."""
    # Fixed value: the ISO format of a time with its zone offset, a fraction only where there is one.
    changed = {"rooms": F.nullif(F.col("rooms").cast("double"), F.lit(0.0))}
    for name in TIME_FIELDS:
        micros = F.nullif(F.date_format(name, ".SSSSSS"), F.lit(".000000"))
        changed[name] = F.concat(
            F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(micros, F.lit("")), F.date_format(name, "xxx")
        )
    return listings.select(*[changed.get(name, F.col(name)).alias(name) for name in LISTING.names])


def project_response() -> Column:
    """The listing part of a search result."""
    return F.struct(
        *[(F.col(name).cast("double") if name == "rooms" else F.col(name)).alias(name) for name in RESPONSE_FIELDS]
    )
