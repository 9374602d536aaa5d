"""The listing tables: field names, types and fixed field lists."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and order of the listing record.
TEXT_FIELDS = ["title", "description", "location", "neighborhood", "city"]
FLAG_FIELDS = ["has_parking", "has_elevator", "has_balcony", "has_storage", "furnished"]
DATA_FIELDS = [
    "title", "description", "price", "rooms", "size_sqm", "location", "city", "neighborhood",
    "floor", "total_floors", "has_parking", "has_elevator", "has_balcony", "has_storage",
    "furnished", "pets_allowed",
]
TIME_FIELDS = ["created_at", "updated_at", "scraped_at"]

KEY = "external_id"
# Fixed value: the hits of a request that names no limit.
DEFAULT_LIMIT = 10
VECTOR_NAMES = ["structured", "description"]

LISTING = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("external_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType(), False),
        T.StructField("price", T.IntegerType()),
        T.StructField("rooms", T.DecimalType(3, 1)),
        T.StructField("size_sqm", T.IntegerType()),
        T.StructField("location", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("neighborhood", T.StringType()),
        T.StructField("floor", T.IntegerType()),
        T.StructField("total_floors", T.IntegerType()),
        *[T.StructField(flag, T.BooleanType()) for flag in FLAG_FIELDS],
        T.StructField("pets_allowed", T.BooleanType()),
        *[T.StructField(name, T.TimestampType()) for name in TIME_FIELDS],
    ]
)

# Raw feeds are read loosely: every scalar as text, typed later by the cleaner.
RAW = T.StructType([T.StructField(name, T.StringType()) for name in [KEY, *DATA_FIELDS, "scraped_at"]])

PAYLOAD = T.StructType(
    [
        T.StructField("listing_id", T.LongType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("price", T.IntegerType()),
        T.StructField("rooms", T.DoubleType()),
        T.StructField("size_sqm", T.IntegerType()),
        T.StructField("floor", T.IntegerType()),
        T.StructField("total_floors", T.IntegerType()),
        T.StructField("city", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("neighborhood", T.StringType()),
        *[T.StructField(flag, T.BooleanType()) for flag in FLAG_FIELDS],
        T.StructField("pets_allowed", T.BooleanType()),
    ]
)

VECTOR = T.ArrayType(T.FloatType())

INDEX = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("structured", VECTOR),
        T.StructField("description", VECTOR),
        T.StructField("payload", PAYLOAD),
    ]
)

REQUEST_FILTERS = T.StructType(
    [
        T.StructField("price_min", T.IntegerType()),
        T.StructField("price_max", T.IntegerType()),
        T.StructField("rooms_min", T.DoubleType()),
        T.StructField("rooms_max", T.DoubleType()),
        T.StructField("city", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("has_parking", T.BooleanType()),
        T.StructField("has_elevator", T.BooleanType()),
        T.StructField("furnished", T.BooleanType()),
    ]
)
REQUEST = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("query", T.StringType()),
        T.StructField("limit", T.IntegerType()),
        *REQUEST_FILTERS.fields,
    ]
)
