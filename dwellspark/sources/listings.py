"""Readers of raw listing feeds and of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dwellspark.schema import RAW


# How feeds are written; the same for files that are there and files that arrive. A file can be read in parts;
# a CSV feed with line ends inside its values needs the option multiLine, and then each file is one task.
FORMATS = {"csv": {"header": "true", "escape": '"'}, "json": {}}


def with_source_file(scan: DataFrame) -> DataFrame:
    """Adds the part of a file a row is in; right on the scan, of files that are there or arrive."""
    at = ["file_modification_time", "file_path", "file_block_start"]
    return scan.withColumn("source_order", F.struct(*[F.col(f"_metadata.{name}").alias(name) for name in at]))


def with_source_row(rows: DataFrame) -> DataFrame:
    """Completes the order: later files, and later rows of a file, are greater. Before any shuffle."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("source_order", F.struct("source_order.*", row.alias("row")))


def with_source_order(scan: DataFrame) -> DataFrame:
    return with_source_row(with_source_file(scan))


def read_listings(spark: SparkSession, path: str, form: str = "json", schema: T.StructType = RAW, **options: str) -> DataFrame:
    """Raw listings of a schema, with no inference, and their ``source_order``.

    JSON and CSV values are taken as text; other formats bring their types and are cast.
    Columns beyond the schema can be had by passing one; columns a feed lacks are NULL.
    """
    reader = spark.read.options(**FORMATS.get(form, {}) | options).format(form)
    if form in FORMATS:
        return with_source_order(reader.schema(schema).load(path))
    rows = with_source_order(reader.load(path))
    given = {field.name: F.col(field.name) if field.name in rows.columns else F.lit(None) for field in schema}
    return rows.select(*[value.cast(schema[name].dataType).alias(name) for name, value in given.items()], "source_order")


def scan_vectors(index: DataFrame, name: str, filter_columns: list[str] = []) -> DataFrame:
    """One named vector and only the payload fields asked for."""
    return index.select("id", name, *[f"payload.{column}" for column in filter_columns])
