"""Single tables as Parquet snapshots: each write makes a new version beside the old one.

A version counts once its writer has committed (``_SUCCESS``), so a reader never sees half
a load and the folder being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dwellspark.operators.embedding import dimensions
from dwellspark.schema import VECTOR_NAMES

# Folders of a listing table laid out by id, so that a result page reads few of them.
ID_BLOCKS = 64


def id_block(listing_id: Column, blocks: int = ID_BLOCKS) -> Column:
    return F.pmod(listing_id, F.lit(blocks)).cast("int")


def with_blocks(listings: DataFrame, blocks: int) -> DataFrame:
    """The table with its number of blocks noted on the id column, where Parquet keeps it."""
    return listings.withMetadata("id", {"id_blocks": blocks})


def stored_blocks(listings: DataFrame) -> int | None:
    """The number of id blocks a table was written with, if it says."""
    if not {"id", "id_block"} <= set(listings.columns):
        return None
    return listings.schema["id"].metadata.get("id_blocks")


def hadoop_folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, hadoop


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions of a table, ascending."""
    files, target, hadoop = hadoop_folder(spark, path)
    if not files.exists(target):
        return []
    names = [status.getPath().getName() for status in files.listStatus(target)]
    numbers = sorted(int(name.split("=")[1]) for name in names if name.startswith("version="))
    return [n for n in numbers if files.exists(hadoop.Path(f"{path}/version={n}/_SUCCESS"))]


def scan_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest version of a table."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/version={found[-1]}")


def lay_out(df: DataFrame, path: str, cluster: str | None = None, sort: list[str] = [], folders: bool = False) -> DataFrame:
    """Writes rows to a folder that must not exist, and returns them as read back.

    Rows of one ``cluster`` value go to the same files, and with ``folders`` to a folder of
    their own. The rebalance lets AQE split a value that fills many files and put small ones
    together. ``sort`` orders each file, so that Parquet's minima and maxima let a filter
    skip row groups.
    """
    if cluster:
        df = df.hint("rebalance", cluster)
    order = ([cluster] if cluster else []) + sort
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode("errorifexists")
    if folders and cluster:
        writer = writer.partitionBy(cluster)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def publish(df: DataFrame, path: str, **layout) -> DataFrame:
    """Writes a new version and returns it as read back; if another writer took its number, that is an error."""
    return lay_out(df, _next(df.sparkSession, path), **layout)


def _next(spark: SparkSession, path: str) -> str:
    return f"{path}/version={(versions(spark, path) or [0])[-1] + 1}"


def lay_out_listings(listings: DataFrame, path: str, blocks: int = ID_BLOCKS) -> DataFrame:
    """Listing rows laid out by id block."""
    rows = with_blocks(listings, blocks).withColumn("id_block", id_block(F.col("id"), blocks))
    return lay_out(rows, path, "id_block", ["id"], True)


def lay_out_index(index: DataFrame, path: str) -> DataFrame:
    """Vectors and payload, near each other by the most used filters."""
    clustered = index.withColumn("_city", F.col("payload.city"))
    return lay_out(clustered, path, "_city", ["payload.price", "payload.rooms"]).drop("_city")


def publish_listings(listings: DataFrame, path: str, blocks: int = ID_BLOCKS) -> DataFrame:
    return lay_out_listings(listings, _next(listings.sparkSession, path), blocks)


def publish_index(index: DataFrame, path: str) -> DataFrame:
    return lay_out_index(index, _next(index.sparkSession, path))


def collection_info(index: DataFrame, name: str, dim: int) -> DataFrame:
    """Row count and dimensions of an index; green if every vector has the right size."""
    good = (F.min("min_dim") == dim) & (F.max("max_dim") == dim) & (F.sum("missing") == 0)
    return dimensions(index, list(VECTOR_NAMES)).agg(
        F.lit(name).alias("name"),
        F.max("max_dim").alias("vector_size"),
        F.max("points_count").alias("points_count"),
        F.when(good, F.lit("green")).otherwise(F.lit("yellow")).alias("status"),
    )
