"""Rows for hits, ranks, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from dwellspark.functions.text import preview
from dwellspark.operators.records import project_response
from dwellspark.sources.snapshots import id_block, stored_blocks

# The most hits that are sent to every task beside a listing scan: 16 bytes of keys,
# 8 of score and 4 of rank each, so some tens of MB.
BROADCAST_HITS = 500_000


def fetch_by_ids(listings: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Rows of an id list in its order; ids without a row are dropped.

    The list reaches the Parquet scan. It is a result page, so it is short.
    """
    ids = [int(i) for i in ids]
    found = listings.where(F.col("id").isin(ids))
    return found.orderBy(F.array_position(F.lit(ids) if ids else F.array().cast("array<bigint>"), F.col("id")))


def fetch_hits(listings: DataFrame, hits: DataFrame, bounded: bool) -> DataFrame:
    """Hits joined with their rows; ids without a row are dropped.

    ``bounded`` hits are broadcast, so the listing table is not shuffled; if it is laid out
    by ``id_block``, only the blocks that hold hits are read (dynamic partition pruning).
    How many blocks there are is read from the stored table; a table that doesn't say is
    joined by id alone.
    """
    keys, blocks = ["id"], stored_blocks(listings)
    if blocks:
        keys.append("id_block")
        hits = hits.withColumn("id_block", id_block(F.col("id"), blocks))
    return listings.join(F.broadcast(hits) if bounded else hits, keys)


def assign_rank(rows: DataFrame) -> DataFrame:
    """Rank 1..n per query over the rows that were found, and their number."""
    group = Window.partitionBy("query_id")
    return rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("score"), F.asc("id")))).withColumn(
        "total_results", F.count(F.lit(1)).over(group)
    )


def respond(rows: DataFrame) -> DataFrame:
    """Search results: one row per query and rank with the listing nested."""
    return rows.select("query_id", "rank", "score", "total_results", project_response().alias("listing"))


def with_preview(hits: DataFrame, texts: DataFrame, length: int = 60) -> DataFrame:
    """Adds the beginning of the description to every hit."""
    return hits.join(texts.select("id", preview(F.col("description"), length).alias("preview")), "id")
