"""Consecutive numbers over a whole table, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.session import cut_lineage


def number_rows(df: DataFrame, order: list[Column], name: str, start: Column | int = 0) -> DataFrame:
    """Adds ``name`` = ``start`` + 1, 2, … in the given total order.

    The rows are range-sorted and written once; then each gets its place in its partition
    plus the row counts of the partitions before. Only the counts, one row per partition,
    meet in one task and are broadcast.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_place", F.col("_at") - F.shiftleft(F.col("_part"), 33)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    number = F.col("_before") + F.col("_place") + 1 + start
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, number.cast("long"))
        .drop("_at", "_part", "_place", "_before")
    )
