"""Places and running totals within a key, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.session import cut_lineage


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None) -> DataFrame:
    """Adds ``place`` (from 0, in ``order``, NULL first) within ``key`` and, under new names, totals of columns up to and with the row.

    Rows are range-sorted by key and order and written with the number of their part, so a key
    with very many rows is dealt over parts. Windows run inside (key, part). What a key has in
    earlier parts comes from one row per key and part; keys that lie in several parts are at most
    one a border, so the rows that are broadcast are at most twice the parts. ``order`` has to be
    total but for rows that are equal.
    """
    sums, xors = sums or {}, xors or {}
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    dealt = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals: dict[str, Column] = {"place": F.count(F.lit(1))}
    totals |= {to: F.sum(name) for to, name in sums.items()}
    totals |= {to: F.bit_xor(name) for to, name in xors.items()}
    joined = lambda to, a, b: a.bitwiseXOR(b) if to in xors else a + b
    local = dealt.select("*", *[F.coalesce(total.over(inside), F.lit(0)).alias(to) for to, total in totals.items()])

    parts = dealt.groupBy(F.col(key).alias("_key"), "_part").agg(*[F.coalesce(total, F.lit(0)).alias(to) for to, total in totals.items()])
    parts = parts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_part", *totals))).alias("_parts")).filter(F.size("_parts") > 1)
    none = F.struct(*[F.lit(0).cast("long").alias(to) for to in totals])
    before = F.transform(
        "_parts",
        lambda part, at: F.struct(
            part["_part"].alias("_in"),
            F.aggregate(
                F.slice("_parts", F.lit(1), at),
                none,
                lambda had, one: F.struct(*[joined(to, had[to], one[to]).alias(to) for to in totals]),
            ).alias("_had"),
        ),
    )
    carried = F.broadcast(parts.select("_key", F.inline(before)))
    found = local.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in")), "left")
    made = {to: joined(to, F.col(to), F.coalesce(F.col("_had")[to], F.lit(0))) for to in totals}
    made["place"] = made["place"] - 1
    return found.select(*df.columns, *[value.cast("long").alias(to) for to, value in made.items()])
