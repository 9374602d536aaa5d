"""Values over time: validity intervals, and what was valid at a time, by one sorted pass; keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.session import cut_lineage


def last_known(
    df: DataFrame, key: str, order: Sequence[str], value: Column, name: str, inclusive: bool = True, reverse: bool = False
) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not NULL among the rows of the key up to this one, or before it.

    ``reverse`` looks at the rows after it. Rows are range-sorted by key and order and written with the
    number of their part, so a key with very many rows is dealt over parts. Windows run inside (key, part).
    What earlier parts of a key end with comes from a row per key and part; a key that lies in
    several parts is at a border, so at most twice as many rows as there are parts are broadcast.
    """
    by = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    dealt = df.withColumn("_value", value).repartitionByRange(F.col(key), *by).sortWithinPartitions(F.col(key), *by)
    dealt = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(key, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    known = F.when(F.col("_value").isNotNull(), F.struct(*order))
    end = (F.min_by if reverse else F.max_by)("_value", known)
    parts = dealt.groupBy(F.col(key).alias("_key"), "_part").agg(end.alias("_end"))
    parts = parts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_part", "_end"))).alias("_parts")).where(F.size("_parts") > 1)
    before = F.transform(
        "_parts",
        lambda part, at: F.struct(
            part["_part"].alias("_in"),
            F.get(F.reverse(F.filter(F.slice("_parts", F.lit(1), at), lambda one: one["_end"].isNotNull())), F.lit(0))["_end"].alias("_had"),
        ),
    )
    carried = F.broadcast(parts.select("_key", F.inline(before)))
    local = dealt.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    found = local.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in")), "left")
    return found.select(*df.columns, F.coalesce("_local", "_had").alias(name))


def validity(observations: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``key, value, valid_from, valid_to``: the times over which a key had a value, from single observations.

    An observation opens an interval if its value differs from that of the one before (NULL is a value too);
    ``valid_to`` is where the next one opens, NULL for the last. Of several observations at one time the greatest
    value counts. Rows without key or time are left out.
    """
    seen = observations.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(value).alias(value))
    told = last_known(seen, key, [time], F.struct(value), "_before", inclusive=False)
    changed = told.where(F.col("_before").isNull() | ~F.col(f"_before.{value}").eqNullSafe(F.col(value))).drop("_before")
    closed = last_known(changed, key, [time], F.col(time), "valid_to", inclusive=False, reverse=True)
    return closed.select(key, value, F.col(time).alias("valid_from"), "valid_to")


def as_of(probes: DataFrame, observations: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """The probes with the ``columns`` of their key's latest observation that is not after them; NULL if there is none.

    A join by a sorted union: observations and probes of a key stand in one order of time, and each probe takes what
    was observed last. Nothing is compared pairwise. Of observations at one time the greatest by
    ``columns`` counts. A probe without key or time finds nothing and stays.
    """
    rest = [c for c in probes.columns if c not in (key, time)]
    asked = probes.select(key, time, F.lit(1).alias("_kind"), F.struct(*rest, F.lit(True).alias("_asked")).alias("_probe"))
    known = observations.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        key, time, F.lit(0).alias("_kind"), F.struct(*columns).alias("_seen")
    )
    both = asked.unionByName(known, allowMissingColumns=True)
    found = last_known(both, key, [time, "_kind", "_seen"], F.col("_seen"), "_last").where("_kind = 1")
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    return found.select(
        key, time, *[F.col("_probe")[c].alias(c) for c in rest], *[F.when(usable, F.col("_last")[c]).alias(c) for c in columns]
    )
