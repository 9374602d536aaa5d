"""Merge of a batch into the listing table and the vector index."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.operators.numbering import number_rows
from dwellspark.schema import DATA_FIELDS, FLAG_FIELDS, KEY, LISTING
from dwellspark.session import cut_lineage


def require_key(batch: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, and the rest."""
    has_key = F.coalesce(F.length(key) > 0, F.lit(False))
    return batch.where(has_key), batch.where(~has_key)


def dedup_by_key(
    batch: DataFrame, key: str = KEY, latest: str | Sequence[str] = "scraped_at", mode: str = "last"
) -> DataFrame:
    """One row per key: the latest, and among equally late ones the greatest by its columns.

    The window cuts to one row per key and task before the shuffle, so a key that fills a
    third of the batch does not meet in one task. ``mode="error"`` raises on a second row.
    """
    latest = [latest] if isinstance(latest, str) else list(latest)
    others = [c for c in batch.columns if c != key and c not in latest]
    order = [F.col(c).desc_nulls_last() for c in [*latest, *others]]
    window = Window.partitionBy(key).orderBy(*order)
    if mode == "error":
        repeated = batch.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"duplicate key {repeated[0][0]!r}")
        return batch
    return batch.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def assign_ids(new: DataFrame, last_id: int, key: str = KEY) -> DataFrame:
    """Consecutive ids after ``last_id`` in key order, numbered in parallel."""
    return number_rows(new, [F.asc(key)], "id", last_id)


def last_id(target: DataFrame) -> int:
    """Greatest id in use; 0 for an empty table."""
    return target.agg(F.max("id")).first()[0] or 0


def touch(old: str, loaded_at: Column, changed: Column) -> Column:
    """``updated_at``: the load time for a row of the batch, else as it was."""
    return F.when(changed, loaded_at).otherwise(F.col(old))


def full_batch(batch: DataFrame, loaded_at: datetime) -> DataFrame:
    """Key, all data fields in the table's types, and ``scraped_at``; an absent flag is false, any other absent field NULL.

    A row says when it was scraped, or else counts as scraped at the load.
    """
    values = {name: F.col(name) if name in batch.columns else F.lit(None) for name in DATA_FIELDS}
    values |= {name: F.coalesce(values[name], F.lit(False)) for name in FLAG_FIELDS}
    own = F.col("scraped_at").cast("timestamp") if "scraped_at" in batch.columns else F.lit(None)
    values["scraped_at"] = F.coalesce(own, F.lit(loaded_at))
    return batch.select(KEY, *[value.cast(LISTING[name].dataType).alias(name) for name, value in values.items()])


def compare_batch(target: DataFrame, times: DataFrame, loaded_at: datetime, last: int) -> DataFrame:
    """What becomes of the rows of a batch: the columns of ``times``, ``id``, ``created_at`` and ``status``, written once.

    ``times`` has the key and ``scraped_at`` of each row, and what else tells rows apart. A late row was scraped before the
    one that the table has. At equal times the load counts, so that the same scrape can be corrected. New keys get
    the ids after ``last``. Only these columns are joined, numbered and written; how to join is left to Spark.
    """
    stored = target.select(KEY, "id", "created_at", F.col("scraped_at").alias("_stored"))
    status = F.when(F.col("id").isNull(), "inserted").when(F.col("scraped_at") < F.col("_stored"), "late").otherwise("updated")
    compared = cut_lineage(times.join(stored, KEY, "left").withColumn("status", status).drop("_stored"))
    new = assign_ids(compared.where("status = 'inserted'").drop("id"), last)
    new = new.withColumn("created_at", F.lit(loaded_at).cast(LISTING["created_at"].dataType))
    return cut_lineage(compared.where("status <> 'inserted'").unionByName(new))


def changed_listings(compared: DataFrame, batch: DataFrame, loaded_at: datetime, by: str = KEY) -> DataFrame:
    """The rows that a compared batch changes or adds, with their ``status``; ``by`` tells its rows apart.

    Known keys keep id and created_at and take the batch's data, whole; late rows change nothing. The only
    step of a load that joins whole rows.
    """
    decided = compared.where("status <> 'late'").select(by, "id", "created_at", "status")
    rows = batch.join(decided, by).withColumn("updated_at", F.lit(loaded_at))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in LISTING], "status")


def upsert_listings(target: DataFrame, batch: DataFrame, loaded_at: datetime) -> DataFrame:
    """The table after the load, with a ``status`` per row: inserted, updated or kept.

    ``batch`` should have one row per key; of rows that share one, or have none, each counts for itself. A key keeps the row
    that was scraped last, so loads may come in any order. The store does not rewrite the table like this: it takes
    only the changed rows (see ``ingest``). What changes is compared and numbered at once; the rows are put
    together when the result is read.
    """
    by, whole = KEY, full_batch(batch, loaded_at)
    if not whole.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col(KEY).isNull() | (F.col("n") > 1)).isEmpty():
        by, whole = "_row", cut_lineage(whole.withColumn("_row", F.monotonically_increasing_id()))
    compared = compare_batch(target, whole.select(*{KEY: 0, by: 0}, "scraped_at"), loaded_at, last_id(target))
    kept = target.join(compared.where("status = 'updated'").select("id"), "id", "left_anti").select(*LISTING.names)
    return kept.withColumn("status", F.lit("kept")).unionByName(changed_listings(compared, whole, loaded_at, by))


def ids_of_keys(batch: DataFrame, listings: DataFrame) -> DataFrame:
    """The batch with the id each key has in the table; only keys and ids are read there."""
    return listings.select(KEY, "id").join(batch, KEY)


def upsert_vectors(index: DataFrame, points: DataFrame) -> DataFrame:
    """The index with every given point put in, in place of the one of that id; only ids are compared."""
    return index.join(points.select("id"), "id", "left_anti").unionByName(points)


def load_stats(loaded: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Counts of one load: inserted, updated, errors, total_listings."""
    counts = loaded.agg(
        F.count_if(F.col("status") == "inserted").alias("inserted"),
        F.count_if(F.col("status") == "updated").alias("updated"),
        F.lit(0).cast("long").alias("errors"),
        F.count(F.lit(1)).alias("total_listings"),
    )
    if rejects is None:
        return counts
    zero = F.lit(0).cast("long")
    bad = rejects.agg(F.count(F.lit(1)).alias("errors")).select(
        zero.alias("inserted"), zero.alias("updated"), "errors", zero.alias("total_listings")
    )
    return counts.unionByName(bad).agg(*[F.sum(c).alias(c) for c in counts.columns])


def vector_stats(points: DataFrame) -> DataFrame:
    """Counts of an index load: points with both vectors, and the others."""
    whole = F.col("structured").isNotNull() & F.col("description").isNotNull()
    return points.agg(F.count_if(whole).alias("loaded"), F.count_if(~whole).alias("errors"))
