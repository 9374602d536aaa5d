"""Ingest end to end: clean, set aside bad rows, merge, embed, index."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwellspark.functions.text import strip_whitespace
from dwellspark.operators.cleaning import clean_listings, split_rejects
from dwellspark.operators.embedding import Embedder, embed_listings
from dwellspark.operators.records import build_points
from dwellspark.operators.upsert import changed_listings, compare_batch, dedup_by_key, full_batch
from dwellspark.schema import KEY, LISTING
from dwellspark.session import cut_lineage, cuts_deleted
from dwellspark.sources.snapshots import ID_BLOCKS
from dwellspark.sources.store import Commit, commit, commits, compact, ensure_tables, new_load, read_table, write_load

# Fields whose text may not be readable as their type.
TYPED = ["price", "rooms", "size_sqm", "floor", "total_floors", "pets_allowed", "scraped_at"]
# Loads since the last base that a read has to put together; the load after so many makes a new base.
MOST_LOADS = 32
STATS = "inserted long, updated long, late long, duplicates long, errors long, unread_values long, total_listings long"


@dataclass(frozen=True)
class Load:
    """What an ingest wrote and set aside."""

    listings: DataFrame
    index: DataFrame
    rejects: DataFrame
    stats: DataFrame


def prepare(raw: DataFrame, cut: bool = False) -> tuple[DataFrame, DataFrame]:
    """Typed rows with ``unread``, how many of their values could not be read, and the rejected rows.

    ``source_order`` tells which of two rows is later; rows without one count in the order
    in which they come. With ``cut`` the feed is read and cleaned once, for both.
    """
    if "source_order" not in raw.columns:
        raw = raw.withColumn("source_order", F.monotonically_increasing_id())
    given = [name for name in TYPED if name in raw.columns]
    said = F.struct(*[(F.length(strip_whitespace(F.col(n).cast("string"))) > 0).alias(n) for n in given], F.lit(True).alias("_"))
    typed = raw.withColumn("_said", said)
    if "scraped_at" in raw.columns:
        typed = typed.withColumn("scraped_at", F.col("scraped_at").try_cast("timestamp"))
    cleaned = clean_listings(typed)
    good, rejects = split_rejects(cut_lineage(cleaned) if cut else cleaned)
    lost = [F.when(F.col(f"_said.{n}") & F.col(n).isNull(), 1).otherwise(0) for n in given]
    return good.withColumn("unread", sum(lost, F.lit(0))).drop("_said"), rejects.drop("_said", "source_order")


def points_of(listings: DataFrame, embedder: Embedder) -> DataFrame:
    """Index rows of listing rows."""
    return build_points(embed_listings(listings, embedder))


def _loaded(spark: SparkSession, root: str, known: list[Commit]) -> Load:
    last = known[-1]
    stats = spark.createDataFrame([last.stats or {}], STATS)
    rejects = spark.read.parquet(last.rejects)
    return Load(read_table(spark, root, "listings", known), read_table(spark, root, "index", known), rejects, stats)


def ingest(
    raw: DataFrame, root: str, embedder: Embedder, loaded_at: datetime, id_blocks: int = ID_BLOCKS, epoch: int | None = None,
    most_loads: int = MOST_LOADS,
) -> Load:
    """Loads a batch into the store under ``root`` and returns the tables as of this load.

    Of several rows with a key the latest counts, by ``scraped_at`` (a feed that has none is scraped at the
    load) and ``source_order``; the others are counted as duplicates, rejected rows as errors, and rows scraped before
    the stored ones, which change nothing, as late, all in ``stats``. Rejects are stored beside the
    load. The load costs the batch, its embedding, and a join with the table's keys; stored
    files stay as they are. The index rows are derived from the stored listing rows of the
    same load, and one commit makes both visible.

    ``id_blocks`` holds for a new store. An ``epoch`` not after the last one committed was
    loaded before: then nothing is done, so a stream may repeat it. After ``most_loads`` loads the
    store is compacted, so that reads stay bounded however many loads there are.
    """
    spark = raw.sparkSession
    ensure_tables(spark, root, id_blocks)
    known = commits(spark, root)
    last = known[-1]
    if epoch is not None and last.epoch is not None and epoch <= last.epoch:
        return _loaded(spark, root, known)
    made = replace(last, number=last.number + 1, folder=new_load(root, last.number + 1), base=False, epoch=last.epoch if epoch is None else epoch)
    with cuts_deleted(spark):
        good, rejects = prepare(raw, cut=True)
        made = replace(made, rejects=f"{made.folder}/rejects")
        rejects.write.parquet(made.rejects)
        own = F.col("scraped_at") if "scraped_at" in good.columns else F.lit(None).cast("timestamp")
        good = good.withColumn("scraped_at", F.coalesce(own, F.lit(loaded_at)))
        order = ["scraped_at", "source_order"]
        good = good.select(KEY, *[c for c in good.columns if c != KEY and c in {*LISTING.names, *order, "unread"}])
        # The row of a key that counts has its greatest time, so times are compared without whole rows.
        times = good.groupBy(KEY).agg(F.max("scraped_at").alias("scraped_at"))
        compared = compare_batch(read_table(spark, root, "listings", known), times, loaded_at, last.last_id)
        batch = full_batch(dedup_by_key(good, latest=order).drop("unread"), loaded_at)
        rows = changed_listings(compared, batch, loaded_at)
        rows = write_load(rows.drop("status"), made.folder, "listings", last.blocks)
        write_load(points_of(rows, embedder), made.folder, "index", last.blocks)
        sums = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("unread"), F.lit(0)).alias("unread")).first()
        of = lambda status: F.count_if(F.col("status") == status)
        keys, new, updated, late = compared.agg(F.count(F.lit(1)), of("inserted"), of("updated"), of("late")).first()
        errors = spark.read.parquet(made.rejects).count()
        last_id = rows.agg(F.max("id")).first()[0] or 0
    total = last.total + new
    stats = {
        "inserted": new, "updated": updated, "late": late, "duplicates": sums.n - keys, "errors": errors,
        "unread_values": sums.unread, "total_listings": total,
    }
    made = replace(made, last_id=max(last.last_id, last_id), total=total, stats=stats)
    commit(spark, root, made)
    known = [*known, made]
    if len(known) > most_loads:
        known = [compact(spark, root)]
    return _loaded(spark, root, known)
