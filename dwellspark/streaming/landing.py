"""Incremental ingest: files that arrive in a landing folder go through the batch flow."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from dwellspark.operators.embedding import Embedder
from dwellspark.plans.ingest import ingest
from dwellspark.schema import RAW
from dwellspark.sources.listings import FORMATS, with_source_file, with_source_row
from dwellspark.streaming.dedup import drop_redelivered


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def stream_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    embedder: Embedder,
    checkpoint: str,
    schema: T.StructType = RAW,
    form: str = "json",
    files_per_load: int = 1000,
    clock: Callable[[], datetime] = utc_now,
    remember: str | None = None,
    **options: str,
) -> StreamingQuery:
    """Loads what has arrived and stops.

    The newest row per key is held by the store. With ``remember`` (as ``"7 days"``) rows that were delivered
    before within that time are dropped by keyed state, before they are compared, embedded and written again; the
    tables are the same. A load is committed together with its epoch: one repeated after a failure is
    either done as if for the first time, or found committed and left out. A store is fed
    by one stream, with one ``checkpoint``; files are read as ``read_listings`` does.
    """

    def load(batch: DataFrame, epoch: int) -> None:
        ingest(with_source_row(batch), root, embedder, clock(), epoch=epoch)

    files = spark.readStream.schema(schema).options(**FORMATS.get(form, {}) | options).option("maxFilesPerTrigger", files_per_load)
    rows = with_source_file(files.format(form).load(landing))
    return (
        (drop_redelivered(rows, remember) if remember else rows)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
