"""Rows of a stream that were delivered before, by keyed state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dwellspark.schema import KEY


def drop_redelivered(rows: DataFrame, remember: str, version: Sequence[str] = (KEY, "scraped_at"), beside: Sequence[str] = ("source_order",)) -> DataFrame:
    """A stream without the rows whose version, with the same content, came within ``remember`` before.

    The state has a version and a 128-bit hash of its content for ``remember`` after its arrival. The
    watermark is on the arrival, the time of the micro-batch, so however old a row's own time is, it
    is never late and never dropped for that; a version that comes again later than ``remember`` passes and
    is left to the merge, which keeps the newest. Rows whose version is not known whole (NULL) all pass.
    ``beside`` names columns that are not content, as where the row was read.
    """
    whole = F.lit(True)
    for name in version:
        whole = whole & F.col(name).isNotNull()
    content = [F.col(c) for c in rows.columns if c not in beside]
    marked = rows.where(whole).withColumns({
        "_arrived": F.current_timestamp(), "_h1": F.xxhash64(F.to_json(F.struct(*content))), "_h2": F.xxhash64(F.lit("second"), F.to_json(F.struct(*content))),
    })
    first = marked.withWatermark("_arrived", remember).dropDuplicatesWithinWatermark([*version, "_h1", "_h2"])
    return first.drop("_arrived", "_h1", "_h2").unionByName(rows.where(~whole))
