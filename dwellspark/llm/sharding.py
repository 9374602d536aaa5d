"""Sharding by sampled splitters: shards of nearly equal bytes, ranges of a hashed key."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.llm.rows import column

#: Ranges for each shard. A shard's size can be off by about one range's.
RANGES = 64
#: Sampled keys for each range, on average. All are sorted on the driver: 8 x 64 x shards of 24 bytes.
SAMPLES = 8
#: A range is cut again, by a sample of its own, if it is over so many times the mean.
OVERFULL = 2.0


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (NULL: none) and 16 for the record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _key(text: Column, row_id: Column) -> Column:
    """Equal texts lie side by side; the id orders, and lets a splitter part, the copies of one text."""
    return F.struct(F.xxhash64(text).alias("h"), row_id.alias("id"))


def _chance(*of: Column) -> Column:
    """A number in [0, 1) fixed by the row, so that a task that runs again draws the same sample."""
    return F.pmod(F.xxhash64(F.lit("draw"), *of), F.lit(1 << 32)) / F.lit(float(1 << 32))


def _draw(rows: DataFrame, step: Column | float) -> DataFrame:
    """Rows drawn with chance size / ``step``, weighed so that each stands for the bytes it was drawn from."""
    step = F.lit(step) if isinstance(step, float) else step
    drawn = rows.filter(_chance("key.h", "key.id") * step < F.col("size"))
    return drawn.select("key.h", "key.id", F.greatest(F.col("size").cast("double"), step).alias("weight"))


def order(key) -> tuple:
    """Sorts (hash, id, …) as Spark sorts the struct: NULL ids first."""
    return key[0], key[1] is not None, key[1] if key[1] is not None else 0


def _cut(sample: list, step: float, whole: float) -> list[tuple]:
    """Keys at which the weight summed along the sorted sample passes a multiple of ``step``.

    A text with copies of no more than ``whole`` together is not parted: the cut goes before its first copy.
    """
    cuts, at, weights = [], 0.0, Counter()
    for h, _, weight in sample:
        weights[h] += weight
    for h, row_id, weight in sorted(sample, key=order):
        if (at + weight) // step > at // step:
            cuts.append((h, row_id if weights[h] > whole else None))
        at += weight
    return sorted(set(cuts), key=order)


def _range_of(key: Column, cuts: list[tuple], id_type: str) -> Column:
    """How many cuts are not above the key: a binary search as one fold, a step for each power of two."""
    if not cuts:
        return F.lit(0)
    written = json.dumps([{"h": h, "id": row_id} for h, row_id in cuts])
    array, most = F.from_json(F.lit(written), f"array<struct<h:bigint,id:{id_type}>>"), F.lit(len(cuts))
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def step(at: Column, by: Column) -> Column:
        reached = (at + by <= most) & (F.get(array, F.least(at + by, most) - 1) <= key)
        return F.when(reached, at + by).otherwise(at)

    return F.aggregate(powers, F.lit(0), step)


def shard_records(
    docs: DataFrame, shards: int = 40, ranges: int = RANGES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """All rows with ``size, text_crc32, law, shard, slot, grown_shard``; shards have nearly equal bytes.

    The law is ``bytes``. Rows are ordered by (hash of the text, id). Copies of a text share a
    shard, but for groups that are larger than a range (estimated by the sample); ``slot`` counts a shard's rows from 0 in
    that order. ``grown_shard`` is NULL: the law fixes no shard for a later count. NULL text
    has size 16 and the checksum of the empty text; NULL ids come first; repeated rows are
    placed one after the other. Empty tables give no rows; input columns named like an
    output are replaced. With few or very large records, shards are as near in size as whole
    records allow.

    A sample drawn by size (bounded: about ``SAMPLES`` keys a range) gives splitters for
    ``ranges`` ranges a shard. Exact bytes of all ranges are summed, those overfull are cut
    again by a denser sample of their own, and ranges in order fill the shards. Rows are
    numbered within ranges, so no task holds a shard; only ids and sizes of ranges (at most
    a few times shards x ranges) reach the driver.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    id_type = dict(docs.dtypes)[id_column]
    text, row_id = column(text_column), column(id_column)
    key, size = _key(text, row_id), record_size(text)
    sized = docs.select(size.alias("size"), key.alias("key"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    mean = max(total / (shards * ranges), 1.0)
    whole = OVERFULL * mean
    cuts = _cut(_draw(sized, mean / SAMPLES).collect(), mean, whole)

    def filled(cuts: list[tuple]) -> list:
        part = _range_of(F.col("key"), cuts, id_type).alias("part")
        found = sized.select(part, "size").groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        return sorted(found.collect())

    sums = filled(cuts)
    overfull = [part for part, size_of, _ in sums if size_of > OVERFULL * mean]
    if overfull:
        inner = sized.withColumn("part", _range_of(F.col("key"), cuts, id_type)).filter(F.col("part").isin(overfull))
        places = [order(c) for c in cuts]
        samples: dict[int, list] = {}
        for row in _draw(inner, mean / (4 * SAMPLES)).collect():
            samples.setdefault(bisect_right(places, order(row)), []).append(row)
        more = [cut for sample in samples.values() for cut in _cut(sample, mean / 4, whole)]
        cuts = sorted({*cuts, *more}, key=order)
        sums = filled(cuts)

    # A range goes to the shard in which its middle byte falls; its slots follow those of the range before.
    home, first = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    before, taken = 0, [0] * shards
    for part, size_of, rows_of in sums:
        home[part] = min(int((before + size_of / 2) * shards / total), shards - 1)
        first[part] = taken[home[part]]
        taken[home[part]] += rows_of
        before += size_of
    placed = docs.select(
        *[column(name) for name in docs.columns if name not in made],
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.struct(_range_of(key, cuts, id_type).alias("part"), key.alias("key")).alias("slot"),
    )
    part = F.col("slot.part")
    in_range = F.row_number().over(Window.partitionBy("slot.part").orderBy("slot.key"))
    return placed.withColumn("grown_shard", in_range).select(
        *[column(name) for name in docs.columns if name not in made],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.get(_numbers(home), part).cast("int").alias("shard"),
        (F.get(_numbers(first), part) + F.col("grown_shard") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _numbers(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")
