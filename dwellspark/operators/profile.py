"""Column statistics by file, as sketches that are merged when they are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

# Logarithm of the buckets of a distinct count: its relative standard error is 1.04 / sqrt(2 ** 12), 1.6 %.
HLL_BUCKETS = 12
# Size of a quantile sketch: a quantile's rank is within 1.7 % of the rows with a chance of 99 %.
KLL_SIZE = 200
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (HLL_BUCKETS / 2), 0.017


def profile_files(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``file, column, rows, nulls, distinct, quantiles``: counts and sketches of each file's columns.

    ``df`` reads files. Numbers have both sketches, other columns a distinct count only; NULLs are in neither. A
    file's sketches are some kilobytes, whatever it holds, and need not be made again when other files come.
    """
    kinds = {c: df.select(F.col(c).alias(c)).schema[c].dataType for c in columns}
    by_file = df.select(F.input_file_name().alias("file"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(columns)]).groupBy("file")
    made = []
    for n, (name, kind) in enumerate(kinds.items()):
        value, number = F.col(f"c{n}"), isinstance(kind, T.NumericType)
        counted = value.cast("string") if not isinstance(kind, (T.IntegerType, T.LongType, T.StringType)) else value
        made.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(value.isNull()).alias("nulls"),
                F.hll_sketch_agg(counted, HLL_BUCKETS).alias("distinct"),
                (F.kll_sketch_agg_double(value.cast("double"), KLL_SIZE) if number else F.lit(None).cast("binary")).alias("quantiles"),
            )
        )
    return by_file.agg(F.array(*made).alias("made")).select("file", F.inline("made"))


def merged_profile(profiles: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``column, rows, nulls, distinct, quantiles`` of all files together, from their profiles alone.

    ``distinct`` is an estimate with a relative standard error of ``DISTINCT_ERROR``; each of ``quantiles`` is a value whose
    rank is within ``RANK_ERROR`` of the one asked for, NULL for a column that has no numbers.
    """
    merged = profiles.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("sketch"),
        F.count("quantiles").alias("sketches"),
    )
    asked = F.array(*[F.lit(float(r)) for r in ranks])
    numbers = (F.col("sketches") > 0) & (F.col("rows") > F.col("nulls"))
    return merged.select("column", "rows", "nulls", "distinct", F.when(numbers, F.kll_sketch_get_quantile_double("sketch", asked)).alias("quantiles"))
