"""Rankings compared with each other and with expected results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Places compared, places searched for an expected id, overhead called minimal.
TOP_K = 5
EXPECTED_TOP = 3
MINIMAL_OVERHEAD_PERCENT = 20.0


def top_ids(hits: DataFrame, k: int) -> DataFrame:
    """Per query the first ``k`` ids in order, and the best score."""
    first = hits.where(F.col("rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return first.groupBy("query_id").agg(
        F.transform(ordered, lambda x: x["id"]).alias("top_ids"), F.max("score").alias("top_score")
    )


def overlap_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap_at_k(a: Column, b: Column, k: int) -> Column:
    """Share of common ids; divided by ``k`` even if there are fewer rows."""
    return overlap_count(a, b) / F.lit(float(k))


def top_changed(a: Column, b: Column) -> Column:
    return F.element_at(a, 1) != F.element_at(b, 1)


def compare_rankings(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row per query: both id lists, their overlap, and the gain in the best score.

    ``hits`` has both rankings, told apart by ``list``: regular and multivector. A query
    that only one of them answers has nothing to compare and drops out.
    """
    first = F.col("rank") <= k

    def side(name: str) -> list[Column]:
        own = first & (F.col("list") == name)
        ordered = F.array_sort(F.collect_list(F.when(own, F.struct("rank", "id"))))
        ids = F.transform(ordered, lambda x: x["id"]).alias(f"{name}_top_ids")
        return [ids, F.max(F.when(own, F.col("score"))).alias(f"{name}_top_score")]

    joined = hits.groupBy("query_id").agg(*side("regular"), *side("multivector"))
    joined = joined.where((F.size("regular_top_ids") > 0) & (F.size("multivector_top_ids") > 0))
    a, b = F.col("regular_top_ids"), F.col("multivector_top_ids")
    return joined.select(
        "query_id",
        "regular_top_ids",
        "multivector_top_ids",
        overlap_count(a, b).alias("overlap_count"),
        overlap_at_k(a, b, k).alias("overlap_ratio"),
        top_changed(a, b).alias("top_changed"),
        "regular_top_score",
        "multivector_top_score",
        F.round(F.col("multivector_top_score") - F.col("regular_top_score"), 9).alias("score_improvement"),
    )


def expected_hit_at_k(comparison: DataFrame, expected: DataFrame, k: int = EXPECTED_TOP) -> DataFrame:
    """Whether each ranking has an expected id among its first ``k``; queries without expectation drop out."""
    joined = comparison.join(expected.where(F.size("expected_ids") > 0), "query_id")

    def found(column: str) -> Column:
        return F.arrays_overlap("expected_ids", F.slice(column, 1, k))

    regular, multivector = found("regular_top_ids"), found("multivector_top_ids")
    return joined.select(
        "query_id",
        regular.alias("regular_found"),
        multivector.alias("multivector_found"),
        (multivector & ~regular).alias("missed_by_regular"),
        (regular & ~multivector).alias("missed_by_multivector"),
    )


def evaluation_summary(comparison: DataFrame) -> DataFrame:
    """Changed tops, average overlap and gain over all queries, and what follows of them."""
    counts = comparison.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("top_changed").alias("top_changed_count"),
        F.avg("overlap_ratio").alias("avg_overlap"),
        F.avg("score_improvement").alias("avg_score_improvement"),
    )
    return counts.withColumn("improves", F.col("avg_score_improvement") > 0).withColumn(
        "changes_ranking", F.col("top_changed_count") * 2 > F.col("queries")
    )


def overhead(regular_seconds: Column, multivector_seconds: Column) -> Column:
    """Extra time of the second method in percent, from times measured outside the plan."""
    return (multivector_seconds / regular_seconds - 1) * 100


def timing_summary(times: DataFrame) -> DataFrame:
    """Averages over measured queries and whether the overhead is minimal.

    ``times`` has one row per query: query_encode_time, regular_time, multivector_time in seconds.
    """
    names = ["query_encode_time", "regular_time", "multivector_time"]
    means = times.agg(*[(F.avg(name) * 1000).alias(f"avg_{name}_ms") for name in names])
    percent = overhead(F.col("avg_regular_time_ms"), F.col("avg_multivector_time_ms"))
    return means.withColumn("overhead_percent", percent).withColumn(
        "overhead_minimal", F.col("overhead_percent") < MINIMAL_OVERHEAD_PERCENT
    )


def compare_models(scores: DataFrame, models: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """A row per model and query: the model's properties and the query's best score.

    ``scores`` has model, query_id and score. ``times``, measured outside, has a row per
    model, of which all columns are added.
    """
    best = scores.groupBy("model", "query_id").agg(F.max("score").alias("score"))
    found = models.join(best, "model")
    return found if times is None else found.join(times, "model", "left")


def models_side_by_side(compared: DataFrame, query_ids: list[int]) -> DataFrame:
    """For display: a row per model, the best scores of the named queries as columns."""
    fixed = [c for c in compared.columns if c not in ("query_id", "score")]
    wide = compared.groupBy(*fixed).pivot("query_id", query_ids).agg(F.max("score"))
    return wide.withColumnsRenamed({str(n): f"query_{n}" for n in query_ids})
