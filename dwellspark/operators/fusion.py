"""Maximum-similarity fusion of the two named vectors, in both forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from dwellspark.operators.knn import knn, knn_batch, knn_lists, top_hits
from dwellspark.schema import DEFAULT_LIMIT, VECTOR_NAMES


def max_sim(
    index: DataFrame,
    vector: Sequence[float],
    k: int,
    names: Sequence[str] = VECTOR_NAMES,
    filters: Mapping[str, Any] | None = None,
    prefix: str = "",
) -> DataFrame:
    """Score form, one query: the better similarity of each item, in a single scan."""
    return knn(index, vector, k, names, filters, prefix)


def max_sim_batch(
    index: DataFrame, queries: DataFrame, k: int, names: Sequence[str] = VECTOR_NAMES, prefix: str = "", **sizes: int
) -> DataFrame:
    """Score form for a query table."""
    return knn_batch(index, queries, k, names, prefix, **sizes)


def fuse(hits: DataFrame, k: int) -> DataFrame:
    """The best score per query and item over all hit lists, the best ``k`` of each query."""
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_hits(best, k).select("query_id", "rank", "id", "score")


def fuse_max_sim(
    index: DataFrame, queries: DataFrame, k: int, names: Sequence[str] = VECTOR_NAMES, prefix: str = "", **sizes: int
) -> DataFrame:
    """List form: the ``2k`` best by each vector, fused, and of them as many as the query's limit says.

    Gives the same as ``max_sim_batch``: an item that is among the best ``k`` by its better
    vector is among the best ``k`` of that vector's list as well.
    """
    lists = {name: [name] for name in names}
    fused = fuse(knn_lists(index, queries.drop("limit"), 2 * k, lists, prefix, **sizes), k)
    if "limit" not in queries.columns:
        return fused
    most = queries.select("query_id", F.coalesce("limit", F.lit(DEFAULT_LIMIT)).alias("limit"))
    return fused.join(most, "query_id").where(F.col("rank") <= F.col("limit")).drop("limit")
