"""Evaluation flows over a query table."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession, functions as F

from dwellspark.operators.embedding import Embedder
from dwellspark.operators.evaluate import TOP_K, compare_models, compare_rankings
from dwellspark.operators.knn import knn_batch, knn_lists
from dwellspark.schema import VECTOR_NAMES


def compare_methods(index: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Description vectors alone against the better of both vectors, from one scan."""
    lists = {"regular": ["description"], "multivector": VECTOR_NAMES}
    return compare_rankings(knn_lists(index, queries.select("query_id", "vector"), k, lists), k)


# What a model that is not there raises when it is loaded.
LOAD_ERRORS = ("ImportError", "ModuleNotFoundError", "OSError", "FileNotFoundError")


def works(spark: SparkSession, embedder: Embedder) -> bool:
    """Whether an embedder can be loaded; one that cannot is named in a warning, any other failure is an error."""
    try:
        spark.range(1).select(embedder.column(F.lit("text"))).collect()
    except PythonException as error:
        if not any(f"\n{name}:" in str(error) or f" {name}:" in str(error) for name in LOAD_ERRORS):
            raise
        warnings.warn(f"{embedder.name} is left out: it cannot be loaded", stacklevel=3)
        return False
    return True


def compare_embedders(items: DataFrame, queries: DataFrame, embedders: list[Embedder], times: DataFrame | None = None) -> DataFrame:
    """Best description score of each query under each embedder; one that cannot be loaded is left out, with a warning.

    ``items`` has id and description, ``queries`` has query_id and query.
    """
    spark = items.sparkSession
    embedders, best = [e for e in embedders if works(spark, e)], []
    for embedder in embedders:
        index = items.select("id", embedder.column(F.col("description")).alias("description"))
        asked = queries.select("query_id", embedder.column(F.col("query")).alias("vector"))
        hits = knn_batch(index, asked, 1, "description")
        best.append(hits.select(F.lit(embedder.name).alias("model"), "query_id", "score"))
    if not best:
        best = [spark.createDataFrame([], "model string, query_id long, score double")]
    models = spark.createDataFrame([(e.name, e.dim) for e in embedders], "model string, dimension int")
    return compare_models(reduce(DataFrame.unionByName, best), models, times)
