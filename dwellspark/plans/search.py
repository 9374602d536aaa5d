"""Search end to end, for a table of requests or for one."""

from __future__ import annotations

from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dwellspark.operators.embedding import Embedder
from dwellspark.operators.fusion import max_sim, max_sim_batch
from dwellspark.operators.knn import gather_queries
from dwellspark.operators.lookup import BROADCAST_HITS, assign_rank, fetch_hits, respond
from dwellspark.plans.requests import MAX_LIMIT, SearchRequest, validate_requests
from dwellspark.schema import VECTOR_NAMES


def search_listings(index: DataFrame, queries: DataFrame | pa.Table, prefix: str = "payload.") -> DataFrame:
    """Hits of embedded queries: (query_id, rank, id, score), best of both vectors."""
    return max_sim_batch(index, queries, MAX_LIMIT, VECTOR_NAMES, prefix)


def search_vectors(index: DataFrame, listings: DataFrame, queries: DataFrame, prefix: str = "payload.") -> DataFrame:
    """Hits of embedded queries with their listing rows, ranked after dropping ids without a row."""
    gathered = gather_queries(queries)
    bounded = isinstance(gathered, pa.Table) and gathered.num_rows * MAX_LIMIT <= BROADCAST_HITS
    hits = search_listings(index, gathered, prefix).select("query_id", "id", "score")
    return respond(assign_rank(fetch_hits(listings, hits, bounded)))


def search(index: DataFrame, listings: DataFrame, requests: DataFrame, embedder: Embedder) -> DataFrame:
    """Answers every valid request; a request without a match has no rows.

    ``index`` and ``listings`` are stored tables, as ``ingest`` writes them. The rejected requests are ``validate_requests(requests)[1]``.
    """
    valid, _ = validate_requests(requests)
    queries = valid.withColumn("vector", embedder.column(F.col("query")))
    return search_vectors(index, listings, queries)


def search_one(index: DataFrame, listings: DataFrame, request: SearchRequest, embedder: Embedder) -> DataFrame:
    """The ranked results of one request.

    Its filters go to the scan whole, and the best hits are taken without a window or a shuffle of candidates.
    """
    filters = asdict(request)
    text, limit = filters.pop("query"), filters.pop("limit")
    vector = index.sparkSession.range(1).select(embedder.column(F.lit(text)).alias("v")).first().v
    hits = max_sim(index, vector or [0.0] * embedder.dim, limit, VECTOR_NAMES, filters, "payload.")
    found = fetch_hits(listings, hits.withColumn("query_id", F.lit(1)), True)
    return respond(assign_rank(found)).drop("query_id").orderBy("rank")
