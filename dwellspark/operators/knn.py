"""Filtered cosine top-k, for one query vector and for a table of queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

from dwellspark.functions.predicates import FILTERS, build_filter
from dwellspark.operators.numbering import number_rows
from dwellspark.operators.scoring import QueryBlock, best_items, similarity
from dwellspark.session import file_system, new_folder

# A query table up to this size is sent to every task; a larger one is read by the tasks block by block.
BROADCAST_QUERIES = 4096
BROADCAST_BYTES = 64 << 20
# Queries in one block, and bytes of items that a task holds against the blocks.
BLOCK_ROWS = 16_384
HELD_BYTES = 256 << 20
# Items in so many that a first pass looks at, to know what a query's hits reach at least; and the tasks that it has
# to one of a shuffle. Of a thousand tasks and more, few then have something to tell about a query.
SAMPLE_OF = 32
SAMPLE_TASKS = 16
# Names that a scan is asked for.
LISTED = 1000
# Groups of tasks whose partial lists are merged before the last merge of a query.
MERGE_GROUPS = 16


def knn(
    items: DataFrame,
    vector: Sequence[float],
    k: int | None,
    using: str | Sequence[str] = "embedding",
    filters: Mapping[str, Any] | None = None,
    prefix: str = "",
) -> DataFrame:
    """The best items for one query vector as (id, score); ``k=None`` keeps all, unsorted.

    Pushed filter, one matrix product per Arrow batch, ``TakeOrderedAndProject``. With several
    named vectors an item counts with its best one.
    """
    condition = build_filter(filters, prefix)
    if condition is not None:
        items = items.where(condition)
    names = [using] if isinstance(using, str) else list(using)
    similarities = [similarity(vector, F.col(name)) for name in names]
    best = similarities[0] if len(names) == 1 else F.greatest(*similarities)
    scored = items.select("id", best.alias("score")).where("score is not null")
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def rank_all(items: DataFrame, vector: Sequence[float], using: str | Sequence[str] = "embedding") -> DataFrame:
    """Every item with its rank for one query, by a distributed sort and numbering."""
    return number_rows(knn(items, vector, None, using), [F.desc("score"), F.asc("id")], "rank")


def query_table(queries: DataFrame) -> DataFrame:
    """The columns a search needs of a query table."""
    optional = [c for c in ["limit", *FILTERS] if c in queries.columns]
    return queries.select("query_id", "vector", *optional)


def gather_queries(queries: DataFrame, most: int = BROADCAST_QUERIES) -> pa.Table | DataFrame:
    """The query table as Arrow data if it is small enough to send to every task.

    At most ``most`` rows and one more are read, once their bytes are known to be few; a
    larger table is returned as it is.
    """
    queries = query_table(queries)
    wide = F.sum(F.lit(8).cast("long") * F.size("vector") + 100)
    rows, size = queries.limit(most + 1).agg(F.count(F.lit(1)), wide).first()
    return queries.toArrow() if rows <= most and (size or 0) <= BROADCAST_BYTES else queries


def _covering_filter(items: DataFrame, queries: pa.Table | DataFrame) -> DataFrame:
    """A condition that holds for every item any of the queries lets through.

    It reaches the Parquet scan, where the per-query filters cannot go. Of a large query
    table one row of bounds comes to the driver, and at most ``LISTED`` names a column.
    """
    given = queries.column_names if isinstance(queries, pa.Table) else queries.columns
    names = [name for name in FILTERS if name in given]
    if not names:
        return items
    if isinstance(queries, pa.Table):
        queries = items.sparkSession.createDataFrame(queries.select(names))
    # Without queries, and where some query sets no bound, there is no bound on all.
    bounds = queries.agg(
        *[F.when(F.count_if(F.col(n).isNull()) == 0, F.min(n)).alias(f"{n}_low") for n in names],
        *[F.when(F.count_if(F.col(n).isNull()) == 0, F.max(n)).alias(f"{n}_high") for n in names],
    ).first()
    common: dict[str, Any] = {}
    for name in names:
        column, kind = FILTERS[name]
        low, high = bounds[f"{name}_low"], bounds[f"{name}_high"]
        if low is None:
            continue
        if kind in ("ge", "le"):
            common[name] = low if kind == "ge" else high
        elif kind == "flag" and low == high:
            common[name] = low
        elif kind == "eq" and low != "":
            listed = [row[0] for row in queries.select(name).distinct().limit(LISTED + 1).collect()]
            if len(listed) <= LISTED:
                items = items.where(F.col(column).isin(listed))
    condition = build_filter(common)
    return items if condition is None else items.where(condition)


def _hit_schema(queries: pa.Table | DataFrame) -> T.StructType:
    if isinstance(queries, pa.Table):
        kind = from_arrow_type(queries.schema.field("query_id").type)
    else:
        kind = queries.schema["query_id"].dataType
    return T.StructType(
        [
            T.StructField("query_id", kind),
            T.StructField("id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("limit", T.IntegerType()),
            T.StructField("list", T.IntegerType()),
        ]
    )


def _scan_with_queries(items: DataFrame, queries: pa.Table, lists: list[list[str]], k: int, schema: T.StructType) -> DataFrame:
    """Small query table: one pass over the items, every task holds all queries."""
    shared = items.sparkSession.sparkContext.broadcast(queries)
    names = schema.names

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in best_items(batches, QueryBlock(shared.value, k), lists):
            yield pa.RecordBatch.from_arrays(columns, names)

    return _covering_filter(items, queries).mapInArrow(scan, schema)


def _scan_with_blocks(
    items: DataFrame, queries: DataFrame, lists: list[list[str]], k: int, schema: T.StructType, block_rows: int,
    sample_of: int | None = SAMPLE_OF,
) -> DataFrame:
    """Large query table: the items stay where they are and are read in one pass, after one over a sample.

    The queries are written once, in files of at most ``block_rows`` rows, to the shared
    folder. A task takes in items up to ``HELD_BYTES`` and goes through the files with them,
    one block in memory at a time. With ``sample_of`` a first pass over one item in so many
    gives each query a score that its last hit reaches in any case; it goes with the blocks,
    and a task leaves out what is below it.
    """
    written = _written_blocks(queries, block_rows)
    if sample_of:
        written = _written_blocks(_with_floors(items, written, lists, k, schema, sample_of), block_rows)
    return _covering_filter(items, written).mapInArrow(_through_blocks(written, lists, k, schema), schema)


def _written_blocks(queries: DataFrame, block_rows: int) -> DataFrame:
    path = new_folder(queries.sparkSession, "queries")
    queries.write.option("maxRecordsPerFile", block_rows).parquet(path)
    return queries.sparkSession.read.schema(queries.schema).parquet(path)


def _through_blocks(written: DataFrame, lists: list[list[str]], k: int, schema: T.StructType):
    files, names = sorted(written.inputFiles()), schema.names

    def passed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in files:
            system, place = file_system(unquote(uri))
            block = QueryBlock(pq.read_table(place, filesystem=system), k)
            for columns in best_items(batches, block, lists):
                yield pa.RecordBatch.from_arrays(columns, names)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from passed(held)
                held, size = [], 0
        if held:
            yield from passed(held)

    return scan


def _with_floors(items: DataFrame, written: DataFrame, lists: list[list[str]], k: int, schema: T.StructType, sample_of: int) -> DataFrame:
    """The queries with ``floors``, for each list the score of the last hit among a sample of the items; NULL if it has too few.

    The best of some items are no better than the best of all, so each floor holds for the whole table.
    """
    tasks = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SAMPLE_TASKS)
    sampled = _covering_filter(items, written).sample(1 / sample_of, seed=sample_of).repartition(tasks)
    hits = top_hits(sampled.mapInArrow(_through_blocks(written, lists, k, schema), schema), k, ("list", "query_id"))
    last = hits.where(F.col("rank") == F.col("limit")).groupBy("query_id").agg(
        F.array(*[F.max(F.when(F.col("list") == number, F.col("score"))) for number in range(len(lists))]).alias("floors")
    )
    return written.join(last, "query_id", "left")


def top_hits(hits: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The best ``k`` of every query out of many partial lists, with their rank.

    Two steps, so that one query over very many tasks is not merged by a single one; both
    windows cut to ``k`` before their shuffle.
    """
    order = [F.desc("score"), F.asc("id")]
    group = F.pmod(F.xxhash64("id"), F.lit(MERGE_GROUPS))
    partial = Window.partitionBy(*by, "_group").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        hits.withColumn("_group", group)
        .withColumn("_place", F.row_number().over(partial))
        .where(F.col("_place") <= k)
        .drop("_group", "_place")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
    )


def knn_lists(
    items: DataFrame,
    queries: DataFrame | pa.Table,
    k: int,
    lists: Mapping[str, Sequence[str]],
    prefix: str = "",
    broadcast_queries: int = BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
    sample_of: int | None = SAMPLE_OF,
) -> DataFrame:
    """Several rankings of the same items from one scan: (list, query_id, rank, id, score).

    ``lists`` names each ranking and the vectors it takes the best similarity of. ``queries``
    has query_id, vector and, if wanted, limit and any of the filter columns (NULL is no
    filter); or it is what ``gather_queries`` returned for such a table. ``k`` bounds the
    limits. A query's filters apply before its similarity counts.
    """
    vectors = [list(names) for names in lists.values()]
    if isinstance(queries, DataFrame):
        queries = gather_queries(queries, broadcast_queries)
    given = queries.column_names if isinstance(queries, pa.Table) else queries.columns
    needed = sorted({FILTERS[name][0] for name in FILTERS if name in given})
    columns = dict.fromkeys(sum(vectors, []))
    items = items.select("id", *columns, *[F.col(prefix + name).alias(name) for name in needed])
    schema = _hit_schema(queries)
    if isinstance(queries, pa.Table):
        hits = _scan_with_queries(items, queries, vectors, k, schema)
    else:
        hits = _scan_with_blocks(items, queries, vectors, k, schema, block_rows, sample_of)
    ranked = top_hits(hits, k, ("list", "query_id")).where(F.col("rank") <= F.col("limit"))
    name = F.element_at(F.array(*[F.lit(n) for n in lists]), F.col("list") + 1)
    return ranked.select(name.alias("list"), "query_id", "rank", "id", "score")


def knn_batch(
    items: DataFrame, queries: DataFrame | pa.Table, k: int = 10, using: str | Sequence[str] = "embedding",
    prefix: str = "", **sizes: int | None,
) -> DataFrame:
    """The best items for each row of a query table: (query_id, rank, id, score).

    With several named vectors an item counts with its best one. See ``knn_lists``.
    """
    names = [using] if isinstance(using, str) else list(using)
    return knn_lists(items, queries, k, {"hits": names}, prefix, **sizes).drop("list")
