"""Keyword search: postings with counts, and BM25 of blocks of request texts against items in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dwellspark.operators.knn import top_hits
from dwellspark.operators.numbering import number_rows
from dwellspark.session import cut_lineage, file_system, new_folder

# Usual constants of BM25: how fast further showings of a token count less, and how far lengths are evened out.
K1, B = 1.2, 0.75
# Postings of one token that are kept together; a token of more is dealt over parts.
PART_ROWS = 100_000
# Requests in one block, postings that a task holds against the blocks, and cells of its table of sums.
BLOCK_REQUESTS = 1024
HELD_POSTINGS = 2_000_000
SUM_CELLS = 4_000_000
# Tokens that are counted at once.
COUNTED_TOKENS = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, repeats included; NULL has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _counted(schema: T.StructType):
    """Texts as ``id, words`` to rows ``id, token, tf, length``, each text for itself."""

    def rows(ids: pa.Array, words: pa.Array) -> pa.RecordBatch:
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        many = max(len(coded.dictionary), 1)
        shown, tf = np.unique(np.repeat(np.arange(len(ids)), sizes) * many + coded.indices.to_numpy(), return_counts=True)
        row, token = np.divmod(shown, many)
        columns = [ids.take(pa.array(row)), coded.dictionary.take(pa.array(token)), pa.array(tf.astype(np.int64)), pa.array(sizes[row])]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0), batch.column(1)
            before = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)) // COUNTED_TOKENS
            for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(before)) + 1):
                if len(at):
                    yield rows(ids.slice(at[0], len(at)), words.slice(at[0], len(at)))

    return count


def build_postings(items: DataFrame, columns: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """The index of a table's texts: ``token, part, id, tf, length, df``, a row per token and item; written once.

    ``tf`` counts the token in the item's columns together, ``length`` all its tokens, ``df`` the items with
    the token. Items that share an ``id`` are counted as one text. Postings of a frequent token are dealt over
    as many parts as ``part_rows`` of them need, by a hash of the id.

    An id's tokens are counted where its text is; only the texts of repeated ids are added up by a shuffle.
    """
    words = F.concat(*[tokens(F.col(c)) for c in columns])
    items = items.where("id is not null")
    kind = items.schema["id"].dataType
    schema = T.StructType().add("id", kind).add("token", "string").add("tf", "long").add("length", "long")
    counted = lambda some: some.select("id", words.alias("words")).mapInArrow(_counted(schema), schema)
    repeated = cut_lineage(items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if repeated.isEmpty():
        rows = counted(items)
    else:
        several = items.join(repeated, "id", "left_semi")
        sums = counted(several).groupBy("id", "token").agg(F.sum("tf").alias("tf"))
        lengths = several.select("id", F.size(words).cast("long").alias("n")).groupBy("id").agg(F.sum("n").alias("length"))
        rows = counted(items.join(repeated, "id", "left_anti")).unionByName(sums.join(lengths, "id"))
    rows = cut_lineage(rows)
    # Written, so that Spark knows whether it is small enough to be sent to the postings.
    frequent = cut_lineage(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    parts = F.ceil(F.col("df") / part_rows)
    return rows.join(frequent, "token").select("token", F.pmod(F.xxhash64("id"), parts).alias("part"), "id", "tf", "length", "df")


class _Block:
    """Some requests by the codes of their tokens: which of them ask for a code."""

    def __init__(self, table: pa.Table):
        self.query_id = table.column("query_id").combine_chunks()
        asked = table.column("codes").combine_chunks()
        sizes = pc.list_value_length(asked).to_numpy(zero_copy_only=False)
        codes, request = asked.flatten().to_numpy(), np.repeat(np.arange(len(asked)), sizes)
        order = np.argsort(codes, kind="stable")
        self.codes, self.first, self.many = np.unique(codes[order], return_index=True, return_counts=True)
        self.request = request[order]

    def best(self, item: np.ndarray, code: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Request, item and rounded score of the best ``k`` items of each request; ``item`` is ascending."""
        n = len(self.query_id)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        asked = self.codes[at] == code
        item, at, weight = item[asked], at[asked], weight[asked]
        # Items are taken in runs that keep both the table of sums and the list of what is added to it bounded.
        most = max(SUM_CELLS // n, 1)
        pairs = np.cumsum(self.many[at])
        run = np.maximum.accumulate((pairs // SUM_CELLS)[np.searchsorted(item, item)] if len(item) else pairs)
        starts = np.flatnonzero(np.diff(run, prepend=-1) + np.diff(item // most, prepend=-1))
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for a, b in zip(starts, [*starts[1:], len(item)]):
            base, cells = item[a], (item[b - 1] - item[a] + 1) * n
            many = self.many[at[a:b]]
            place = np.repeat(self.first[at[a:b]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            cell = np.repeat((item[a:b] - base) * n, many) + self.request[place]
            sums = np.bincount(cell, np.repeat(weight[a:b], many), cells).reshape(-1, n)
            sums = np.where(sums > 0, np.floor(sums * 1e6 + 0.5) / 1e6, -1.0)
            last = np.partition(sums, len(sums) - k, axis=0)[len(sums) - k] if len(sums) > k else np.zeros(n)
            row, request = np.nonzero(sums >= np.maximum(last, 0))
            found = (request, row + base, sums[row, request])
            held = _cut(*[np.concatenate(two) for two in zip(held, found)], k)
        return held


def _cut(request: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((item, -score, request))
    request, item, score = request[order], item[order], score[order]
    kept = np.arange(len(request)) - np.searchsorted(request, request) < k
    return request[kept], item[kept], score[kept]


def _scored(files: list[str], k: int, schema: T.StructType):
    """Weighed postings ``id, code, weight``, sorted by id, to the hits of all requests among the items of a task."""

    def passed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("id").combine_chunks()
        new = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        item = np.concatenate([[0], np.cumsum(new)]).astype(np.int64)
        ids = ids.take(pa.array(np.flatnonzero(np.concatenate([[True], new]))))
        code, weight = (rows.column(c).to_numpy() for c in ("code", "weight"))
        for uri in files:
            system, place = file_system(unquote(uri))
            block = _Block(pq.read_table(place, filesystem=system))
            if len(block.query_id):
                request, hit, score = block.best(item, code, weight, k)
                columns = [block.query_id.take(pa.array(request)), ids.take(pa.array(hit)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch) and size >= HELD_POSTINGS and batch.column(0)[0] != held[-1].column(0)[-1]:
                yield from passed(pa.Table.from_batches(held))
                held, size = [], 0
            elif len(batch) and size >= HELD_POSTINGS:
                # The last item goes on in this batch; it is kept back.
                rows = pa.Table.from_batches(held)
                own = int(pc.index(pc.equal(rows.column(0), rows.column(0)[-1]), True).as_py())
                if own:
                    yield from passed(rows.slice(0, own))
                    held = rows.slice(own).to_batches()
                    size = len(rows) - own
            if len(batch):
                held.append(batch)
                size += len(batch)
        if held:
            yield from passed(pa.Table.from_batches(held))

    return scan


def keyword_match(
    postings: DataFrame, requests: DataFrame, k: int = 10, k1: float = K1, b: float = B, part_rows: int = PART_ROWS,
    block_requests: int = BLOCK_REQUESTS,
) -> DataFrame:
    """The best items of each request by BM25 of its text: ``query_id, rank, id, score``.

    ``requests`` has ``query_id, query``; each distinct token of a text counts once. Items without any of
    them are no hits; a request without tokens has none. Scores are rounded to 6 decimals, equal ones
    are ordered by id. ``postings`` come from ``build_postings`` with the same ``part_rows``.

    The postings of asked tokens are brought together by item. Requests are written in blocks of token codes; a task
    goes through the blocks with the items it holds, adds up the scores there and returns the best ``k`` of each request, so
    (request, item) pairs never exist as rows.
    """
    # One row: the items that have tokens, and their mean length.
    items, mean = postings.select("id", "length").distinct().agg(F.count(F.lit(1)), F.avg("length")).first()
    asked = cut_lineage(requests.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token")).distinct())
    sizes = postings.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.max("df").alias("df"))
    coded = cut_lineage(number_rows(sizes, [F.asc("token")], "code"))
    written = new_folder(postings.sparkSession, "requests")
    grouped = asked.join(coded.select("token", "code"), "token").groupBy("query_id").agg(F.collect_list("code").alias("codes"))
    grouped.write.option("maxRecordsPerFile", block_requests).parquet(written)
    files = sorted(postings.sparkSession.read.schema(grouped.schema).parquet(written).inputFiles())
    idf = F.log(1 + (F.lit(items) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    evened = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean))
    weighed = postings.drop("df").join(coded, "token").select("id", "code", (idf * F.col("tf") * (k1 + 1) / evened).alias("weight"))
    kinds = {name: df.schema[name].dataType for df, name in ((requests, "query_id"), (postings, "id"))}
    schema = T.StructType().add("query_id", kinds["query_id"]).add("id", kinds["id"]).add("score", "double")
    hits = weighed.repartition("id").sortWithinPartitions("id").mapInArrow(_scored(files, k, schema), schema)
    found = hits.withColumn("score", F.round("score", 6))
    return top_hits(found, k).select("query_id", "rank", "id", "score")
