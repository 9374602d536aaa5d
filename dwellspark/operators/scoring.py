"""Exact scoring of item batches against a block of queries, inside one task.

Both sides are Arrow data: one matrix product per batch, then the best ``k`` items of each
query. Only those leave the task, never all (query, item) pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from dwellspark.functions.predicates import FILTERS
from dwellspark.functions.vectors import SCORE_DIGITS
from dwellspark.schema import DEFAULT_LIMIT

# Scores held at a time in one task: 4M doubles are 32 MB.
CELLS = 4_000_000
# Below every cosine: the bound before k items are known, and the score of an excluded item.
NO_FLOOR = -2.0
EXCLUDED = -3.0
# More than rounding can move two scores against each other.
SLACK = 2.0 * 10.0**-SCORE_DIGITS


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of unit length; NULL and zero vectors become NaN rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    count = int(known.sum())
    dim = len(flat) // count if count else 0
    if count and (dim * count != len(flat) or pc.min_max(pc.list_value_length(vectors))["min"].as_py() != dim):
        raise ValueError("vectors of unequal length")
    rows = np.full((len(known), dim), np.nan)
    rows[known] = flat.reshape(count, dim)
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    length[length == 0] = np.nan
    return rows / length[:, None]


def similarity(vector: Sequence[float], column: Column) -> Column:
    """Score of a vector column for one query vector; NULL where there is none.

    Declared non-deterministic only to be evaluated once: otherwise a condition on the score
    would move below the projection with a second call.
    """
    query = np.asarray(vector, np.float64)
    length = np.sqrt(query @ query)
    unit = query / length if length else np.full(len(query), np.nan)

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        rows = unit_rows(vectors)
        scores = np.round(rows @ unit, SCORE_DIGITS) if rows.shape[1] else np.full(len(rows), np.nan)
        return pa.array(scores, mask=np.isnan(scores))

    return score.asNondeterministic()(column)


class QueryBlock:
    """The queries as arrays: unit vectors, limits and the filters that any of them sets."""

    def __init__(self, table: pa.Table, k: int):
        self.ids = table["query_id"].combine_chunks()
        self.vectors = unit_rows(table["vector"])
        if "limit" in table.column_names:
            limits = table["limit"].combine_chunks().fill_null(DEFAULT_LIMIT).to_numpy(zero_copy_only=False)
            self.limits = np.minimum(limits, k)
        else:
            self.limits = np.full(len(self.ids), k)
        self.k = int(self.limits.max()) if len(self.ids) else 0
        # Per list a score that a query's last hit is known to reach.
        self.floors = table["floors"].to_pylist() if "floors" in table.column_names else None
        self.filters = {}
        for name, (column, kind) in FILTERS.items():
            if name in table.column_names:
                bound = table[name].combine_chunks()
                given = bound.is_valid()
                if kind == "eq":
                    given = pc.and_(given, pc.fill_null(pc.not_equal(bound, ""), False))
                given = given.to_numpy(zero_copy_only=False)
                if given.any():
                    self.filters[name] = (column, kind, bound, given)

    def admits(self, items: pa.RecordBatch | pa.Table) -> np.ndarray | None:
        """Which query lets which item through; None if no query filters at all."""
        mask = None
        for column, kind, bound, given in self.filters.values():
            values = items[column]
            if kind == "eq":
                words = pc.unique(bound.drop_null())
                item = pc.index_in(values, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
                wanted = pc.index_in(bound, value_set=words).fill_null(-2).to_numpy(zero_copy_only=False)
                passes = wanted[:, None] == item[None, :]
            elif kind == "flag":
                item = values.fill_null(False).to_numpy(zero_copy_only=False)
                wanted = bound.fill_null(False).to_numpy(zero_copy_only=False)
                passes = wanted[:, None] == item[None, :]
            else:
                item = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                wanted = bound.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                compare = np.greater_equal if kind == "ge" else np.less_equal
                passes = compare(item[None, :], wanted[:, None])
            passes |= ~given[:, None]
            mask = passes if mask is None else mask & passes
        return mask

    def similarities(self, items: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
        """(query, item) matrix of one named vector; NaN where either vector is missing."""
        rows = unit_rows(items[name])
        if rows.shape[1] and self.vectors.shape[1]:
            return self.vectors @ rows.T
        return np.full((len(self.ids), items.num_rows), np.nan)

    def scores(self, items: pa.RecordBatch | pa.Table, lists: list[list[str]]) -> list[np.ndarray]:
        """Per list of vector names the best similarity over them, not yet rounded."""
        single = {name: self.similarities(items, name) for name in dict.fromkeys(sum(lists, []))}
        mask = self.admits(items)
        found = []
        for names in lists:
            best = np.nan_to_num(reduce(np.fmax, [single[name] for name in names]), nan=EXCLUDED)
            if mask is not None:
                best[~mask] = EXCLUDED
            found.append(best)
        return found


class TopK:
    """Running best items of every query: rounded score descending, then id ascending."""

    def __init__(self, block: QueryBlock, number: int = 0):
        self.block = block
        self.query = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.floor = np.full(len(block.ids), NO_FLOOR)
        if block.floors is not None:
            known = [NO_FLOOR if floors is None or floors[number] is None else floors[number] for floors in block.floors]
            self.floor = np.array(known, np.float64)

    def candidates(self, scores: np.ndarray) -> np.ndarray:
        """Items that can still be among the best; few after the first batches."""
        k = self.block.k
        open_ = scores >= (self.floor - SLACK)[:, None]
        if scores.shape[1] > k and np.count_nonzero(open_) > 4 * k * len(scores):
            floor = np.maximum(self.floor, np.partition(scores, -k, axis=1)[:, -k])
            open_ = scores >= (floor - SLACK)[:, None]
        return open_

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        new, position = np.nonzero(self.candidates(scores))
        query = np.concatenate([self.query, new])
        score = np.concatenate([self.score, np.round(scores[new, position], SCORE_DIGITS)])
        ids = np.concatenate([self.id, ids[position]])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        starts = np.searchsorted(query, np.arange(len(self.floor)))
        place = np.arange(len(query)) - starts[query]
        full = place == self.block.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])
        keep = place < self.block.limits[query]
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]

    def columns(self, number: int) -> list[pa.Array]:
        return [
            self.block.ids.take(pa.array(self.query)),
            pa.array(self.id, pa.int64()),
            pa.array(self.score, pa.float64()),
            pa.array(self.block.limits[self.query], pa.int32()),
            pa.array(np.full(len(self.id), number), pa.int32()),
        ]


def best_items(
    batches: Iterable[pa.RecordBatch], block: QueryBlock, lists: list[list[str]]
) -> Iterator[list[pa.Array]]:
    """The best items of all batches, list by list, as the columns query_id, id, score, limit, list."""
    tops = [TopK(block, number) for number in range(len(lists))]
    step = max(1, CELLS // max(1, len(block.ids)))
    if block.k:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = part["id"].to_numpy(zero_copy_only=False)
                for top, scores in zip(tops, block.scores(part, lists)):
                    top.add(scores, ids)
    for number, top in enumerate(tops):
        yield top.columns(number)
