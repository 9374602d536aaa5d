"""SimHash near-dedup: fingerprints joined by walking a binary trie against itself."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from dwellspark.llm.components import components
from dwellspark.llm.rows import column
from dwellspark.session import cut_lineage

SHINGLE, BUDGET = 3, 2
#: Fingerprints aimed at in one subtree, and the depths at which the trie is dealt out first.
SUBTREE, DEPTHS = 1 << 14, (4, 24)
#: A pair of subtrees with more fingerprints is dealt on, by so many bits more.
OVERFULL, DEEPER = 1 << 17, 4
#: Node pairs that go down together.
FRONT = 1 << 16
#: Shingle hashes of a text that are in memory at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the text's shingle hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    counts, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, total, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        hashes = [xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*[part[k:] for k in range(shingle)]))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints as signed 64-bit numbers."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


class _Forest:
    """Parts joined so far; ``label`` is the smallest place of each place's part."""

    def __init__(self, count: int) -> None:
        self.label, self.links = np.arange(count), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.label[a] != self.label[b]
        if not new.any():
            return
        parent = self.label.tolist()

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(a[new].tolist(), b[new].tolist()):
            low, high = sorted((root(x), root(y)))
            if low != high:
                parent[high] = low
                self.links.append((x, y))
        label = np.array(parent)
        while (label != (up := label[label])).any():
            label = up
        self.label = label


def walk(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int) -> list[tuple[int, int]]:
    """Links, as pairs of places, that connect all values differing in at most ``budget`` bits from ``depth`` on.

    The sorted distinct values are the trie: a node is a run of values that agree so far. Node
    pairs go down together; a pair whose branches differ has one bit less to spend, and is
    dropped when it would need more. Within one trie (``right`` None) a node meets itself and
    those after it; else places of ``right`` follow those of ``left``. At most ``FRONT`` pairs
    go down at a time, so memory is bounded, and a pair whose values are all connected
    already is dropped: a dense group costs no walk to all its pairs.
    """
    one = right is None
    values, shift = (left, 0) if one else (np.concatenate([left, right]), len(left))
    forest, ones = _Forest(len(values)), {}
    front = [(63 - depth, np.array([[0, len(left), shift, len(values), budget]], np.int64))]
    while front:
        bit, pairs = front.pop()
        label = forest.label
        turns = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        a0, a1, b0, b1, rest = pairs.T
        even = (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1]) & (label[a0] == label[b0])
        pairs = pairs[~even]
        if len(pairs) == 0:
            continue
        if bit < 0:
            forest.join(pairs[:, 0], pairs[:, 2])
            continue
        if bit not in ones:  # zeros of a node come before its ones: running sums tell where
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a0, a1, b0, b1, rest = pairs.T
        am, bm = a1 - (ones[bit][a1] - ones[bit][a0]), b1 - (ones[bit][b1] - ones[bit][b0])
        below = [(am, a1, b0, bm, rest - 1), (a0, am, bm, b1, rest - 1), (am, a1, bm, b1, rest), (a0, am, b0, bm, rest)]
        pairs = np.concatenate([np.stack(x, 1) for x in below])
        alive = (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (pairs[:, 4] >= 0)
        if one:
            alive &= pairs[:, 0] <= pairs[:, 2]
        pairs = pairs[alive]
        front += [(bit - 1, pairs[at : at + FRONT]) for at in range(0, len(pairs), FRONT)]
    return forest.links


def _flips(bits: int, budget: int) -> Column:
    """All ways to flip at most ``budget`` of ``bits`` bits, and how many each flips."""
    ways = [(sum(1 << k for k in c), n) for n in range(min(budget, bits) + 1) for c in combinations(range(bits), n)]
    return F.array(*[F.struct(F.lit(x).cast("long").alias("flip"), F.lit(n).alias("spent")) for x, n in ways])


def _deal(rows: DataFrame, depth: Column, bits: int, budget: int) -> DataFrame:
    """Rows of pairs of subtrees, ``bits`` further down: each goes to every pair below its own that the budget allows.

    Of a pair ``low < high`` the rows in ``high`` are ``upper``; a subtree is paired with itself by ``low = high``.
    """
    own = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64) - depth - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    one, upper = F.col("low") == F.col("high"), F.col("upper")
    spread = rows.withColumns({"own": own, "way": F.explode(F.filter(_flips(bits, budget), lambda w: w["spent"] <= F.col("rest")))})
    mine, other = F.col("own"), F.col("own").bitwiseXOR(F.col("way.flip"))
    below = lambda side, sub: F.col(side) * (1 << bits) + sub
    return spread.select(
        "fp",
        (depth + bits).cast("int").alias("depth"),
        below("low", F.when(one, F.least(mine, other)).when(upper, other).otherwise(mine)).alias("low"),
        below("high", F.when(one, F.greatest(mine, other)).when(upper, mine).otherwise(other)).alias("high"),
        F.when(one, mine > other).otherwise(upper).alias("upper"),
        (F.col("rest") - F.col("way.spent")).alias("rest"),
    )


def dealt_subtrees(prints: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE, overfull: int = OVERFULL) -> DataFrame:
    """``fp, depth, low, high, upper, rest``: the pairs of subtrees to walk, with what is left of the budget.

    The first depth grows with the number of fingerprints. Pairs are counted, and those with more
    than ``overfull`` are dealt on, four bits at a time, until none is left: so fingerprints that agree in
    many bits do not meet in one task. A pair of which one side is empty is dropped. A round writes only
    what is dealt on.
    """
    count = prints.count()
    depth = int(np.clip(np.ceil(np.log2(max(count, 1) / subtree)), *DEPTHS))
    root = prints.select(
        "fp", *[F.lit(0).cast("long").alias(c) for c in ("low", "high")], F.lit(False).alias("upper"), F.lit(budget).alias("rest")
    )
    dealt, keys, done = cut_lineage(_deal(root, F.lit(0), depth, budget)), ["depth", "low", "high"], None
    while True:
        sizes = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("upper").alias("n_upper"))
        both = (F.col("low") == F.col("high")) | ((F.col("n_upper") > 0) & (F.col("n_upper") < F.col("n")))
        over = (F.col("n") > overfull) & (F.col("depth") <= 64 - DEEPER)
        sizes = cut_lineage(sizes.filter(both).select(*[F.col(k).alias(f"_{k}") for k in keys], over.alias("over")))
        marked = dealt.join(sizes, [F.col(k) == F.col(f"_{k}") for k in keys]).drop(*[f"_{k}" for k in keys])
        fine = marked.filter(~F.col("over")).drop("over")
        done = fine if done is None else done.unionByName(fine)
        if sizes.filter("over").isEmpty():
            return done
        dealt = cut_lineage(_deal(marked.filter("over").drop("over"), F.col("depth"), DEEPER, budget))


def trie_links(prints: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE, overfull: int = OVERFULL) -> DataFrame:
    """``a, b``: links that connect all fingerprints of the column ``fp`` which differ in few bits.

    Values must be distinct. The topmost levels of the walk are dealt out by ``dealt_subtrees``. A
    task walks one pair of subtrees with what is left of the budget, and returns of the links it
    finds a spanning forest, so rows out never exceed fingerprints in.
    """

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        depth, low, high = (k.as_py() for k in key)
        fps, upper = table["fp"].to_numpy().view(np.uint64), table["upper"].to_numpy()
        left, right = np.sort(fps[~upper]), np.sort(fps[upper])
        links = []
        if low == high:
            links = walk(left, None, depth, budget)
        elif len(left) and len(right):
            links = walk(left, right, depth, budget - (low ^ high).bit_count())
        both = np.concatenate([left, right]).view(np.int64)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": both[a], "b": both[b]})

    dealt = dealt_subtrees(prints, budget, subtree, overfull)
    return dealt.drop("rest").groupBy("depth", "low", "high").applyInArrow(joined, "a long, b long")


def simhash_groups(
    docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """A row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that can be reached over fingerprints which differ in
    at most ``budget`` bits, the row's own included. Texts without words (NULL, empty) have
    fingerprint zero, which links like any other; a text shorter than a shingle is hashed as
    a whole. Rows that share an id keep a row each; a row without id is linked like the
    others, and a group of only such rows has no component id. Empty tables give no rows;
    other columns are not read, so their names don't matter.

    Fingerprints are made in Arrow batches and written once. Copies collapse: only distinct
    fingerprints are linked, so a group of copies is one row there. The class of each
    fingerprint is joined back on it; Spark splits a hot one.
    """
    found = docs.select(column(id_column).alias("id"), fingerprints(column(text_column), shingle).alias("fp"))
    prints = cut_lineage(found)
    groups = prints.groupBy("fp").agg(F.min("id").alias("least"))
    member = components(trie_links(groups.select("fp"), budget))  # only of fingerprints that have a link
    placed = groups.join(member, groups.fp == member.node, "left").withColumn("class", F.coalesce("component", "fp"))
    smallest = placed.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = placed.select("fp", "class").join(smallest, "class").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_column), digits.alias("fingerprint"), F.col("component_id")
    )


def simhash_dedup(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents whose id is the smallest of their group, unchanged.

    Rows that share such an id stay together; rows without id stay.
    """
    groups = simhash_groups(docs, id_column=id_column, **options)
    others = groups.filter(column(id_column) != F.col("component_id")).select(column(id_column).alias("copy")).distinct()
    return docs.join(others, docs[f"`{id_column}`"] == F.col("copy"), "left_anti")
