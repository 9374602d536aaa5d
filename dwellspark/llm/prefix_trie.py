"""Conversation prefix trie: all shared beginnings of conversations in one ROLLUP over positional turn ids."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.llm.rows import column, hash_pair
from dwellspark.llm.running import running
from dwellspark.session import cut_lineage

#: Turn-id columns of a block; a longer conversation goes on in further blocks.
WIDTH = 8


def turn_ids(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, h1, h2, n_bytes``: a 128-bit id of role and text for each turn, at its place from 0.

    Turns go by ``turn``, NULL first, those of one turn by role and text hash. NULL role or text
    is empty. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    own = rows.filter(column(conv).isNotNull()).select(
        column(conv).cast("long").alias("conv_id"),
        column(turn).alias("turn"),
        F.coalesce(column(role), F.lit("")).alias("role"),
        F.coalesce(column(text), F.lit("")).alias("text"),
    )
    whole = F.struct("role", "text")
    named = own.select("conv_id", "turn", "role", *hash_pair(whole), F.octet_length("text").cast("long").alias("n_bytes"))
    return running(named, "conv_id", ["turn", "role", "h1", "h2"]).drop("turn", "role")


def with_borrowed_beginnings(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt: the first h turns of ``conv_id - conv_id % group``, then their own after the first h.

    h is crc32 of the decimal ``conv_id`` modulo ``most``. Of the lending conversation all turns
    are taken if it has fewer, and none if it is absent. Only its first ``most - 1`` turns are
    read, so each is sent to at most ``group`` conversations. A row with NULL ids stands for every
    conversation besides (place -1), so that one without turns is not lost.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    lent = turns.filter(F.col("place") < most - 1)
    # One conversation lends to those of its group; which of them exist comes with their first turns.
    heads = turns.filter("place = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("lender"), h.alias("h"))
    begun = heads.join(lent.withColumnRenamed("conv_id", "lender"), "lender").filter(F.col("place") < F.col("h"))
    begun = begun.select("conv_id", "place", "h1", "h2", "n_bytes")
    sizes = lent.groupBy(F.col("conv_id").alias("lender")).agg(F.count(F.lit(1)).alias("has"))
    shifts = heads.join(sizes, "lender", "left").select(
        "conv_id", "h", (F.least("h", F.coalesce("has", F.lit(0))) - F.col("h")).alias("shift")
    )
    moved = shifts.filter("shift < 0").select(F.col("conv_id").alias("short"), "shift")  # lenders with fewer turns
    rest = turns.filter(F.col("place") >= h).join(moved, F.col("conv_id") == F.col("short"), "left")
    rest = rest.select("conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), "h1", "h2", "n_bytes")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "n_bytes")]
    return begun.union(rest).union(heads.select("conv_id", F.lit(-1).cast("long"), *nothing))


def _mark(place: Column, turn: Column, seed: int) -> Column:
    """What a turn at a place adds to the print of a beginning."""
    return F.when(turn.isNotNull(), F.xxhash64(F.lit(seed), place, turn["h1"], turn["h2"])).otherwise(0)


def _blocks(turns: DataFrame, width: int) -> DataFrame:
    """A row for each block of a conversation: the print of what is before it, its turn ids and their bytes."""
    turn, at = F.when(F.col("h1").isNotNull(), F.struct("h1", "h2")), F.greatest("place", F.lit(0))
    cells = turns.select("conv_id", at.alias("place"), turn.alias("turn"), "n_bytes")
    mine = [F.when(F.col("place") % width == i, F.col("turn")) for i in range(width)]
    bytes_ = [F.when(F.col("place") % width == i, F.col("n_bytes")) for i in range(width)]
    blocks = cells.groupBy("conv_id", F.floor(F.col("place") / width).alias("block")).agg(
        *[F.max(c).alias(f"t{i}") for i, c in enumerate(mine)],
        *[F.max(c).alias(f"b{i}") for i, c in enumerate(bytes_)],
        F.bit_xor(_mark(F.col("place"), F.col("turn"), 1)).alias("x1"),
        F.bit_xor(_mark(F.col("place"), F.col("turn"), 2)).alias("x2"),
    )
    blocks = cut_lineage(blocks)
    full = blocks.filter(F.col(f"t{width - 1}").isNotNull()).select("conv_id", "block", "x1", "x2")
    behind = running(full, "conv_id", ["block"], xors={"k1": "x1", "k2": "x2"})
    behind = behind.select(F.col("conv_id").alias("c"), (F.col("block") + 1).alias("b"), "k1", "k2")
    keyed = blocks.join(behind, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b", "x1", "x2")
    return cut_lineage(keyed.withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in ("k1", "k2")}))


def _rolled_up(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """``depth, f1, f2`` (the print of the node's turns), its parent's print, and ``sums`` over its members."""
    ids = ", ".join(f"t{i}" for i in range(width))
    groups = blocks.sparkSession.sql(
        f"select block, k1, k2, {ids}, {width} - bit_count(grouping_id()) as d, {sums} from {{blocks}} group by block, k1, k2, rollup({ids})",
        blocks=blocks,
    )
    turns = [F.col(f"t{i}") for i in range(width)]
    # A level whose last turn is missing counts conversations that are shorter; a later block's level 0 is the block before's last.
    real = F.when(F.col("d") == 0, F.col("block") == 0).otherwise(F.get(F.array(*turns), (F.col("d") - 1).cast("int")).isNotNull())

    def print_of(k: str, seed: int, levels: Column) -> Column:
        marks = [F.when(levels > i, _mark(F.col("block") * width + i, t, seed)).otherwise(0) for i, t in enumerate(turns)]
        out = F.col(k)
        for mark in marks:
            out = out.bitwiseXOR(mark)
        return out

    prints = {f"f{seed}": print_of(f"k{seed}", seed, F.col("d")) for seed in (1, 2)}
    prints |= {f"p{seed}": print_of(f"k{seed}", seed, F.col("d") - 1) for seed in (1, 2)}
    kept = groups.filter(real).withColumns({"depth": F.col("block") * width + F.col("d"), **prints})
    return kept.drop("block", "k1", "k2", *[f"t{i}" for i in range(width)])


def _id_digests(ends: DataFrame) -> DataFrame:
    """``depth, f1, f2, ends_sha256`` of the ids that end there; they stream through a task in order, only the hash is held."""
    arrow = pa.schema([("d", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, sha256(), []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return made

        for rows in batches:
            for *at, conv in zip(*[c.to_pylist() for c in rows.columns]):
                if at != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = at, sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
                if len(out) >= 10_000:
                    yield batch()
        if node is not None:
            out.append((*node, digest.hexdigest()))
            yield batch()

    keys = ["depth", "f1", "f2"]
    dealt = ends.select(*keys, "conv_id").repartition(*keys).sortWithinPartitions(*keys, "conv_id")
    return dealt.mapInArrow(run, "d bigint, e1 bigint, e2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of conversations ``conv_id, place, h1, h2, n_bytes`` (places gapless from 0; -1: stands for the conversation).

    A node is a distinct sequence of first turns; ``conv_id`` and ``depth`` name it by its smallest
    member. Columns: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. No conversations, no nodes; with one there is the root.

    A conversation's turn ids stand in ``width`` columns, block after block; a block is keyed by the
    128-bit print of the node before it, so ROLLUP makes the nodes of all lengths at once and its
    partial counts leave one row per task of a beginning that very many share. What a subtree sums up is
    given to members: each node belongs to its smallest member, each conversation owns the
    nodes from some depth to its end, so a node's subtree has all that its other members own, and of what its
    owner owns the part from the node down.
    """
    blocks = _blocks(turns, width)
    last = ", ".join(f"max(b{i}) as m{i}" for i in range(width))
    nodes = _rolled_up(blocks, width, f"min(conv_id) as conv_id, count(1) as n_convs, {last}")
    at = (F.col("d") - 1).cast("int")
    weight = F.when(F.col("d") > 0, F.get(F.array(*[f"m{i}" for i in range(width)]), at)).otherwise(0)
    nodes = cut_lineage(
        nodes.withColumn("value", (F.col("n_convs") - 1) * weight).drop("d", *[f"m{i}" for i in range(width)])
    )
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("d"), F.col("p1").alias("e1"), F.col("p2").alias("e2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    same = (F.col("depth") == F.col("d")) & (F.col("f1") == F.col("e1")) & (F.col("f2") == F.col("e2"))
    nodes = nodes.join(children, same, "left").drop("d", "e1", "e2").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut_lineage(nodes)

    owned = nodes.groupBy(F.col("conv_id").alias("owner")).agg(
        F.sum("value").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    weighed = blocks.join(owned, F.col("conv_id") == F.col("owner"), "left")
    sums = _rolled_up(weighed, width, "coalesce(sum(owned), 0) as all_owned, coalesce(sum(leaf), 0) as n_leaves")
    sums = sums.select(F.col("depth").alias("d"), F.col("f1").alias("e1"), F.col("f2").alias("e2"), "all_owned", "n_leaves")
    placed = running(nodes, "conv_id", ["depth"], sums={"so_far": "value"})
    counted = placed.join(sums, same).drop("d", "e1", "e2")
    # What its owner owns above the node is not below it.
    counted = cut_lineage(counted.withColumn("saved_tokens", F.col("all_owned") - F.col("so_far") + F.col("value")))

    parents = counted.select(F.col("depth").alias("d"), F.col("f1").alias("e1"), F.col("f2").alias("e2"), F.col("conv_id").alias("parent_conv_id"))
    above = (F.col("depth") - 1 == F.col("d")) & (F.col("p1") == F.col("e1")) & (F.col("p2") == F.col("e2"))
    counted = counted.join(parents, above, "left").drop("d", "e1", "e2")
    ends = turns.groupBy("conv_id").agg(
        F.count("h1").alias("depth"),
        *[F.bit_xor(_mark(F.col("place"), F.when(F.col("h1").isNotNull(), F.struct("h1", "h2")), seed)).alias(f"f{seed}") for seed in (1, 2)],
    )
    counted = counted.join(_id_digests(ends), same, "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    empty = F.coalesce("ends_sha256", F.lit(sha256().hexdigest()))
    return counted.select(*[F.col(c).cast("long").alias(c) for c in columns], empty.alias("ends_sha256"))
