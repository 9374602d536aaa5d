"""Conversation structure repair: the cheapest edits to alternating turns, by a square-root checkpointed DP.

A conversation is a row of codes, one per turn. The DP goes backward over them: for each of four
places in the pattern ``(system? (user assistant)+)?`` the least cost of repairing what follows.
These vectors are kept only at checkpoints; walking forward, a block's vectors are computed again
from the checkpoint behind it, and of the edits that keep to the least cost the first in ASCII
order is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.llm.rows import BLANKS, column, hash_pair
from dwellspark.session import cut_lineage

#: Rows of a conversation that are looked at together; longer ones are several blocks, each in some task.
BLOCK = 4096
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Places in the pattern: before it, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that comes next at each place. A kept system turn may come at ``START`` besides.
NEXT = (USER, USER, ASSISTANT, USER)
#: What a row's code holds: its role's initial, plus four times its fault.
INITIALS, SOUND, MUST_GO, CUT_SHORT = " sua", 0, 4, 8
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What the end of a conversation costs at each place: turns that still have to be inserted.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with the damage that crc32 of ``conv_id:turn`` modulo 20 asks for.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes
    its role ``user``. NULL is one space, in the hashed key, role and text; ids and turns stay NULL.
    """
    fate = F.crc32(F.concat_ws(":", *[F.coalesce(column(c).cast("string"), F.lit(" ")) for c in (conv, turn)])) % 20
    own = F.coalesce(column(text), F.lit(" "))
    damaged = rows.select(
        column(conv).alias("conv_id"),
        column(turn).alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(F.coalesce(column(role), F.lit(" "))).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(own, ".!?", "")).otherwise(own).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("times"),
    )
    return damaged.withColumn("time", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("time", "times")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equal keys, NULL being equal to NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & a[key].eqNullSafe(b[key])
    return condition


def coded_turns(rows: DataFrame) -> DataFrame:
    """A narrow row for each distinct ``conv_id, turn, role`` and text hash: ``copies``, ``initial``, ``fault``.

    ``fault`` is the first that holds of the first copy: ``blank`` (only ASCII white space), ``duplicate``
    (an earlier turn has its role and text), ``truncated`` (does not end in ``.!?``); further copies are
    duplicates. Counting combines on the map side; only the repeated texts of a conversation, one row
    each, are joined back, so that neither a hot text nor a hot conversation meets in one task.
    """
    trimmed = F.btrim("text", F.lit(BLANKS))
    own = F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(*".!?"), "truncated").otherwise("")
    keys = ["conv_id", "turn", "role", "h1", "h2"]
    turns = rows.select("conv_id", "turn", "role", *hash_pair(F.col("text")), own.alias("own"))
    turns = cut_lineage(turns.groupBy(*keys, "own").agg(F.count(F.lit(1)).alias("copies")))
    text = ["conv_id", "role", "h1", "h2"]
    repeated = (
        turns.groupBy(*text)
        .agg(F.count(F.lit(1)).alias("places"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("first"))
        .filter("places > 1")
        .select(*[F.col(c).alias(f"_{c}") for c in text], "unnumbered", "first")
    )
    condition = F.lit(True)
    for name in text:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_{name}"))
    later = F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    fault = F.when(F.col("own") == "blank", "blank").when(F.coalesce(later, F.lit(False)), "duplicate").otherwise(F.col("own"))
    return turns.join(repeated, condition, "left").select(*keys, "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _sooner(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a row, from that after it."""
    fault, initial = code & 12, code & 3
    costs = [DELETE + after[x] for x in range(4)]
    if fault != MUST_GO:
        more = TRUNCATED if fault == CUT_SHORT else 0
        for x in range(4):
            to = NEXT[x]
            costs[x] = min(costs[x], (0 if initial == to else REROLE) + more + after[to])
        if initial == SYSTEM:
            costs[START] = min(costs[START], more + after[SYSTEM])
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant


def matrix(codes: bytes) -> list[int]:
    """Least costs from each place before a block (rows) to each place after it (columns)."""
    columns = []
    for to in range(4):
        costs = tuple(0 if x == to else FAR for x in range(4))
        for code in reversed(codes):
            costs = tuple(min(c, FAR) for c in _sooner(code, costs))
        columns.append(costs)
    return [columns[to][x] for x in range(4) for to in range(4)]


def walk(codes: bytes, behind: tuple[int, ...], starts: list[int], last: bool) -> tuple[list[str], list[int]]:
    """For each place to start from: the ASCII-least edits (of the last block with those at its end), and the place after them.

    ``behind`` is the cost vector after the block. Of the vectors inside only every square root
    of the rows is stored; those between are computed again while walking.
    """
    n = len(codes)
    size = max(1, math.isqrt(n))
    marks, costs = {n: behind}, behind
    for i in range(n - 1, -1, -1):
        costs = _sooner(codes[i], costs)
        if i % size == 0:
            marks[i] = costs
    edits: list[list[str]] = [[] for _ in starts]
    places = list(starts)
    for begin in range(0, n, size):
        end = min(begin + size, n)
        inside = [marks[end]]
        for i in range(end - 1, begin - 1, -1):
            inside.append(_sooner(codes[i], inside[-1]))
        inside.reverse()
        for which in range(len(places)):
            x, said = places[which], edits[which]
            for i in range(begin, end):
                x = _one_row(codes[i], x, inside[i - begin], inside[i - begin + 1], said)
            places[which] = x
    if last:
        for which in range(len(places)):
            while behind[places[which]]:
                places[which] = NEXT[places[which]]
                edits[which].append("I")
    return ["".join(said) for said in edits], places


def _one_row(code: int, x: int, here: tuple[int, ...], after: tuple[int, ...], said: list[str]) -> int:
    """Adds the edits up to and with a row; the place after it. D, I, K, R is their order in ASCII."""
    fault, initial = code & 12, code & 3
    more = TRUNCATED if fault == CUT_SHORT else 0
    while True:
        left, to = here[x], NEXT[x]
        if DELETE + after[x] == left:
            said.append("D")
            return x
        if INSERT + here[to] == left:
            said.append("I")
            x = to
            continue
        assert fault != MUST_GO
        if initial == to and more + after[to] == left:
            said.append("K")
            return to
        if x == START and initial == SYSTEM and more + after[SYSTEM] == left:
            said.append("K")
            return SYSTEM
        said.append("R")
        return to


_KEYS = "array<struct<turn:{turn},role:string,h1:bigint,h2:bigint,copies:bigint>>"
_BLOCKS = "conv_id {conv}, block bigint, whole boolean, n_blank bigint, n_duplicate bigint, n_truncated bigint, n_illegal bigint, first string, last string, codes binary, turns {keys}"
_COUNTS = ("n_blank", "n_duplicate", "n_truncated", "n_illegal")


def _cut_into_blocks(schema: pa.Schema, block_rows: int):
    """Sorted turns to blocks. A conversation between two others in one task is whole; others may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, held, done = TaskContext.get().partitionId() << 33, 0, 0, []
        conv, alone, codes, keys, counts, initials = None, False, bytearray(), [], [0] * 4, [None, None]

        def flush(ended: bool) -> None:
            nonlocal number, held
            done.append((conv, base + number, alone and ended, *counts, *initials, bytes(codes), list(keys)))
            number, held = number + 1, held + len(codes)
            codes.clear()
            keys.clear()
            counts[:], initials[:] = [0] * 4, [None, None]

        def batch() -> pa.RecordBatch:
            columns = [pa.array(values, field.type) for values, field in zip(zip(*done), schema)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        began = False
        for rows in batches:
            for row in rows.to_pylist():
                if not began or row["conv_id"] != conv:
                    if codes:
                        flush(True)
                    conv, alone, began = row["conv_id"], began, True
                copies, fault, initial = row["copies"], row["fault"], row["initial"]
                keys.append({name: row[name] for name in ("turn", "role", "h1", "h2", "copies")})
                for copy in range(copies):
                    if len(codes) >= block_rows:
                        rest = {**keys.pop(), "copies": copies - copy}
                        if copy:
                            keys.append({**rest, "copies": copy})
                        flush(False)
                        alone = False
                        keys.append(rest)
                    own = fault if copy == 0 or fault == "blank" else "duplicate"
                    kind = {"": SOUND, "truncated": CUT_SHORT}.get(own, MUST_GO)
                    codes.append(kind + max(0, INITIALS.find(initial) if initial else 0))
                    if own:
                        counts[("blank", "duplicate", "truncated").index(own)] += 1
                    if initials[0] is None:
                        initials[0] = initial
                    else:
                        counts[3] += initials[1] + initial not in ("su", "ua", "au")
                    initials[1] = initial
                if held > 4 * block_rows:
                    held = 0
                    yield batch()
        if codes:
            flush(False)
        if done:
            yield batch()

    return run


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _rows_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema, each, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of the tuples that ``each`` gives for every row."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(values, field.type) for values, field in zip(zip(*out), schema)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for rows in batches:
        for row in rows.to_pylist():
            for made in each(row):
                out.append(made)
                if len(out) >= most:
                    yield batch()
    if out:
        yield batch()


def _mapped(df: DataFrame, schema: str, each) -> DataFrame:
    arrow = _arrow(schema, df.sparkSession)
    return df.mapInArrow(lambda batches: _rows_of(batches, arrow, each), schema)


def _checkpoints(row: dict) -> Iterator[tuple]:
    """The vector behind each block of a conversation, from the last block on."""
    behind, blocks = END, row["blocks"]
    for at in range(len(blocks) - 1, -1, -1):
        yield row["conv_id"], blocks[at]["block"], list(behind), at == len(blocks) - 1
        m = blocks[at]["matrix"]
        behind = tuple(min(m[4 * x + to] + behind[to] for to in range(4)) for x in range(4))


def _chosen(row: dict) -> Iterator[tuple]:
    """Of each block's walks that which starts where the block before ended."""
    place = START
    for block in row["blocks"]:
        yield row["conv_id"], block["block"], place
        place = block["places"][place]


def _expanded(row: dict) -> Iterator[tuple]:
    """A row per edit of a block."""
    place, audit = row["start"], row["audit"]
    if audit is None:
        place, audit = START, walk(row["codes"], END, [START], True)[0][0]
    rows = zip(row["codes"], (turn for turn in row["turns"] for _ in range(turn["copies"])))
    for step, edit in enumerate(audit):
        if edit == "I":
            place = NEXT[place]
            yield row["conv_id"], row["block"], step, edit, ROLES[place], INSERT, None, None, None, None
            continue
        code, turn = next(rows)
        if edit == "D":
            yield row["conv_id"], row["block"], step, edit, None, DELETE, turn["turn"], None, None, None
            continue
        place = SYSTEM if edit == "K" and code & 3 == SYSTEM else NEXT[place]
        cost = (REROLE if edit == "R" else 0) + (TRUNCATED if code & 12 == CUT_SHORT else 0)
        yield row["conv_id"], row["block"], step, edit, turn["role"] if edit == "K" else ROLES[place], cost, turn["turn"], turn["role"], turn["h1"], turn["h2"]


def cheapest_edits(turns: DataFrame, block_rows: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks of coded turns with their counts, and a row per edit.

    Turns are range-sorted by conversation, turn, role and text hash, so a conversation of any
    length is dealt over tasks. A task cuts what it reads into blocks of ``block_rows``. Whole
    conversations of one block are walked at once. Of the others each block gives a matrix of
    costs between places; a conversation's matrices, one small row a block, give the vectors at
    the block borders; each block is walked from every place, and the walks are linked up.
    """
    spark = turns.sparkSession
    conv, turn = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    order = ["conv_id", "turn", "role", "h1", "h2"]
    schema = _BLOCKS.format(conv=conv, keys=_KEYS.format(turn=turn))
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = cut_lineage(dealt.mapInArrow(_cut_into_blocks(_arrow(schema, spark), block_rows), schema))

    parts = blocks.filter(~F.col("whole"))
    ids = [F.col("conv_id"), F.col("block")]
    matrices = _mapped(
        parts.select(*ids, "codes"), f"conv_id {conv}, block bigint, matrix array<bigint>", lambda r: [(r["conv_id"], r["block"], matrix(r["codes"]))]
    )
    listed = lambda df, name: df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", name))).alias("blocks"))
    marks = _mapped(listed(matrices, "matrix"), f"c {conv}, b bigint, behind array<bigint>, is_last boolean", _checkpoints)
    walked = cut_lineage(
        _mapped(
            parts.join(marks, F.col("block") == F.col("b")).select(*ids, "codes", "behind", "is_last"),
            f"conv_id {conv}, block bigint, audits array<string>, places array<int>",
            lambda r: [(r["conv_id"], r["block"], *walk(r["codes"], tuple(r["behind"]), [*range(4)], r["is_last"]))],
        )
    )
    starts = _mapped(listed(walked, "places"), f"c {conv}, b bigint, start int", _chosen)
    linked = walked.join(starts, F.col("block") == F.col("b")).select(
        F.col("b"), "start", F.get("audits", F.col("start")).alias("audit")
    )
    wanted = [*ids, F.col("codes"), F.col("turns")]
    whole = blocks.filter("whole").select(*wanted, F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("audit"))
    rest = parts.join(linked, F.col("block") == F.col("b")).select(*wanted, "start", "audit")
    edits = _mapped(
        whole.unionByName(rest),
        f"conv_id {conv}, block bigint, step int, edit string, role string, cost bigint, turn {turn}, old_role string, h1 bigint, h2 bigint",
        _expanded,
    )
    return blocks, edits


def repair(rows: DataFrame, block_rows: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Repaired turns and counts, of ``conv_id, turn, role, text``.

    The first has a row per edit in the order of ``conv_id, block, step``: ``edit`` (K keep, R give
    another role, I insert, D delete), the ``cost``, the turn it comes from, and the ``role`` and
    ``text`` it leaves (of D: NULL). The rows that are left spell ``(system? (user assistant)+)?``
    by the initials of their roles (case counts), at the least cost; of equal costs the edits' initials
    are the least in ASCII. The second has ``conv_id, gaps, blank, duplicate, truncated, illegal``.

    Turns are in the order of ``turn`` (NULL first); those of one turn go by role and text hash, so
    equal ones are neighbours. NULL roles and texts are one space; a NULL ``conv_id`` is a conversation
    of its own. Other columns are not read. No rows in, no rows out.
    """
    own = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    turns = cut_lineage(coded_turns(own))
    blocks, edits = cheapest_edits(turns, block_rows)
    edits = cut_lineage(edits)
    keys = ["conv_id", "turn", "role", "h1", "h2"]
    texts = own.select(*keys[:3], *hash_pair(F.col("text")), "text").groupBy(*keys).agg(F.first("text").alias("text"))
    kept = edits.filter(F.col("edit").isin("K", "R"))
    condition = kept["conv_id"].eqNullSafe(texts["conv_id"]) & kept["turn"].eqNullSafe(texts["turn"])
    for left, right in (("old_role", "role"), ("h1", "h1"), ("h2", "h2")):
        condition = condition & (kept[left] == texts[right])
    names = ["conv_id", "block", "step", "edit", "turn", "cost", "role"]
    kept = kept.join(texts, condition).select(*[kept[c] for c in names], texts["text"])
    other = edits.filter(F.col("edit").isin("I", "D")).select(*names, F.when(F.col("edit") == "I", "").alias("text"))

    numbered = turns.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = numbered.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    # Neighbours across block borders are counted from the blocks' first and last initials, one row a block.
    ends = F.sort_array(F.collect_list(F.struct("block", "first", "last"))).alias("ends")
    sums = blocks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in _COUNTS], ends)
    crossed = F.aggregate(
        F.sequence(F.lit(1), F.size("ends") - 1),
        F.lit(0).cast("long"),
        lambda n, i: n + (~F.concat(F.get("ends", i - 1)["last"], F.get("ends", i)["first"]).isin("su", "ua", "au")).cast("long"),
    )
    illegal = F.col("n_illegal") + F.when(F.size("ends") > 1, crossed).otherwise(0)
    counts = sums.join(gaps, _same(sums, gaps, ["conv_id"])).select(
        sums["conv_id"], "gaps", *[F.col(f"n_{c}").alias(c) for c in ("blank", "duplicate", "truncated")], illegal.alias("illegal")
    )
    return kept.unionByName(other), counts


def digests(edits: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, repaired_sha256`` of each conversation's edits in order.

    A hash over a conversation has to see its rows one after the other; they are sorted, stream
    through a task, and only the hash and the edits' initials are held.
    """
    conv = edits.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, cost bigint, audit string, repaired_sha256 string"
    arrow = _arrow(schema, edits.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def changes() -> Iterator[tuple]:
            conv, began, cost, audit, digest, first = None, False, 0, [], sha256(), True
            for rows in batches:
                for row in rows.to_pylist():
                    if not began or row["conv_id"] != conv:
                        if began:
                            yield conv, cost, "".join(audit), digest.hexdigest()
                        conv, began, cost, audit, digest, first = row["conv_id"], True, 0, [], sha256(), True
                    cost += row["cost"]
                    audit.append(row["edit"])
                    if row["edit"] != "D":
                        digest.update(f"{'' if first else chr(10)}{row['role']}:{row['text']}".encode())
                        first = False
            if began:
                yield conv, cost, "".join(audit), digest.hexdigest()

        out = []
        for made in changes():
            out.append(made)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    order = ["conv_id", "block", "step"]
    wanted = edits.select(*order, "cost", "edit", "role", "text")
    return wanted.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def repair_report(original: DataFrame, damaged: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """A row for each conversation of ``original``: the counts, cost, audit and hash of its damaged rows' repair.

    A conversation without damaged rows has zeros, an empty audit and the hash of the empty string.
    """
    edits, counts = repair(damaged, block_rows)
    audits = digests(edits)
    ids = original.select("conv_id").distinct()
    rows = ids.join(counts, _same(ids, counts, ["conv_id"]), "left").join(audits, _same(ids, audits, ["conv_id"]), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = sha256().hexdigest()
    return rows.select(
        ids["conv_id"],
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
