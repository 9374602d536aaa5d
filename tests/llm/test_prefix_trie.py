import random
import zlib
from hashlib import sha256

import pytest

from dwellspark.llm import prefix_trie as P
from dwellspark.llm.queries import op12_prefix_trie
from dwellspark.llm.running import running

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, depth string"


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + own[c][zlib.crc32(str(c).encode()) % 9 :] for c in own}
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(tuple(built[c][:d]), []).append(c)
    children = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = (len(nodes[node]) - 1) * len(node[-1][1].encode() if node else b"") + sum(saved[b] for b in below)
    return sorted(
        (
            m[0], len(n), nodes[n[:-1]][0] if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n],
            sha256(",".join(str(c) for c in m if len(built[c]) == len(n)).encode()).hexdigest(),
        )
        for n, m in nodes.items()
    )


def trie(spark, rows, **options):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, P.prefix_trie(P.with_borrowed_beginnings(P.turn_ids(df)), **options).collect()))


def made(seed):
    rng = random.Random(seed)
    texts = ["a", "", None, "é", "long " * 20_000]
    rows = []
    for conv in rng.sample(range(200), 60):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 17, 30])):
            rows.append((conv, turn if turn or conv % 3 else None, rng.choice(["user", None]), rng.choice(texts[:4]) if turn > 2 or conv % 7 else texts[4]))
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
def test_equals_brute_force_at_any_width(spark, width):
    rows = made(width)
    assert trie(spark, rows, width=width) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (0, None, None, None), (0, 0, None, None), (7, 3, "user", "y"), (7, 3, "user", "y"), (9, 1, "a", "b"), (9, 2, "a", "b")]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(40) for t in range(12)]
    assert trie(spark, rows) == brute(rows)
    assert any(r[1] == 0 and r[7] != sha256().hexdigest() for r in trie(spark, rows)), "a turnless conversation ends at the root"
    assert trie(spark, rows[:1]) == [] and trie(spark, [(5, 0, "u", "t")]) == brute([(5, 0, "u", "t")])


def test_running_totals_of_a_key_in_many_parts(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.randrange(100)) for i in range(5000)] + [(k, i, 1) for k in (0, 2, 3, None) for i in range(3)]
    got = running(spark.createDataFrame(rows, "k bigint, i bigint, v bigint").repartition(5), "k", ["i"], {"s": "v"}, {"x": "v"}).collect()
    expected, total, mixed = {}, {}, {}
    for k, i, v in rows:
        total[k], mixed[k] = total.get(k, 0) + v, mixed.get(k, 0) ^ v
        expected[k, i] = (i, total[k], mixed[k])
    assert {(r.k, r.i): (r.place, r.s, r.x) for r in got} == expected and len(got) == len(rows)


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, op12_prefix_trie(spark, folder).collect()))
    assert got == brute(rows) and max(r[6] for r in got) > 0
