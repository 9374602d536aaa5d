import random

import numpy as np
import pytest
import xxhash

from dwellspark.llm.components import components
from dwellspark.llm.simhash import dealt_subtrees, fingerprint, simhash_dedup, simhash_groups, trie_links, walk


def words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] if word else out, ""
        else:
            word += c
    return out + [word] if word else out


def print_of(text, shingle=3):
    w = words(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(pairs):
    """Smallest id by brute force over all pairs of (id, fingerprint)."""
    root = {p: p for _, p in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = list(root)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                root[find(a)] = find(b)
    least = {}
    for doc_id, p in pairs:
        if doc_id is not None:
            least[find(p)] = min(least.get(find(p), doc_id), doc_id)
    return sorted(((i, f"{p:016x}", least.get(find(p))) for i, p in pairs), key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark, folder, documents):
    from dwellspark.llm.queries import op6_simhash

    assert found(op6_simhash(spark, folder)) == classes([(r.doc_id, print_of(r.text)) for r in documents.collect()])


def test_odd_rows(make, odd):
    rows = odd + [(20, "ONE two three four"), (21, "one TWO\nthree four"), (22, "one two"), (23, "a a a a a a"), (24, "word")]
    df = simhash_groups(make(rows))
    assert found(df) == classes([(i, print_of(t)) for i, t in rows]) and df.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.component_id for r in df.collect() if r.fingerprint == "0" * 16} == {1}
    assert simhash_groups(make(rows).limit(0)).collect() == []
    kept = simhash_dedup(make(rows))
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 1, 4, 5, 7, 20, 22, 23] and kept.columns == make(rows).columns
    assert simhash_groups(make([(None, "a")])).collect()[0].component_id is None


def test_long_text_in_blocks():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprint(text) == print_of(text)


@pytest.mark.parametrize("depth, many", [(0, 400), (3, 900)])
def test_walk_connects_all_near_values(depth, many):
    rng = random.Random(depth)
    base = [rng.getrandbits(64 - depth) for _ in range(many // 9)]
    values = sorted({b ^ sum(1 << rng.randrange(64 - depth) for _ in range(rng.randrange(4))) % 2 ** (64 - depth) for b in base for _ in range(9)})
    values = [v % 2 ** (64 - depth) for v in values]
    values = sorted(set(values))
    left = np.array(values, np.uint64)
    parts = lambda links, n: _parts(links, n)
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    links = walk(left, None, depth, 2)
    assert parts(links, len(values)) == parts(near, len(values)) and len(links) < len(values)
    right = np.array(sorted({v ^ 1 << rng.randrange(64 - depth) for v in values[::3]}), np.uint64)
    near = [(i, len(left) + j) for i, a in enumerate(left.tolist()) for j, b in enumerate(right.tolist()) if (a ^ b).bit_count() <= 1]
    assert parts(walk(left, right, depth, 1), len(left) + len(right)) == parts(near, len(left) + len(right))


def _parts(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_a_dense_group_is_linked_without_all_pairs(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)} | {rng.getrandbits(64) for _ in range(500)}
    rows = [(p - (p >> 63 << 64),) for p in prints]
    links = trie_links(spark.createDataFrame(rows, "fp bigint").repartition(4))
    got = [tuple(r) for r in links.collect()]
    assert len(got) < 22 * len(prints)
    member = dict(components(spark.createDataFrame(got, "a bigint, b bigint")).collect())
    dense = {p - (p >> 63 << 64) for p in prints if (p ^ centre).bit_count() <= 2}
    assert len({member[x] for x in dense}) == 1 and all((x in dense) == (member[x] == min(dense)) for x in member if x in dense)


def test_prefixes_that_half_of_all_share_are_dealt_on(spark):
    rng = random.Random(6)
    top = rng.getrandbits(20) << 44
    hot = [top | rng.getrandbits(44) for _ in range(1500)]
    prints = {*hot, *[rng.getrandbits(64) for _ in range(1500)]}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in rng.sample(sorted(prints), 600)}
    signed = lambda p: p - (p >> 63 << 64)
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint").repartition(4)
    dealt = dealt_subtrees(rows, 2, 64, 200).cache()
    largest = dealt.groupBy("depth", "low", "high").count().agg({"count": "max"}).first()[0]
    assert largest <= 200 and dealt.selectExpr("max(depth)").first()[0] > 20
    assert dealt.count() < 60 * len(prints)
    links = [tuple(r) for r in trie_links(rows, 2, 64, 200).collect()]
    order = {signed(p): n for n, p in enumerate(sorted(prints))}
    values = sorted(prints)
    near = [(i, j) for i, x in enumerate(values) for j in range(i) if (x ^ values[j]).bit_count() <= 2]
    assert near and _parts([(order[a], order[b]) for a, b in links], len(values)) == _parts(near, len(values))


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 301), (301, 302), (302, 300), (5, 5), (7, 7)]
    random.Random(2).shuffle(links)
    got = dict(components(spark.createDataFrame(links + links[:9], "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 200)}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
