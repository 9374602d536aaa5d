from itertools import combinations

import pytest
import regex

from dwellspark.llm.decontaminate import MASKS, OVERLAP, SUBSTITUTED, decontaminate, leaks

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        for item_id, item in items:
            d, b = words(text), words(item)
            for i in range(len(d) - OVERLAP + 1):
                for j in range(len(b) - OVERLAP + 1):
                    if d[i] != b[j] and d[i + 1] != b[j + 1] and d[i + 2] != b[j + 2]:
                        continue
                    if sum(x != y for x, y in zip(d[i : i + OVERLAP], b[j : j + OVERLAP])) <= SUBSTITUTED and doc_id is not None:
                        out.setdefault((doc_id, item_id), set()).add(i)
    return sorted((*k, len(v), min(v), max(v) + OVERLAP) for k, v in out.items())


def test_masks_survive_all_placements():
    for wrong in combinations(range(OVERLAP), SUBSTITUTED):
        assert any(
            all(at + k not in wrong for k, c in enumerate(mask) if c == "1") for mask in MASKS for at in range(OVERLAP - len(mask) + 1)
        ), wrong


@pytest.mark.parametrize("limit", [0, 10**6])
def test_equals_brute_force_with_and_without_broadcast(spark, make, odd, limit):
    w = ITEM.split()
    docs = odd + [
        (20, "before " + ITEM + " after"), (21, " ".join(w[:12])), (22, " ".join(w[:13])), (23, " ".join([*w[:5], "x", *w[6:9], "y", *w[10:]])),
        (24, " ".join([*w[:5], "x", *w[6:7], "z", "y", *w[9:12], "q", "r"])), (25, ITEM.upper().replace(" ", "... ")), (26, ITEM + " " + ITEM), (26, "again " + ITEM),
    ]
    items = [(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, ITEM), (None, ITEM), (1, ITEM)]
    test = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, leaks(make(docs), test, broadcast_seeds=limit).collect()))
    assert got == brute(docs, [(1, ITEM), (5, ITEM)])
    assert {r[0] for r in got} == {20, 22, 23, 25, 26}


def test_clean_documents_stay(spark, make, odd):
    docs = make(odd + [(30, "x " + ITEM)])
    test = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    kept = decontaminate(docs, test)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in odd), key=repr)
    assert kept.columns == docs.columns
    assert decontaminate(docs.limit(0), test).count() == 0
    assert decontaminate(docs, test.limit(0)).count() == docs.count()


def test_query_equals_brute_force(spark, folder):
    from dwellspark.llm.queries import op3_decontaminate

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = sorted(map(tuple, op3_decontaminate(spark, folder).collect()))
    shared = {g for _, t in items for g in zip(*[words(t)[k:] for k in range(4)])}
    near = [(i, t) for i, t in docs if shared & set(zip(*[words(t)[k:] for k in range(4)]))]  # two in 13 leave four in a row
    assert got == brute(near, items) and got
