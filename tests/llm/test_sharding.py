import zlib
from collections import defaultdict

import pytest

from dwellspark.llm.sharding import shard_records


def law(rows, shards, slack):
    """Slots gapless, every row once, shards as near in bytes as a slack allows."""
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(size.values()) / shards
    assert set(slots) <= set(range(shards))
    assert all(abs(size[s] - mean) <= slack for s in range(shards)), (mean, sorted(size.values()))


def test_shards_are_near_equal(documents):
    rows = shard_records(documents, 7).collect()
    truth = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {
        i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in truth.items()
    }
    law(rows, 7, 1.5 * max(r["size"] for r in rows))


def test_a_text_that_a_third_has_is_split_and_small_groups_stay_together(spark):
    texts = [(i, "hot text " * 40) for i in range(3000)] + [(9000 + i, f"text {i % 2000} " * (1 + i % 30)) for i in range(6000)]
    rows = shard_records(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5), 40).collect()
    law(rows, 40, 0.08 * sum(r["size"] for r in rows) / 40 + 1000)
    homes = defaultdict(set)
    for r in rows:
        homes[r.text].add(r.shard)
    assert len(homes["hot text " * 40]) > 5
    assert [t for t, h in homes.items() if len(h) > 1] == ["hot text " * 40]


def test_query_keeps_the_law_and_groups_of_copies(spark, folder, documents):
    from dwellspark.llm.queries import op5_sharding
    from dwellspark.llm.sharding import RANGES

    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = op5_sharding(spark, folder).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items())
    law(rows, 40, 2 * max(r["size"] for r in rows))
    homes, size = defaultdict(set), defaultdict(int)
    for r in rows:
        homes[texts[r.doc_id]].add(r.shard)
        size[texts[r.doc_id]] += r["size"]
    total = sum(r["size"] for r in rows)
    assert all(len(h) == 1 for t, h in homes.items() if size[t] <= total / 40 / RANGES), "groups no larger than a range"


def test_odd_rows(make, odd):
    df = shard_records(make(odd), 3)
    rows = df.collect()
    assert len(rows) == len(odd) and df.columns == ["doc_id", "text", "key", "rest", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {16} and {r.text_crc32 for r in rows if r.doc_id in (1, 2)} == {0}
    law(rows, 3, 2 * max(r["size"] for r in rows))  # one text comes twice under one id, and stays together
    assert shard_records(make([(1, "a")]).limit(0), 3).collect() == []


def test_same_input_same_shards(make):
    rows = [(i, f"text {i} " * (i % 17)) for i in range(500)]
    once, again = [{(r.doc_id, r.shard, r.slot) for r in shard_records(make(rows), 8).collect()} for _ in range(2)]
    assert once == again


def test_clashing_names_and_text_ids(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "doc_id string, text string, slot int")
    assert shard_records(df, 2).columns == ["doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert shard_records(df, 2).count() == 2
