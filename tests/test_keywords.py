import math
import re
import tempfile
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from dwellspark.operators.keywords import build_postings, keyword_match

ITEMS = [(i, f"common word{i % 7} " + "filler " * (i % 5), None if i % 3 else "Common, RARE%d é" % (i // 30)) for i in range(200)] + [(900, None, None), (901, "", "...")]
REQUESTS = [(1, "common rare2"), (2, "RARE0 rare0 word3!"), (3, None), (4, "absent"), (5, ""), (6, "É word6")]


def split(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def brute(k):
    texts = {i: Counter(split(a) + split(b)) for i, a, b in ITEMS}
    texts = {i: t for i, t in texts.items() if t}
    mean = sum(sum(t.values()) for t in texts.values()) / len(texts)
    df = Counter(w for t in texts.values() for w in t)
    out = []
    for query_id, query in REQUESTS:
        asked, scores = set(split(query)), []
        for i, t in texts.items():
            found = [math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * sum(t.values()) / mean)) for w in asked if t[w]]
            if found:
                scores.append((-round(sum(found), 6), i))
        out += [(query_id, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("part_rows", [10, 100_000])
def test_equals_brute_force_with_frequent_tokens_in_parts(spark, part_rows):
    items = spark.createDataFrame(ITEMS, "id bigint, title string, description string")
    requests = spark.createDataFrame(REQUESTS, "query_id bigint, query string")
    postings = build_postings(items, ["title", "description"], part_rows)
    got = keyword_match(postings, requests, 15, part_rows=part_rows)
    rows = sorted(map(tuple, got.collect()))
    expected = brute(15)
    assert [r[:3] for r in rows] == [r[:3] for r in expected] and [r[3] for r in rows] == pytest.approx([r[3] for r in expected])
    if part_rows == 10:
        hot = postings.where("token = 'common'")
        assert hot.select("part").distinct().count() == 20 and hot.count() == 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_items_or_requests(spark):
    items = spark.createDataFrame(ITEMS, "id bigint, title string, description string")
    requests = spark.createDataFrame(REQUESTS, "query_id bigint, query string")
    assert keyword_match(build_postings(items.limit(0), ["title"]), requests).count() == 0
    assert keyword_match(build_postings(items, ["title"]), requests.limit(0)).count() == 0


def test_requests_in_blocks_and_texts_of_repeated_ids(spark):
    halves = [(i, part, None) for i, a, b in ITEMS for part in (a, b)]
    items = spark.createDataFrame([*halves, (None, "common rare2", "")], "id bigint, title string, description string")
    requests = spark.createDataFrame(REQUESTS, "query_id bigint, query string")
    got = keyword_match(build_postings(items, ["title", "description"]), requests, 15, block_requests=2)
    expected = brute(15)
    rows = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in rows] == [r[:3] for r in expected] and [r[3] for r in rows] == pytest.approx([r[3] for r in expected])
    # Items and requests meet inside tasks, not as joined rows.
    assert "MapInArrow" in got._jdf.queryExecution().toString()


def test_held_postings_end_with_an_item(spark, monkeypatch):
    from dwellspark.operators import keywords

    rows = pa.table({"id": [1, 1, 2, 2, 2, 3, 3, 4], "code": [1, 2, 1, 2, 3, 1, 3, 2], "weight": [0.5, 0.25, 1.0, 2.0, 4.0, 1.0, 1.0, 8.0]})
    block = pa.table({"query_id": [7, 8], "codes": [[1, 2], [3]]})
    folder = tempfile.mkdtemp()
    pq.write_table(block, f"{folder}/block.parquet")
    schema = T.StructType().add("query_id", "long").add("id", "long").add("score", "double")
    expected = {(7, 1): 0.75, (7, 2): 3.0, (7, 3): 1.0, (7, 4): 8.0, (8, 2): 4.0, (8, 3): 1.0}
    for held, cells in ((1, 1), (2, 5), (100, 1000)):
        monkeypatch.setattr(keywords, "HELD_POSTINGS", held)
        monkeypatch.setattr(keywords, "SUM_CELLS", cells)
        scan = keywords._scored([f"file://{folder}/block.parquet"], 10, schema)
        found = pa.Table.from_batches(list(scan(rows.to_batches(max_chunksize=2)))).to_pylist()
        assert {(r["query_id"], r["id"]): r["score"] for r in found} == expected and len(found) == len(expected)
