import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from dwellspark.functions.predicates import build_filter, drop_none_filters
from dwellspark.functions.vectors import cosine_similarity, l2_normalize
from dwellspark.operators.fusion import fuse_max_sim, max_sim, max_sim_batch
from dwellspark.operators.knn import knn, knn_batch, rank_all
from dwellspark.operators.lookup import assign_rank, fetch_by_ids, fetch_hits, with_preview
from dwellspark.operators.records import build_payload
from dwellspark.operators.scoring import EXCLUDED, QueryBlock, TopK, unit_rows
from dwellspark.plans.requests import SearchRequest, normalize_ui_filters, validate_requests
from dwellspark.plans.search import search_one, search_vectors
from dwellspark.schema import LISTING, REQUEST, REQUEST_FILTERS

DIM = 6


def vector(rnd):
    return [rnd.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(DIM)]


def cos(a, b):
    if a is None or b is None or not any(a) or not any(b):
        return None
    return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)


@pytest.fixture(scope="module")
def world(spark):
    """A small index full of ties, missing vectors and missing values, and requests with all filters."""
    rnd = random.Random(7)
    items = []
    for i in range(300):
        same = [1.0, 0.5, 0.0, 0.0, 0.0, -0.5]
        items.append(
            {
                "id": i * 3, "structured": None if i % 50 == 0 else same if i % 3 == 0 else vector(rnd),
                "description": None if i % 70 == 1 else [0.0] * DIM if i % 41 == 0 else vector(rnd),
                "price": rnd.choice([None, 100, 200, 300]), "rooms": rnd.choice([None, 1.0, 2.5, 4.0]),
                "city": rnd.choice([None, "A", "a", "B"]), "location": rnd.choice([None, "x", "y"]),
                "has_parking": rnd.choice([None, True, False]), "has_elevator": rnd.choice([True, False]),
                "furnished": rnd.choice([None, True, False]),
            }
        )
    asks = []
    for q in range(40):
        def maybe(*values):
            return rnd.choice([None, None, *values])

        asks.append(
            {
                "query_id": q, "vector": vector(rnd), "limit": rnd.choice([1, 5, 10, 100]), "price_min": maybe(100, 200),
                "price_max": maybe(200, 300, 50), "rooms_min": maybe(1.0, 2.0), "rooms_max": maybe(3.0, 4.0), "city": maybe("A", ""),
                "location": maybe("x"), "has_parking": maybe(True, False), "has_elevator": maybe(True), "furnished": maybe(False),
            }
        )
    kinds = "price int, rooms double, city string, location string, has_parking boolean, has_elevator boolean, furnished boolean"
    index = spark.createDataFrame(items, f"id long, structured array<float>, description array<float>, {kinds}")
    filters = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REQUEST_FILTERS)
    queries = spark.createDataFrame(asks, f"query_id long, vector array<double>, limit int, {filters}")
    return items, asks, index.repartition(5), queries


def admitted(item, ask):
    def low(value, bound):
        return bound is None or (value is not None and value >= bound)

    def high(value, bound):
        return bound is None or (value is not None and value <= bound)

    return (
        low(item["price"], ask.get("price_min")) and high(item["price"], ask.get("price_max"))
        and low(item["rooms"], ask.get("rooms_min")) and high(item["rooms"], ask.get("rooms_max"))
        and all(not ask.get(n) or item[n] == ask[n] for n in ("city", "location"))
        and all(ask.get(n) is None or bool(item[n]) == ask[n] for n in ("has_parking", "has_elevator", "furnished"))
    )


def brute(items, asks, names, k):
    rows = []
    for ask in asks:
        scored = []
        for item in items:
            known = [s for s in (cos(item[n], ask["vector"]) for n in names) if s is not None]
            if known and admitted(item, ask):
                scored.append((-max(known), item["id"]))
        scored.sort()
        rows += [(ask["query_id"], r + 1, i, -s) for r, (s, i) in enumerate(scored[: min(k, ask["limit"])])]
    return sorted(rows)


def got(df):
    return sorted((r.query_id, r["rank"], r.id, r.score + 0.0) for r in df.collect())


@pytest.mark.parametrize("names", [["structured"], ["structured", "description"]])
def test_batch_equals_brute_force(world, names):
    items, asks, index, queries = world
    assert got(knn_batch(index, queries, 100, names)) == brute(items, asks, names, 100)


def test_large_query_table_gives_the_same_without_moving_items(world):
    items, asks, index, queries = world
    found = knn_batch(index, queries, 100, ["structured", "description"], broadcast_queries=3, block_rows=4)
    assert got(found) == brute(items, asks, ["structured", "description"], 100)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and plan.index("MapInArrow") < len(plan)


def test_large_query_table_keeps_the_covering_filter(world):
    _, _, index, queries = world
    asked = queries.withColumns({"price_min": F.lit(100), "city": F.lit("A"), "has_parking": F.lit(True)})
    forms = [knn_batch(index, asked, 10, "structured", **sizes) for sizes in ({}, {"broadcast_queries": 1, "block_rows": 3})]
    assert got(forms[0]) == got(forms[1])
    for form in forms:
        assert "price" in (text := form._jdf.queryExecution().optimizedPlan().toString()) and ">= 100" in text


def test_limits_are_honoured_in_both_forms(world):
    _, _, index, queries = world
    asked = queries.withColumn("limit", F.when(F.col("query_id") % 2 == 0, F.lit(3)))
    hits = fuse_max_sim(index, asked.drop(*REQUEST_FILTERS.names), 100)
    assert got(hits) == got(max_sim_batch(index, asked.drop(*REQUEST_FILTERS.names), 100))
    assert {(r.query_id % 2, r.n) for r in hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 3), (1, 10)}


def test_both_fusion_forms_agree(world):
    _, _, index, queries = world
    for k in (1, 7, 100):
        plain = queries.drop("limit")
        assert got(fuse_max_sim(index, plain, k)) == got(max_sim_batch(index, plain, k))


def test_single_query_equals_brute_force(world):
    items, asks, index, _ = world
    for ask in asks[:4]:
        filters = {name: ask[name] for name in REQUEST_FILTERS.names}
        found = max_sim(index, ask["vector"], ask["limit"], filters=filters)
        expected = [(i, s) for _, _, i, s in brute(items, [ask], ["structured", "description"], 100)]
        assert [(r.id, r.score + 0.0) for r in found.collect()] == expected


def test_rank_all_is_complete_and_contiguous(world):
    items, asks, index, _ = world
    found = sorted((r["rank"], r.id, r.score + 0.0) for r in rank_all(index, asks[0]["vector"], "structured").collect())
    plain = [{"query_id": 0, "vector": asks[0]["vector"], "limit": 10**6}]
    assert found == [(rank, i, s) for _, rank, i, s in brute(items, plain, ["structured"], 10**6)]


def test_limit_above_corpus_size_and_empty_inputs(world, spark):
    items, asks, index, queries = world
    one = queries.where("query_id = 0").select("query_id", "vector")
    assert knn_batch(index, one, 10_000, "structured").count() == sum(i["structured"] is not None for i in items)
    assert knn_batch(index, queries.where("false"), 10, "structured").count() == 0
    assert knn_batch(index.where("false"), queries, 10, "structured").count() == 0


def test_vectors_of_unequal_length_are_an_error():
    import pyarrow as pa

    with pytest.raises(ValueError):
        unit_rows(pa.array([[1.0, 2.0], [1.0], [1.0, 2.0, 3.0]]))


def test_filters_reach_the_scan(world, spark, tmp_path):
    _, _, index, _ = world
    path = str(tmp_path / "index")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    index.withColumn("payload", F.struct("price", "city", "has_parking")).select("id", "structured", "payload").write.parquet(path)
    stored = spark.read.parquet(path)
    plan = knn(stored, [1.0] * DIM, 3, "structured", {"price_min": 100, "city": "A", "has_parking": True}, "payload.")
    text = plan._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(payload.price,100)" in text and "EqualTo(payload.city,A)" in text
    queries = spark.createDataFrame([(1, [1.0] * DIM, 100, "A"), (2, [0.5] * DIM, 200, "B")], "query_id long, vector array<double>, price_min int, city string")
    batch = knn_batch(stored, queries, 3, "structured", "payload.")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(payload.price,100)" in batch and "In(payload.city, [A,B])" in batch and "description" not in batch


bounds = st.one_of(st.none(), st.integers(0, 400))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    price_min=bounds, price_max=bounds, rooms_min=st.one_of(st.none(), st.floats(0, 5)), rooms_max=st.none(),
    city=st.sampled_from([None, "", "A", "a"]), location=st.sampled_from([None, "x"]), has_parking=st.sampled_from([None, True, False]),
    has_elevator=st.sampled_from([None, True]), furnished=st.sampled_from([None, False]),
)
def test_filter_property(world, **parameters):
    items, _, index, _ = world
    condition = build_filter(parameters)
    kept = index if condition is None else index.where(condition)
    assert sorted(r.id for r in kept.select("id").collect()) == [i["id"] for i in items if admitted(i, parameters)]


def test_no_parameters_is_no_filter():
    assert build_filter(None) is None and build_filter({"city": None}) is None and build_filter({"city": ""}) is None
    assert drop_none_filters({"a": None}) is None and drop_none_filters({"a": False, "b": None}) == {"a": False}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-2, 2), min_size=3, max_size=3), min_size=1, max_size=40), st.integers(1, 6), st.integers(1, 9))
def test_running_top_k_does_not_depend_on_batches(rows, k, step):
    import pyarrow as pa

    table = pa.table({"query_id": [1, 2], "vector": [[1.0, 0.0, 1.0], [0.0, -1.0, 0.5]]})
    block = QueryBlock(table, k)
    vectors = pa.array([[float(x) for x in r] for r in rows])
    ids = np.arange(len(rows))[::-1].copy()
    batch = pa.RecordBatch.from_arrays([pa.array(ids), vectors], ["id", "v"])
    top = TopK(block)
    for start in range(0, len(rows), step):
        part = batch.slice(start, step)
        top.add(block.scores(part, [["v"]])[0], part["id"].to_numpy())
    scores = np.round(block.scores(batch, [["v"]])[0], 9)
    expected = [
        (q, int(ids[p])) for q in range(2) for p in sorted(range(len(rows)), key=lambda p: (-scores[q, p], ids[p]))[:k] if scores[q, p] > EXCLUDED
    ]
    assert list(zip(top.query.tolist(), top.id.tolist())) == expected


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(l2_normalize(F.col("a")).alias("u"), cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].u == [0.6, 0.8] and rows[0].c == pytest.approx(0.96)
    assert rows[1].u is None and rows[1].c is None and rows[2].c is None


# Rows and ranks


@pytest.fixture(scope="module")
def stored(spark):
    rows = [{**{f.name: None for f in LISTING}, "id": i, "external_id": f"k{i}", "description": f"text {i}", "price": i * 10} for i in range(1, 6)]
    return spark.createDataFrame(rows, LISTING)


def test_hits_without_a_row_are_dropped_and_ranks_stay_contiguous(spark, stored):
    hits = spark.createDataFrame([(1, 99, 0.95), (1, 2, 0.9), (1, 4, 0.9), (2, 98, 0.5)], "query_id long, id long, score double")
    for bounded in (True, False):
        rows = assign_rank(fetch_hits(stored, hits, bounded)).orderBy("rank").collect()
        assert [(r.query_id, r["rank"], r.id, r.total_results) for r in rows] == [(1, 1, 2, 2), (1, 2, 4, 2)]


def test_rows_by_id_keep_the_order_of_the_list(stored):
    assert [r.id for r in fetch_by_ids(stored, [4, 77, 1, 3]).collect()] == [4, 1, 3]
    assert fetch_by_ids(stored, []).count() == 0


@pytest.mark.parametrize("blocks", [1, 4, 256])
def test_hits_read_only_their_blocks_whatever_their_number(spark, stored, tmp_path, blocks):
    from dwellspark.sources.snapshots import publish_listings

    listings = publish_listings(stored, str(tmp_path / "listings"), blocks=blocks)
    hits = spark.createDataFrame([(1, 2, 0.9), (1, 4, 0.8)], "query_id long, id long, score double").where("score > 0.1")
    joined = fetch_hits(listings, hits, True)
    assert sorted(r.id for r in joined.collect()) == [2, 4]
    assert "dynamicpruning" in joined._jdf.queryExecution().toString().lower()
    unknown = spark.createDataFrame(listings.collect(), listings.schema).withColumn("id", F.col("id") + 0)
    assert sorted(r.id for r in fetch_hits(unknown, hits, True).collect()) == [2, 4]


def test_preview(spark, stored):
    hits = spark.createDataFrame([(1, 2, 0.9)], "query_id long, id long, score double")
    assert with_preview(hits, stored, 4).first().preview == "text..."


# Requests


def test_request_checks():
    for bad in ({"query": ""}, {"query": "  "}, {"query": "q", "limit": 0}, {"query": "q", "limit": 200}, {"query": "q", "price_min": -1}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)
    assert SearchRequest("q").limit == 10
    SearchRequest("q", price_min=10, price_max=5)


def test_request_table_checks(spark):
    rows = [(1, "q", None), (2, "", 5), (3, None, 5), (4, "q", 0), (5, "q", 101), (6, "q", 100)]
    requests = spark.createDataFrame([(i, q, k, *([None] * 9)) for i, q, k in rows] + [(7, "q", 1, -1, *([None] * 8))], REQUEST)
    valid, bad = validate_requests(requests)
    assert sorted((r.query_id, r.limit) for r in valid.collect()) == [(1, 10), (6, 100)]
    assert {r.query_id: r.reason for r in bad.collect()} == {
        2: "query is empty", 3: "query is empty", 4: "limit out of range", 5: "limit out of range", 7: "price_min is negative",
    }


def test_form_input(spark):
    row = (1, "q", 80, 0, -5, 2.0, None, " c ", "  ", None, True, False)
    found = normalize_ui_filters(spark.createDataFrame([row], REQUEST)).first()
    assert tuple(found) == (1, "q", 50, None, None, 2.0, None, "c", None, None, True, False)


class FixedEmbedder:
    """Fixed small vectors in place of a model."""

    name, dim = "fixed", 3

    def column(self, text):
        known = {"two rooms": [1.0, 0.0, 0.0], "parking": [0.0, 1.0, 0.0]}
        cases = F.lit(None).cast("array<float>")
        for words, v in known.items():
            cases = F.when(text == words, F.array(*[F.lit(x) for x in v]).cast("array<float>")).otherwise(cases)
        return cases


def test_search_one(spark, stored):
    vectors = {1: ([1.0, 0.0, 0.0], [0.0, 0.0, 1.0]), 2: ([0.0, 0.0, 1.0], [0.8, 0.6, 0.0]), 3: ([0.0, 1.0, 0.0], [0.0, 1.0, 0.0]), 99: ([1.0, 0.0, 0.0], [1.0, 0.0, 0.0])}
    points = spark.createDataFrame([(i, *v) for i, v in vectors.items()], "id long, structured array<float>, description array<float>")
    index = points.join(stored.select("id", build_payload().alias("payload")), "id", "left")
    found = search_one(index, stored, SearchRequest("two rooms", limit=3), FixedEmbedder()).collect()
    assert [(r["rank"], r.listing.id, round(r.score, 6), r.total_results) for r in found] == [(1, 1, 1.0, 2), (2, 2, 0.8, 2)]
    cheap = search_one(index, stored, SearchRequest("two rooms", price_min=20, has_parking=False), FixedEmbedder()).collect()
    assert [(r["rank"], r.listing.id) for r in cheap] == [(1, 2), (2, 3)]
    assert search_one(index, stored, SearchRequest("two rooms", city="nowhere"), FixedEmbedder()).count() == 0
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, vector array<float>")
    assert search_vectors(index, stored, asked).count() == 3


def test_filters_common_to_all_queries_lose_nothing(world, spark):
    items, asks, index, queries = world
    common = {"price_min": 100, "price_max": 300, "rooms_max": 4.0, "has_parking": False, "furnished": True}
    mixed = [{**a, **common, "city": "A" if i % 2 else "a", "price_min": 100 + 100 * (i % 2)} for i, a in enumerate(asks)]
    table = queries.withColumns(
        {name: F.lit(v).cast(REQUEST_FILTERS[name].dataType) for name, v in common.items()}
    ).withColumns(
        {
            "city": F.when(F.col("query_id") % 2 == 1, F.lit("A")).otherwise(F.lit("a")),
            "price_min": (100 + 100 * (F.col("query_id") % 2)).cast("int"),
        }
    )
    names = ["structured", "description"]
    assert got(knn_batch(index, table, 100, names)) == brute(items, mixed, names, 100) != []


def test_floors_from_a_sample_leave_the_rows_and_keep_tasks_quiet(spark):
    from dwellspark.operators import knn as K

    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for i in range(20_000)], "id bigint, a array<double>, b array<double>")
    queries = spark.createDataFrame([(q, rng.normal(size=8).tolist(), 1 + q % 5) for q in range(60)], "query_id bigint, vector array<double>, limit int")
    items = items.repartition(400)
    lists = {"one": ["a"], "both": ["a", "b"]}
    rows = lambda **sizes: sorted(map(tuple, K.knn_lists(items, queries, 5, lists, broadcast_queries=1, block_rows=25, **sizes).collect()))
    assert rows(sample_of=8) == rows(sample_of=None) == sorted(map(tuple, K.knn_lists(items, queries, 5, lists).collect()))
    schema, names = K._hit_schema(queries), list(lists.values())
    told = {n: K._scan_with_blocks(items.select("id", "a", "b"), queries, names, 5, schema, 25, n).count() for n in (8, None)}
    assert told[None] == 400 * sum(2 * (1 + q % 5) for q in range(60)) and told[8] < 0.05 * 400 * 60 * 2 * 5
