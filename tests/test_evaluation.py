import pytest
from pyspark.sql import functions as F

from dwellspark.operators import evaluate as E
from dwellspark.operators.embedding import HashingEmbedder
from dwellspark.operators.evaluate import models_side_by_side
from dwellspark.plans.experiment import compare_embedders, compare_methods


@pytest.fixture(scope="module")
def comparison(spark):
    """Two queries over six items with fixed small vectors."""
    items = [(i, [float(i), 1.0], [1.0, float(i)]) for i in range(1, 7)]
    index = spark.createDataFrame(items, "id long, structured array<float>, description array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    return compare_methods(index, queries)


def test_comparison(comparison):
    one, two = comparison.orderBy("query_id").collect()
    assert one.regular_top_ids == [1, 2, 3, 4, 5] and one.multivector_top_ids == [6, 5, 4, 3, 2]
    assert (one.overlap_count, one.overlap_ratio, one.top_changed) == (4, 0.8, True)
    assert one.score_improvement == pytest.approx(one.multivector_top_score - one.regular_top_score, abs=1e-9) and one.score_improvement > 0
    assert two.regular_top_ids == two.multivector_top_ids == [6, 5, 4, 3, 2] and not two.top_changed and two.score_improvement == 0


def test_expected_hits(spark, comparison):
    expected = spark.createDataFrame([(1, [6]), (2, [1]), (3, [])], "query_id long, expected_ids array<long>")
    one, two = E.expected_hit_at_k(comparison, expected).orderBy("query_id").collect()
    assert tuple(one)[1:] == (False, True, True, False) and tuple(two)[1:] == (False, False, False, False)


def test_summary(comparison):
    row = E.evaluation_summary(comparison).first()
    assert (row.queries, row.top_changed_count, row.improves, row.changes_ranking) == (2, 1, True, False)
    assert row.avg_overlap == pytest.approx(0.9)


def test_overlap_divides_by_k(spark):
    hits = spark.createDataFrame(
        [("regular", 1, 1, 7, 0.5), ("multivector", 1, 1, 7, 0.6), ("multivector", 1, 2, 8, 0.2), ("regular", 2, 1, 7, 0.5)],
        "list string, query_id long, rank int, id long, score double",
    )
    (row,) = E.compare_rankings(hits).collect()
    assert row.overlap_ratio == 0.2 and row.score_improvement == pytest.approx(0.1)


def test_timing(spark):
    times = spark.createDataFrame([(0.1, 0.2, 0.22), (0.3, 0.2, 0.24)], "query_encode_time double, regular_time double, multivector_time double")
    row = E.timing_summary(times).first()
    assert row.avg_query_encode_time_ms == pytest.approx(200) and row.overhead_percent == pytest.approx(15) and row.overhead_minimal


def test_models(spark):
    class Broken:
        name, dim = "broken", 3

        def column(self, text):
            return HashingEmbedder(3).column(F.raise_error(F.lit("no such model")))

    items = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, None)], "id long, description string")
    queries = spark.createDataFrame([(1, "a b c"), (2, "x")], "query_id long, query string")
    times = spark.createDataFrame([("hashing-64", 0.5)], "model string, encode_time double")
    found = compare_embedders(items, queries, [HashingEmbedder(64), HashingEmbedder(4)], times)
    rows = {(r.model, r.query_id): r for r in found.collect()}
    assert set(rows) == {(m, q) for m in ("hashing-64", "hashing-4") for q in (1, 2)}
    assert rows["hashing-64", 1].score == 1.0 and rows["hashing-64", 1].dimension == 64
    assert rows["hashing-64", 1].encode_time == 0.5 and rows["hashing-4", 1].encode_time is None
    wide = {r.model: r for r in models_side_by_side(found, [1, 2]).collect()}
    assert wide["hashing-64"].query_1 == 1.0
