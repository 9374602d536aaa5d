import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.llm import quality as Q

BLANK = "[\x20\x09-\x0d]"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.append(line)
    n = len(words)
    base = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))
    return (*base, n < 50 or 100 * len(inside) > 50 * n)


ODD = [None, "", " \t\n", "a b c a b c", "x\nx\n x\n\n\nx", "#<*>| é ü", "a b a b a b", "tail\x0bx\x0cy\rz", "w " * 60, " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))]


@pytest.fixture(scope="module")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def model(documents, labels):
    return Q.train(documents, labels)


def test_base_counts(spark, documents, make, odd):
    rows = list(enumerate(ODD)) + odd + [(r.doc_id, r.text) for r in documents.collect()]
    got = Q.quality_rules(make(rows), None).collect()
    assert sorted([tuple(r[:7]) for r in got], key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)
    assert all(r.kept != r.base_failed and r.probability is None for r in got)


def test_scores_are_of_whole_texts_and_training_and_scoring_agree(model):
    texts = ["some words and some more " * 30, "ünï " * 70, "x", "a" * 5000]
    for text in texts:
        at, value = Q.features(text)
        assert model.probability(text) == pytest.approx(1 / (1 + np.exp(-(model.slope * float(model.weights[at] @ value) + model.offset))), rel=1e-3)


def test_blocks_lose_no_feature(monkeypatch):
    text = ("wörd " * 50 + "x" * 300 + " 日本語 🎉 end ") * 7
    at, value = Q.features(text)
    for size in (1, 2, 64):
        monkeypatch.setattr(Q, "BLOCK", size)
        again = Q.features(text)
        assert (again[0] == at).all() and (again[1] == value).all()


def test_character_grams_are_of_code_points():
    points = np.array([ord(c) for c in "日本語🎉"], np.uint64)
    assert len(Q.char_features(points, 2)) == 3 and len(Q.char_features(points, 4)) == 1 and len(Q.char_features(points[:1], 2)) == 0
    kinds = [found for kind, found in Q.feature_blocks("日本") if kind == 1]
    assert sum(map(len, kinds)) == 3 + 1, "with a blank at either end: three of two characters, one of four"


def test_of_contradicting_labels_the_lowest_counts_and_labels_without_documents_do_not(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} words of number {i} " * 5) for i in range(80)], "doc_id bigint, text string")
    labels = [(i, i % 2) for i in range(80)]
    one = Q.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    more = labels + [(i, 1) for i in range(0, 80, 2)] + [(1000 + i, 0) for i in range(500)] + [(3, None)]
    two = Q.train(docs, spark.createDataFrame(more, "doc_id bigint, quality int").repartition(5))
    assert (one.weights == two.weights).all() and (one.slope, one.offset) == (two.slope, two.offset)



def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter(F.pmod("doc_id", F.lit(2)) == 0)
    test = labels.filter(F.pmod("doc_id", F.lit(2)) == 1)
    rows = Q.quality_rules(docs, Q.train(docs, train)).join(test, "doc_id").filter(~F.col("base_failed")).collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert len(bad) > 50 and np.mean(good) >= 0.98 and np.mean(bad) <= 0.05, (np.mean(good), np.mean(bad), len(good), len(bad))


def test_training_is_repeatable_and_needs_both_outcomes(spark, documents, labels, model):
    again = Q.train(documents.repartition(5), labels.repartition(3))
    assert np.array_equal(again.weights, model.weights) and again.slope == model.slope
    assert Q.train(documents, labels.filter("quality = 1")) is None
    assert Q.train(documents, labels.limit(0)) is None
    assert Q.train(documents.limit(0), labels) is None
    assert Q.train(documents, labels.withColumn("quality", F.lit(None).cast("int"))) is None


def test_filter_keeps_what_the_rules_keep(make, odd, documents, model):
    rows = odd + [(r.doc_id + 100, r.text) for r in documents.collect()]
    df = make(rows)
    kept = Q.quality_filter(df, model)
    assert kept.columns == df.columns
    expected = sorted(r.doc_id for r in Q.quality_rules(df, model).collect() if r.kept)
    assert sorted(r.doc_id for r in kept.collect()) == expected and expected
    assert Q.quality_rules(df.limit(0), model).collect() == []


def test_query(spark, folder, documents):
    from dwellspark.llm.queries import op9_quality_rules

    got = sorted(op9_quality_rules(spark, folder).collect())
    assert [tuple(r[:7]) for r in got] == sorted((r.doc_id, *brute(r.text)) for r in documents.collect())
    assert not any(r.kept and r.base_failed for r in got)


def test_calibration_goes_by_the_shares_of_all_labels(spark):
    """Drawn half and half from nine good to one bad; where the outcomes can't be told apart, the share is the answer."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 60))) for i in range(4000)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.pmod("doc_id", F.lit(10)) > 0).cast("int").alias("quality"))
    model = Q.train(docs, labels, sample=800)
    assert np.mean([model.probability(r.text) for r in docs.limit(100).collect()]) == pytest.approx(0.9, abs=0.04)
