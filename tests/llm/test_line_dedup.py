import hashlib
from collections import defaultdict

import pytest

from dwellspark.llm.line_dedup import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=10, min_documents=2):
    holders = defaultdict(set)
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x: doc_id is not None and len(key(x)) >= min_chars and len(holders[key(x)]) >= min_documents and min(holders[key(x)]) != doc_id
        kept = [x for x in lines if not gone(x)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()], key=repr)


@pytest.mark.parametrize("least", [2, 3])
def test_equals_brute_force(documents, least):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(line_dedup(documents, min_documents=least)) == brute(rows, min_documents=least)


def test_odd_rows_and_ties(make, odd):
    rows = odd + [
        (10, "A shared line\nown line ten\n\x0bA SHARED LINE\r"), (11, "x\na shared line \n\nx"), (12, "a shared line"),
        (12, "other text of twelve\na shared line"), (13, "short\n" * 3), (14, "short"), (15, "exactly10!"), (16, "EXACTLY10!"),
        (17, "ÀÉÎ shared line"), (18, "àéî shared line"),
    ]
    df = line_dedup(make(rows))
    assert found(df) == brute(rows)
    assert df.columns == ["doc_id", "text", "key", "rest", "n_lines", "n_dropped"]
    assert {r.rest for r in df.collect()} == {"x"}


def test_empty_table_and_clashing_names(spark, make):
    assert line_dedup(make([(1, "a")]).limit(0)).collect() == []
    df = spark.createDataFrame([(1, "a", 5, 6, 7)], "doc_id bigint, text string, n_lines int, pos int, gone int")
    assert line_dedup(df).collect()[0].asDict() == {"doc_id": 1, "text": "a", "pos": 6, "gone": 7, "n_lines": 1, "n_dropped": 0}


def test_query(spark, folder):
    from dwellspark.llm.queries import op1_line_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expected = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows))
    assert sorted(map(tuple, op1_line_dedup(spark, folder).collect())) == expected
