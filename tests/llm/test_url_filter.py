import pytest

from dwellspark.llm.queries import RULES
from dwellspark.llm.url_filter import Rule, reputations, rule_for, surely_bad, url_filter, url_host, url_path
from pyspark.sql import functions as F

PAGES = [
    (1, "http://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "https://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    (4, "x://y.net/es/://z", "y.net", "/es/://z", "net/es/", "block"),
    (5, "https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (6, "https://net/fr/#x", "net", "/fr/", "net/fr/", "block"),
    (7, "https://h.org?x=/en/", "h.org", "", None, "allow"),
    (8, "no scheme", "", "", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "", "", "", None, "allow"),
    (11, "https://example.com", "example.com", "", None, "allow"),
    (11, "https://example.com", "example.com", "", None, "allow"),
    (None, "http://\nq.net/fr/", "\nq.net", "/fr/", "net/fr/", "block"),
]


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame([(*p[:2], 1, "r") for p in PAGES], "page_id bigint, url string, host int, rest string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = url_filter(pages, labels, RULES)
    assert got.columns == ["page_id", "url", "rest", "host", "path", "rule", "verdict"]
    assert sorted([tuple(r) for r in got.drop("rest").collect()], key=repr) == sorted([(p[0], p[1], *p[2:]) for p in PAGES], key=repr)
    assert url_filter(pages.limit(0), labels, RULES).count() == 0


def test_of_two_rules_as_long_the_block_goes_first(spark):
    text, verdict = rule_for(F.lit("b.com"), F.lit("/a/b/"), [Rule("allow", "com", "/a/b/"), Rule("block", "b.com", "/a/")])
    assert tuple(spark.range(1).select(text, verdict).first()) == ("b.com/a/", "block")
    assert tuple(spark.range(1).select(*rule_for(F.lit("b.com"), F.lit("/"), [])).first()) == (None, None)


def test_hosts_shrink_to_domain_and_suffix(spark):
    counts = {"a.bad.org": (40, 39), "b.bad.org": (2, 2), "x.good.org": (60, 1), "lone.org": (1, 1), "g.co.uk": (30, 0)}
    rows = [(h, int(i < bad)) for h, (n, bad) in counts.items() for i in range(n)]
    got = {r.host: r for r in reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    rate = {h: r.alpha / (r.alpha + r.beta) for h, r in got.items()}
    assert {h: (r.n, r.bad) for h, r in got.items()} == counts
    assert 0.9 < rate["a.bad.org"] < 39.5 / 40 and rate["x.good.org"] < 0.1 and rate["g.co.uk"] < 0.1
    assert rate["lone.org"] < rate["b.bad.org"]  # the domain's evidence counts for a host with few pages
    blocked = spark.createDataFrame(list(got.values())).filter(surely_bad(F.col("alpha"), F.col("beta"), 1.645, 0.5))
    assert "a.bad.org" in {r.host for r in blocked.collect()} and "lone.org" not in {r.host for r in blocked.collect()}


def test_bad_host_is_blocked_unless_a_rule_allows(spark):
    pages = spark.createDataFrame([(i, "http://bad.org/x") for i in range(30)] + [(99, "http://bad.com/x")] + [(100 + i, "http://ok.org/") for i in range(30)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 0) for i in range(25)] + [(99, 0), (99, None)] + [(100 + i, 1) for i in range(30)], "doc_id bigint, quality int")
    got = {(r.host, r.verdict) for r in url_filter(pages, labels, RULES).collect()}
    assert got == {("bad.org", "block"), ("bad.com", "allow"), ("ok.org", "allow")}


def test_twin_sees_blocked_hosts(spark, tmp_path):
    """The query and its twin over pages with hosts that are blocked by their labels, which the given tables don't have."""
    import random

    import duckdb

    from dwellspark.llm.queries import ORACLES, op4_url_filter

    rng = random.Random(7)
    hosts = {"a.bad.org": 0.95, "b.bad.org": 0.9, "c.bad.org": 1.0, "lone.org": 1.0, "x.good.org": 0.05, "g.co.uk": 0.0, "h.co.uk": 0.9, "www.example.com": 1.0}
    pages = [(i, f"https://{host}/p{i}") for i, host in enumerate(rng.choices(list(hosts), k=400))] + [(1000, "https://lone.org/"), (1001, None), (1002, "http://n.net/es/1")]
    labels = [(i, int(rng.random() >= hosts[url.split("/")[2]])) for i, url in pages[:400] if "lone" not in url] + [(1000, 0), (1001, 1)]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    sql = duckdb.connect()
    for name in ("pages", "labels"):
        sql.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, op4_url_filter(spark, str(tmp_path)).collect()))
    assert got == sorted(sql.execute(ORACLES["op4_url_filter"]).fetchall())
    blocked = {host for _, host, _, rule, verdict in got if verdict == "block" and rule is None}
    assert {"a.bad.org", "b.bad.org", "c.bad.org", "h.co.uk"} <= blocked and not blocked & {"lone.org", "x.good.org", "g.co.uk"}
