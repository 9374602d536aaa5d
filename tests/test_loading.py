import json
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from dwellspark.operators.embedding import HashingEmbedder, ModelEmbedder, embed_column, embed_listings, embed_text
from dwellspark.operators.numbering import number_rows
from dwellspark.operators.upsert import (
    assign_ids, dedup_by_key, ids_of_keys, load_stats, require_key, upsert_listings, upsert_vectors, vector_stats,
)
from dwellspark.plans.ingest import ingest
from dwellspark.plans.requests import SearchRequest
from dwellspark.plans.search import search_one
from dwellspark.schema import INDEX, LISTING, RAW
from dwellspark.sources.listings import read_listings, scan_vectors
from dwellspark.sources.snapshots import collection_info, publish, scan_table, versions
from dwellspark.sources.store import ConcurrentLoad, commit, commits, compact, ensure_tables, read_table
from dwellspark.streaming.landing import stream_ingest

T1, T2 = (datetime(2024, m, 1, tzinfo=timezone.utc) for m in (1, 2))


def naive(t):
    return t.astimezone().replace(tzinfo=None)


@pytest.fixture
def table(spark):
    rows = []
    for i in range(1, 5):
        row = {f.name: None for f in LISTING}
        row |= {"id": i, "external_id": f"k{i}", "description": "old", "price": i, "has_parking": True, "created_at": T1, "updated_at": T1, "scraped_at": T1}
        rows.append(row)
    return spark.createDataFrame(rows, LISTING)


@pytest.fixture
def batch(spark):
    rows = [("k3", "new", 30, None), ("k9", "new", 90, True), ("k5", "new", None, None)]
    return spark.createDataFrame(rows, "external_id string, description string, price int, has_parking boolean")


def test_upsert(table, batch):
    merged = {r.external_id: r for r in upsert_listings(table, batch, T2).collect()}
    assert {k: (r.id, r.description, r.price, r.has_parking, r.status) for k, r in merged.items()} == {
        "k1": (1, "old", 1, True, "kept"), "k2": (2, "old", 2, True, "kept"), "k3": (3, "new", 30, False, "updated"),
        "k4": (4, "old", 4, True, "kept"), "k5": (5, "new", None, False, "inserted"), "k9": (6, "new", 90, True, "inserted"),
    }
    assert (merged["k3"].created_at, merged["k3"].updated_at, merged["k3"].scraped_at) == (naive(T1), naive(T2), naive(T2))
    assert merged["k1"].updated_at == naive(T1) and merged["k9"].created_at == naive(T2)
    stats = load_stats(upsert_listings(table, batch, T2)).first()
    assert tuple(stats) == (2, 1, 0, 6)


def test_upsert_twice_changes_nothing_more(table, batch):
    once = upsert_listings(table, batch, T2).drop("status")
    twice = upsert_listings(once, batch, T2).drop("status")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_any_order_of_loads_gives_one_table(spark, tmp_path):
    from itertools import permutations

    feeds = [
        [("a", "a1", "2024-03-01T00:00:00Z"), ("b", "b1", "2024-03-05T00:00:00Z"), ("c", "c1", None)],
        [("a", "a2", "2024-03-02T00:00:00Z"), ("b", "b2", "2024-03-04T00:00:00Z"), ("a", "a0", "2024-02-02T00:00:00Z")],
        [("a", "a3", "2024-03-01T12:00:00Z"), ("d", "d3", "2024-03-01T00:00:00Z"), ("b", "b3", "2024-03-06T00:00:00Z"), ("e", "e3", "no time")],
    ]
    times = [datetime(2024, 4, day, tzinfo=timezone.utc) for day in (1, 2, 3)]
    found = set()
    for number, order in enumerate(permutations(range(3))):
        table, root = spark.createDataFrame([], LISTING), str(tmp_path / str(number))
        for k in order:
            raw = spark.createDataFrame(feeds[k], "external_id string, description string, scraped_at string")
            load = ingest(raw, root, HashingEmbedder(8), times[k], most_loads=2)
            typed = raw.where("description <> 'a0'").withColumn("scraped_at", F.col("scraped_at").try_cast("timestamp"))
            table = upsert_listings(table, typed, times[k]).drop("status")
        rows = lambda df: tuple(sorted((r.external_id, r.description, r.scraped_at) for r in df.collect()))
        assert rows(table) == rows(load.listings)
        points = {r.id: r.description for r in load.index.select("id", F.col("description").cast("string").alias("description")).collect()}
        fresh = {r.id: str(r.v) for r in load.listings.select("id", HashingEmbedder(8).column(F.col("description")).cast("string").alias("v")).collect()}
        assert points == fresh, "the index has the vectors of the rows that won"
        assert len(commits(spark, root)) <= 2
        found.add(rows(table))
    assert len(found) == 1 and [(k, d) for k, d, _ in found.pop()] == [("a", "a2"), ("b", "b3"), ("c", "c1"), ("d", "d3"), ("e", "e3")]


def test_late_rows_are_counted_and_a_repeated_epoch_survives_compaction(spark, tmp_path):
    root, columns = str(tmp_path / "store"), "external_id string, description string, scraped_at string"
    new = spark.createDataFrame([("a", "new", "2024-03-02"), ("b", "new", "2024-03-02")], columns)
    old = spark.createDataFrame([("a", "old", "2024-03-01"), ("b", "fix", "2024-03-02"), ("b", "older", "2024-01-01")], columns)
    ingest(new, root, HashingEmbedder(8), T2, epoch=1)
    load = ingest(old, root, HashingEmbedder(8), T2, epoch=2)
    assert {r.external_id: r.description for r in load.listings.collect()} == {"a": "new", "b": "fix"}
    assert (load.stats.first().updated, load.stats.first().late, load.stats.first().duplicates) == (1, 1, 1)
    compact(spark, root)
    again = ingest(old, root, HashingEmbedder(8), T2, epoch=2)
    assert again.stats.first() == load.stats.first() and again.rejects.count() == 0


def test_absent_fields_of_a_batch_are_null_and_flags_false(spark, table):
    batch = spark.createDataFrame([("k1", "new"), ("k8", "new")], "external_id string, description string")
    rows = {r.external_id: r for r in upsert_listings(table, batch, T2).collect()}
    for key in ("k1", "k8"):
        assert (rows[key].price, rows[key].pets_allowed, rows[key].has_parking, rows[key].furnished) == (None, None, False, False)
    assert rows["k2"].has_parking


def test_upsert_into_an_empty_table(spark, batch):
    merged = upsert_listings(spark.createDataFrame([], LISTING), batch, T2)
    assert sorted((r.id, r.external_id) for r in merged.collect()) == [(1, "k3"), (2, "k5"), (3, "k9")]


def test_dedup_keeps_the_latest_of_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("external_id"),
        F.timestamp_seconds(F.col("id") % 1000).alias("scraped_at"), F.col("id").alias("value"),
    )
    best = {}
    for r in rows.collect():
        best[r.external_id] = max(best.get(r.external_id, (datetime.min, -1)), (r.scraped_at, r.value))
    found = dedup_by_key(rows.repartition(8))
    assert {r.external_id: (r.scraped_at, r.value) for r in found.collect()} == best
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        dedup_by_key(rows, mode="error")


def test_require_key(spark):
    keyed, rest = require_key(spark.createDataFrame([("a",), ("",), (None,)], "external_id string"))
    assert keyed.count() == 1 and rest.count() == 2


def test_numbers_are_consecutive_over_partitions(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("external_id")).repartition(7)
    keys = sorted(r[0] for r in rows.collect())
    assert sorted((r.id, r.external_id) for r in assign_ids(rows, 10).collect()) == [(11 + i, k) for i, k in enumerate(keys)]
    assert number_rows(rows.where("false"), [F.asc("external_id")], "n").count() == 0


def test_key_lookup(table, batch):
    assert [(r.id, r.price) for r in ids_of_keys(batch, table.select("external_id", "id")).collect()] == [(3, 30)]


def points(spark, *rows):
    return spark.createDataFrame([(i, v, v, None) for i, v in rows], INDEX)


def test_points_are_replaced_whole(spark):
    merged = upsert_vectors(points(spark, (1, [1.0]), (2, [2.0])), points(spark, (2, [5.0]), (3, [None])))
    assert sorted((r.id, r.structured) for r in merged.collect()) == [(1, [1.0]), (2, [5.0]), (3, [None])]


def test_vector_stats_and_info(spark):
    index = points(spark, (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None))
    assert tuple(vector_stats(index).first()) == (2, 1)
    assert tuple(collection_info(index, "c", 2).first()) == ("c", 2, 3, "yellow")
    assert collection_info(index.where("id < 3"), "c", 2).first().status == "green"
    assert scan_vectors(index.withColumn("payload", F.struct(F.lit(5).alias("price"))), "structured", ["price"]).columns == ["id", "structured", "price"]


# Embedding


def test_hashing_embedder(spark):
    from hashlib import md5

    df = spark.createDataFrame([(1, "A b  a\nc"), (2, ""), (3, "  "), (4, None), (5, " שלום שלום ")], "i int, t string")
    found = {r.i: r.vector for r in embed_column(df, "t", HashingEmbedder(8)).collect()}
    counts = np.zeros(8)
    for token in ["a", "b", "a", "c"]:
        counts[int(md5(token.encode()).hexdigest()[:8], 16) % 8] += 1
    assert found[1] == pytest.approx(list(counts / np.linalg.norm(counts)), abs=1e-7)
    assert found[2] is None and found[3] is None and found[4] is None and sorted(found[5])[-1] == 1.0
    raw = embed_column(df.where("i = 1"), "t", HashingEmbedder(8, normalize=False)).first().vector
    assert raw == list(counts)


def test_blank_text_is_an_error():
    for text in ("", "   "):
        with pytest.raises(ValueError, match="empty"):
            embed_text(text, HashingEmbedder(4))


def test_model_embedder(spark):
    class Model:
        def encode(self, texts, batch_size, convert_to_numpy, normalize_embeddings, show_progress_bar):
            assert batch_size == 32 and convert_to_numpy and not show_progress_bar
            rows = np.array([[len(t), 1.0] for t in texts])
            return rows / np.linalg.norm(rows, axis=1, keepdims=True) if normalize_embeddings else rows

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, " "), (4, "a")], "i int, t string")
    plain = ModelEmbedder("m", 2, normalize=False, load=lambda name: Model())
    assert {r.i: r.vector for r in embed_column(df, "t", plain).collect()} == {1: [3.0, 1.0], 2: None, 3: None, 4: [1.0, 1.0]}
    unit = ModelEmbedder("m", 2, load=lambda name: Model())
    assert np.linalg.norm(embed_column(df, "t", unit).where("i = 1").first().vector) == pytest.approx(1.0)
    assert ModelEmbedder().dim == 768


def test_a_listing_gets_two_vectors(spark, table):
    row = embed_listings(table.where("id = 1"), HashingEmbedder(16)).first()
    assert len(row.structured_vector) == 16 and sum(x > 0 for x in row.description_vector) == 1


# Tables and flows


def test_ensure_tables_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    ensure_tables(spark, root)
    ensure_tables(spark, root)
    assert [c.number for c in commits(spark, root)] == [0] and read_table(spark, root, "index").count() == 0
    with pytest.raises(FileNotFoundError):
        read_table(spark, f"{root}/none", "index")
    with pytest.raises(FileNotFoundError):
        scan_table(spark, f"{root}/none")


def test_a_version_without_commit_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark.range(3), path)
    publish(spark.range(5), path)
    (tmp_path / "t" / "version=3").mkdir()
    assert versions(spark, path) == [1, 2] and scan_table(spark, path).count() == 5


FEED = [
    {"external_id": "a", "description": "two &amp; rooms near sea", "price": "8,000 ש״ח", "rooms": "2.0", "city": " X  Y ", "has_parking": "yes", "extra": 1},
    {"external_id": "b", "description": "large flat", "price": 5000, "rooms": 4.5, "city": "X", "pets_allowed": "false"},
    {"external_id": "", "description": "no key"},
    {"external_id": "c", "description": "  "},
    {"external_id": "b", "description": "large flat", "price": 4000, "rooms": 4.5, "city": "X"},
]


def write_feed(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def test_read_listings(spark, tmp_path):
    feed = read_listings(spark, write_feed(tmp_path / "feed", FEED))
    assert feed.drop("source_order").schema == RAW and feed.count() == 5
    assert {r.price for r in feed.collect()} == {"8,000 ש״ח", "5000", "4000", None}
    (tmp_path / "f.csv").write_text('external_id,description\na,"line one\nline ""two"""\n')
    rows = read_listings(spark, str(tmp_path / "f.csv"), "csv", T.StructType().add("external_id", "string").add("description", "string"), multiLine="true").collect()
    assert rows[0].description == 'line one\nline "two"'


def test_ingest_then_search(spark, tmp_path):
    embedder, root = HashingEmbedder(32), str(tmp_path / "store")
    load = ingest(read_listings(spark, write_feed(tmp_path / "feed", FEED)), root, embedder, T1)
    rows = {r.external_id: r for r in load.listings.collect()}
    assert rows["a"].id == 1 and rows["b"].id == 2 and len(rows) == 2
    assert rows["a"].description == "two & rooms near sea" and rows["a"].price == 8000 and rows["a"].city == "X Y" and rows["a"].has_parking
    assert rows["b"].price == 4000 and rows["b"].pets_allowed is None  # the later of two rows, whole
    assert sorted(r.reason for r in load.rejects.collect()) == ["blank description", "blank external_id"]
    assert tuple(load.stats.first()) == (2, 0, 0, 1, 2, 0, 2)
    again = ingest(read_listings(spark, write_feed(tmp_path / "more", [{**FEED[0], "price": "9000"}, {"external_id": "d", "description": "cellar"}])), root, embedder, T2)
    assert tuple(again.stats.first()) == (1, 1, 0, 0, 0, 0, 3)
    assert {r.external_id: (r.id, r.price) for r in again.listings.collect()} == {"a": (1, 9000), "b": (2, 4000), "d": (3, None)}
    assert sorted((r.id, r.payload.price) for r in again.index.collect() if r.payload.price) == [(1, 9000), (2, 4000)]
    found = search_one(again.index, again.listings, SearchRequest("large flat", limit=2), embedder).collect()
    assert found[0].listing.external_id == "b" and found[0].score == pytest.approx(1.0) and found[0].total_results == 2
    dear = search_one(again.index, again.listings, SearchRequest("large flat", price_min=8000), embedder).collect()
    assert [r.listing.external_id for r in dear] == ["a"]


def test_stream_loads_what_arrived(spark, tmp_path):
    landing, root, mark = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "mark")
    times = iter([T1, T2])

    def run():
        stream_ingest(spark, str(landing), root, HashingEmbedder(8), mark, clock=lambda: next(times)).awaitTermination()

    write_feed(landing, FEED[:2])
    run()
    write_feed(landing, [{**FEED[1], "price": 1}, {"external_id": "z", "description": "late"}])
    run()
    rows = {r.external_id: (r.id, r.price) for r in read_table(spark, root, "listings").collect()}
    assert rows == {"a": (1, 8000), "b": (2, 1), "z": (3, None)}


def test_a_csv_stream_reads_like_a_csv_feed(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.csv").write_text('external_id,description\na,"line one\nline ""two"""\n')
    schema = T.StructType().add("external_id", "string").add("description", "string")
    root = str(tmp_path / "store")
    stream_ingest(spark, str(tmp_path / "landing"), root, HashingEmbedder(8), str(tmp_path / "mark"), schema, "csv", clock=lambda: T1, multiLine="true").awaitTermination()
    assert [(r.external_id, r.description) for r in read_table(spark, root, "listings").collect()] == [("a", 'line one line "two"')]


def files_of(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*") if p.is_file()}


def test_a_load_writes_no_old_file_and_leaves_no_cuts(spark, tmp_path):
    from urllib.parse import urlparse
    from pathlib import Path

    from dwellspark.session import shared_dir

    store, shared = tmp_path / "store", Path(urlparse(shared_dir(spark)).path)
    rows = [{"external_id": f"k{i:03d}", "description": f"flat {i}", "price": i} for i in range(200)]
    ingest(read_listings(spark, write_feed(tmp_path / "f0", rows)), str(store), HashingEmbedder(8), T1, id_blocks=4)
    compact(spark, str(store))
    before, cuts = files_of(store), set(shared.glob("cut-*"))
    for n, price in enumerate((1000, 2000)):
        load = ingest(read_listings(spark, write_feed(tmp_path / f"f{n + 1}", [{**rows[5], "price": price}, {"external_id": f"new{n}", "description": "x"}])), str(store), HashingEmbedder(8), T2)
    after = files_of(store)
    assert all(after[p] == t for p, t in before.items()) and len(after) > len(before)
    assert set(shared.glob("cut-*")) == cuts
    found = {r.external_id: (r.id, r.price, r.id_block) for r in load.listings.collect()}
    assert len(found) == 202 and found["k005"] == (6, 2000, 2) and found["new1"][0] == 202
    assert sorted(r.id for r in load.index.collect()) == list(range(1, 203))
    kept = {r.external_id: (r.id, r.price, r.id_block) for r in load.listings.collect()}
    made = compact(spark, str(store), blocks=7)
    assert made.base and made.last_id == 202
    assert {r.external_id: (r.id, r.price) for r in read_table(spark, str(store), "listings").collect()} == {k: v[:2] for k, v in kept.items()}


def test_both_tables_become_visible_at_once_and_one_of_two_writers_fails(spark, tmp_path):
    root = str(tmp_path / "store")
    load = ingest(read_listings(spark, write_feed(tmp_path / "feed", FEED)), root, HashingEmbedder(8), T1)
    last = commits(spark, root)[-1]
    with pytest.raises(ConcurrentLoad):
        commit(spark, root, last)
    (tmp_path / "store" / "data" / "00000002-half").mkdir()
    assert read_table(spark, root, "listings").count() == load.index.count() == 2


def test_a_repeated_epoch_is_loaded_once(spark, tmp_path):
    root = str(tmp_path / "store")
    feed = read_listings(spark, write_feed(tmp_path / "feed", FEED))
    once = ingest(feed, root, HashingEmbedder(8), T1, epoch=0)
    again = ingest(feed, root, HashingEmbedder(8), T2, epoch=0)
    assert len(commits(spark, root)) == 2 and tuple(again.stats.first()) == tuple(once.stats.first())
    assert {r.updated_at for r in again.listings.collect()} == {naive(T1)}


def test_redelivered_rows_are_dropped_by_state_and_out_of_order_files_load_like_a_batch(spark, tmp_path):
    when = "2024-03-{:02d}T00:00:00Z".format
    files = [
        [{"external_id": "a", "description": "late", "scraped_at": when(9)}, {"external_id": "b", "description": "first", "scraped_at": when(2)}],
        [{"external_id": "a", "description": "early", "scraped_at": when(1)}, {"external_id": "c", "description": "untimed"}],
        [{"external_id": "a", "description": "late", "scraped_at": when(9)}, {"external_id": "b", "description": "first", "scraped_at": when(2)}],
        [{"external_id": "b", "description": "second", "scraped_at": when(3)}, {"external_id": "a", "description": "early", "scraped_at": when(1)}, {"external_id": "c", "description": "untimed"}],
    ]
    stores = {}
    for name, remember in (("plain", None), ("keyed", "7 days")):
        root, landing = str(tmp_path / name), tmp_path / f"{name}-landing"
        for rows in files:
            write_feed(landing, rows)
            query = stream_ingest(spark, str(landing), root, HashingEmbedder(8), str(tmp_path / f"{name}-mark"), clock=lambda: T2, remember=remember)
            query.awaitTermination()
        seen = [c.stats for c in commits(spark, root)[1:]]
        stores[name] = [sum(c[n] for n in ("inserted", "updated", "late", "duplicates")) for c in seen]
        rows = {r.external_id: (r.description, r.scraped_at) for r in read_table(spark, root, "listings").collect()}
        assert {k: d for k, (d, _) in rows.items()} == {"a": "late", "b": "second", "c": "untimed"}
        stores[name, "rows"] = rows
    assert stores["plain", "rows"] == stores["keyed", "rows"]
    assert stores["plain"] == [2, 2, 2, 3] and [n for n in stores["keyed"] if n] == [2, 2, 2], "of the last files only what is new, and what has no time"


def test_unreadable_values_are_counted(spark, tmp_path):
    feed = [{"external_id": "a", "description": "x", "price": "99999999999", "floor": "third", "rooms": "2"}, {"external_id": "b", "description": "x", "price": " ", "pets_allowed": "maybe"}]
    load = ingest(read_listings(spark, write_feed(tmp_path / "feed", feed)), str(tmp_path / "store"), HashingEmbedder(8), T1)
    assert load.stats.first().unread_values == 3


def test_a_model_is_loaded_once_per_worker_for_both_texts(spark, tmp_path):
    class CountingModel:
        def __init__(self, folder):
            import os
            import uuid

            open(os.path.join(folder, uuid.uuid4().hex), "w").close()

        def encode(self, texts, **options):
            return np.ones((len(texts), 2))

    rows = spark.range(400).repartition(40).select("id", F.lit("some text").alias("description"), *[F.lit(None).cast(LISTING[n].dataType).alias(n) for n in ("title", "city", "neighborhood", "location", "price", "rooms", "size_sqm", "floor", "has_parking", "has_elevator", "has_balcony", "has_storage", "furnished")])
    embedder = ModelEmbedder(str(tmp_path), 2, load=CountingModel)
    assert embed_listings(rows, embedder).where("size(structured_vector) = 2 and size(description_vector) = 2").count() == 400
    assert 1 <= len(list(tmp_path.iterdir())) <= 8  # workers, not the 40 tasks
    with pytest.raises(Exception, match="gives 2 values, not 3"):
        embed_column(rows, "description", ModelEmbedder(str(tmp_path), 3, load=CountingModel)).collect()


def test_times_and_keys_alone_are_compared_and_rows_that_share_a_key_count_each(spark):
    from dwellspark.operators.upsert import changed_listings, compare_batch, full_batch

    now = datetime(2024, 5, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("b", "three"), (None, "four")], "external_id string, description string")
    first = upsert_listings(spark.createDataFrame([], LISTING), rows, now)
    assert sorted(r.description for r in first.collect()) == ["four", "one", "three", "two"]
    assert sorted(r.id for r in first.collect()) == [1, 2, 3, 4] and {r.status for r in first.collect()} == {"inserted"}
    table = upsert_listings(spark.createDataFrame([], LISTING), rows.limit(1), now).drop("status")
    batch = full_batch(spark.createDataFrame([("a", "new"), ("c", "other")], "external_id string, description string"), now)
    compared = compare_batch(table, batch.select("external_id", "scraped_at"), now, 1)
    assert "description" not in compared.columns
    assert sorted((r.id, r.description, r.status) for r in changed_listings(compared, batch, now).collect()) == [(1, "new", "updated"), (2, "other", "inserted")]


def test_a_feed_is_written_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    from dwellspark.plans import registered

    written = []
    monkeypatch.setattr(registered, "FEED_FILE_ROWS", 10)
    monkeypatch.setattr(registered, "stream_ingest", lambda s, landing, *a, **k: written.append((len(s.read.json(landing).inputFiles()), k["files_per_load"])) or type("Q", (), {"awaitTermination": lambda self: None})())
    monkeypatch.setattr(registered, "compact", lambda *a: None)
    monkeypatch.setattr(registered, "read_table", lambda s, *a: s.createDataFrame([], LISTING))
    spark.range(100).selectExpr(
        "id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "cast(id as int) as p_size", "1.0D as p_retailprice"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(100).selectExpr("id as doc_id", "'text' as text").write.parquet(f"{tmp_path}/documents.parquet")
    registered.stream_flow(spark, str(tmp_path))
    assert written == [(12, 8), (12, 8)]
