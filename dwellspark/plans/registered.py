"""The registered queries: ``(spark, sf_dir) -> DataFrame`` over the given tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwellspark.functions import display as D
from dwellspark.functions.phrases import structured_text
from dwellspark.functions.predicates import build_filter
from dwellspark.functions.text import clean_text, collapse_whitespace, html_unescape, trim_text
from dwellspark.functions.vectors import l2_normalize, score, vector_dim
from dwellspark.operators import evaluate as E
from dwellspark.operators import lookup
from dwellspark.operators.cleaning import clean_listings as clean
from dwellspark.operators.cleaning import clean_text_columns as clean_texts
from dwellspark.operators.cleaning import split_rejects, to_table_types
from dwellspark.operators.embedding import HashingEmbedder, dimensions, embed_column, embed_listings, embed_text
from dwellspark.operators.fusion import fuse_max_sim, max_sim, max_sim_batch
from dwellspark.operators.history import as_of, validity
from dwellspark.operators.keywords import build_postings, keyword_match
from dwellspark.operators.knn import knn, knn_batch, rank_all, top_hits
from dwellspark.operators.lookup import assign_rank, fetch_hits, respond, with_preview
from dwellspark.operators.matching import facets, match_requests
from dwellspark.operators.profile import DISTINCT_ERROR, RANK_ERROR, merged_profile, profile_files
from dwellspark.operators.records import build_payload, build_points, listing_to_record, nested_point, payload_json
from dwellspark.operators.upsert import (
    assign_ids, dedup_by_key, ids_of_keys, load_stats, require_key, upsert_listings, upsert_vectors, vector_stats,
)
from dwellspark.plans import tables as V
from dwellspark.plans.experiment import compare_embedders, compare_methods
from dwellspark.plans.ingest import ingest, prepare
from dwellspark.plans.requests import SearchRequest, normalize_ui_filters, validate_requests
from dwellspark.plans.search import search, search_listings, search_one, search_vectors
from dwellspark.schema import LISTING
from dwellspark.session import cut_lineage, new_folder
from dwellspark.sources.listings import read_listings, scan_vectors
from dwellspark.sources.snapshots import collection_info, publish_index, publish_listings, scan_table
from dwellspark.sources.store import compact, ensure_tables, read_table
from dwellspark.streaming.landing import stream_ingest

Session = SparkSession
CREATED = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOADED = datetime(2024, 2, 1, 12, 30, tzinfo=timezone.utc)
FILTER_ALL = {
    "price_min": 905, "price_max": 1900, "rooms_min": 0.5, "rooms_max": 4.0, "has_parking": False,
    "has_elevator": True, "furnished": False,
}
EMBEDDER = HashingEmbedder(64)
# Rows of a feed in one of its files, where a query writes one.
FEED_FILE_ROWS = 20_000


def _id_text(ids) -> F.Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def _stored(view: DataFrame) -> DataFrame:
    """The listing view as a table that was loaded at a fixed time."""
    times = {name: F.lit(CREATED) for name in ("created_at", "updated_at", "scraped_at")}
    columns = [F.col(f.name).cast(f.dataType) for f in LISTING]
    return view.withColumns(times).select(*columns)


def _batch(spark: Session, sf_dir: str) -> DataFrame:
    """All listings again under keys half the table further, with other prices: half of them new."""
    view = V.listing_view(spark, sf_dir)
    count = view.count()
    return view.withColumn("external_id", F.concat(F.lit("ext-"), (F.col("id") + count // 2).cast("string"))).withColumn(
        "price", F.col("price") + 1000
    ).drop("id")


def _digest(vector) -> F.Column:
    """One number of all values of a vector and their places."""
    weighed = F.transform(vector, lambda x, i: F.round(x.cast("double"), 6) * (i + 1))
    return F.round(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 6)


def _run_dir(spark: Session) -> str:
    return new_folder(spark, "run")


# Similarity search


def knn_top10(spark: Session, sf_dir: str) -> DataFrame:
    return knn(V.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), V.mean_vector(spark, sf_dir), 10)


def knn_all_queries(spark: Session, sf_dir: str) -> DataFrame:
    items = V.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return knn_batch(items, V.query_vectors(spark, sf_dir), 10)


def knn_many_queries(spark: Session, sf_dir: str) -> DataFrame:
    """The form for query tables that are too large to send around, in blocks of 64."""
    items = V.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return knn_batch(items, V.query_vectors(spark, sf_dir), 10, broadcast_queries=1, block_rows=64)


def rank_all_items(spark: Session, sf_dir: str) -> DataFrame:
    items = V.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return rank_all(items, V.mean_vector(spark, sf_dir))


def max_sim_top10(spark: Session, sf_dir: str) -> DataFrame:
    return max_sim(V.index_view(spark, sf_dir), V.mean_vector(spark, sf_dir), 10)


def max_sim_all_queries(spark: Session, sf_dir: str) -> DataFrame:
    return max_sim_batch(V.index_view(spark, sf_dir), V.query_vectors(spark, sf_dir), 10)


def fuse_max_sim_top10(spark: Session, sf_dir: str) -> DataFrame:
    return fuse_max_sim(V.index_view(spark, sf_dir), V.query_vectors(spark, sf_dir), 10)


def fuse_with_limits(spark: Session, sf_dir: str) -> DataFrame:
    """Queries with their own limits; without one it is the default."""
    limit = F.when(F.col("query_id") % 3 > 0, (1 + F.col("query_id") % 30).cast("int"))
    return fuse_max_sim(V.index_view(spark, sf_dir), V.query_vectors(spark, sf_dir).withColumn("limit", limit), 100)


def knn_filtered(spark: Session, sf_dir: str) -> DataFrame:
    return knn(V.index_view(spark, sf_dir), V.mean_vector(spark, sf_dir), 20, "structured", FILTER_ALL, "payload.")


def cosine_pairs(spark: Session, sf_dir: str) -> DataFrame:
    return V.index_view(spark, sf_dir).select("id", score(F.col("structured"), F.col("description")).alias("score"))


# Predicates


def _filtered(parameters: dict, *columns: str):
    def run(spark: Session, sf_dir: str) -> DataFrame:
        return V.listing_view(spark, sf_dir).where(build_filter(parameters)).select("id", *columns)

    return run


filter_price = _filtered({"price_min": 905, "price_max": 990}, "price")
filter_rooms = _filtered({"rooms_min": 1, "rooms_max": 3.5}, "rooms")
filter_city = _filtered({"city": "Brand#17"}, "city")
filter_location = _filtered({"location": "ECONOMY", "city": ""}, "location")
filter_flags = _filtered({"has_parking": True, "has_elevator": False, "furnished": False}, "has_parking", "has_elevator", "furnished")
filter_all = _filtered(FILTER_ALL, "price", "rooms")
filter_inverted = _filtered({"price_min": 990, "price_max": 905}, "price")


# Requests


def request_check(spark: Session, sf_dir: str) -> DataFrame:
    valid, rejected = validate_requests(V.form_view(spark, sf_dir))
    columns = ["query_id", "limit", "reason"]
    return valid.withColumn("reason", F.lit("")).select(*columns).unionByName(rejected.select(*columns))


def ui_filters(spark: Session, sf_dir: str) -> DataFrame:
    return normalize_ui_filters(V.form_view(spark, sf_dir)).drop("query")


def _filter_requests(spark: Session, sf_dir: str) -> DataFrame:
    """The requests after every 50th listing."""
    return V.select(V.listing_view(spark, sf_dir), V.REQUEST_COLUMNS).where("query_id % 50 = 0")


def matched_requests(spark: Session, sf_dir: str) -> DataFrame:
    return match_requests(V.listing_view(spark, sf_dir), _filter_requests(spark, sf_dir), ["price", "city"])


def request_facets(spark: Session, sf_dir: str) -> DataFrame:
    return facets(V.listing_view(spark, sf_dir), _filter_requests(spark, sf_dir), ["city", "rooms", "has_parking", "has_elevator", "furnished"])


def keyword_hits(spark: Session, sf_dir: str) -> DataFrame:
    """The texts of all benchmark items against titles and descriptions of all listings."""
    postings = cut_lineage(build_postings(V.listing_view(spark, sf_dir), ["title", "description"]))
    items = V.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return keyword_match(postings, items, 10)


# Search


def search_filtered(spark: Session, sf_dir: str) -> DataFrame:
    found = search_vectors(V.index_view(spark, sf_dir), V.listing_view(spark, sf_dir).withColumns(
        {name: F.lit(CREATED) for name in ("created_at", "updated_at", "scraped_at")}
    ), V.request_view(spark, sf_dir))
    return found.select(
        "query_id", "rank", "score", "total_results", "listing.id", "listing.title", "listing.price", "listing.rooms"
    )


def search_stored(spark: Session, sf_dir: str) -> DataFrame:
    """The same over stored tables, the listings in 256 blocks; all fields of the response."""
    root = _run_dir(spark)
    listings = publish_listings(_stored(V.listing_view(spark, sf_dir)), f"{root}/listings", 256)
    index = publish_index(V.index_view(spark, sf_dir), f"{root}/index")
    found = search_vectors(index, listings, V.request_view(spark, sf_dir))
    times = [F.date_format(f"listing.{n}", "yyyy-MM-dd HH:mm:ss").alias(n) for n in ("created_at", "updated_at", "scraped_at")]
    return found.select("query_id", "rank", "score", "total_results", "listing.*").drop("created_at", "updated_at", "scraped_at").join(
        found.select("query_id", "rank", *times), ["query_id", "rank"]
    )


def search_hits(spark: Session, sf_dir: str) -> DataFrame:
    return search_listings(V.index_view(spark, sf_dir), V.request_view(spark, sf_dir))


def search_text(spark: Session, sf_dir: str) -> DataFrame:
    listings = _stored(V.listing_view(spark, sf_dir))
    points = build_points(embed_listings(V.listing_view(spark, sf_dir), EMBEDDER))
    index = publish_index(points, f"{_run_dir(spark)}/index")
    names = V.read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("query")).agg(F.min("p_partkey").alias("query_id"))
    requests = names.withColumns({"limit": F.lit(5), "price_min": F.lit(910), "has_elevator": F.lit(True)})
    found = search(index, listings, requests, EMBEDDER)
    return found.select("query_id", "rank", "score", "listing.id", "listing.title", "listing.price")


def search_single(spark: Session, sf_dir: str) -> DataFrame:
    """One request, by a text."""
    points = build_points(embed_listings(V.listing_view(spark, sf_dir), EMBEDDER))
    index = publish_index(points, f"{_run_dir(spark)}/index")
    request = SearchRequest("large green room", limit=20, price_max=1900, has_parking=True)
    found = search_one(index, _stored(V.listing_view(spark, sf_dir)), request, EMBEDDER)
    return found.select("rank", "score", "total_results", "listing.id", "listing.title")


def _hits(spark: Session, sf_dir: str) -> DataFrame:
    """Every embedding as a hit for its label; some ids have no listing."""
    first = F.round(F.element_at("embedding", 1).cast("double"), 6)
    return V.read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("id"), first.alias("score")
    )


def fetch_by_ids(spark: Session, sf_dir: str) -> DataFrame:
    found = fetch_hits(V.listing_view(spark, sf_dir), _hits(spark, sf_dir), bounded=False)
    return found.select("query_id", "id", "score", "title", "price", "city")


def fetch_page(spark: Session, sf_dir: str) -> DataFrame:
    """The rows of one result page, by its list of ids."""
    best = max_sim(V.index_view(spark, sf_dir), V.mean_vector(spark, sf_dir), 10).collect()
    return lookup.fetch_by_ids(V.listing_view(spark, sf_dir), [row.id for row in best]).select("id", "title", "price")


def assign_ranks(spark: Session, sf_dir: str) -> DataFrame:
    best = top_hits(_hits(spark, sf_dir), 50).drop("rank")
    ranked = assign_rank(fetch_hits(_stored(V.listing_view(spark, sf_dir)), best, bounded=False))
    return respond(ranked).select("query_id", "rank", "score", "total_results", "listing.id", "listing.external_id")


def text_preview(spark: Session, sf_dir: str) -> DataFrame:
    return with_preview(_hits(spark, sf_dir), V.listing_view(spark, sf_dir)).select("query_id", "id", "preview")


# Cleaning


def html_unescape_pages(spark: Session, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "pages").select("page_id", html_unescape(F.col("html")).alias("html"))


def collapse_whitespace_documents(spark: Session, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "documents").select("doc_id", collapse_whitespace(F.col("text")).alias("text"))


def trim_text_names(spark: Session, sf_dir: str) -> DataFrame:
    return V.raw_view(spark, sf_dir).select("external_id", trim_text(F.col("title")).alias("title"))


def clean_text_documents(spark: Session, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


def clean_text_pages(spark: Session, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "pages").select("page_id", clean_text(F.col("html")).alias("html"))


def clean_text_columns(spark: Session, sf_dir: str) -> DataFrame:
    names = ["external_id", "title", "description", "location", "neighborhood", "city"]
    return clean_texts(V.raw_view(spark, sf_dir)).select(*names)


def clean_numbers(spark: Session, sf_dir: str) -> DataFrame:
    return clean(V.raw_view(spark, sf_dir)).select("external_id", "price", "rooms", "size_sqm")


def clean_flags(spark: Session, sf_dir: str) -> DataFrame:
    flags = ["has_parking", "has_elevator", "has_balcony", "has_storage", "furnished", "pets_allowed"]
    return clean(V.raw_view(spark, sf_dir)).select("external_id", *flags)


def clean_listings(spark: Session, sf_dir: str) -> DataFrame:
    rows = to_table_types(clean(V.raw_view(spark, sf_dir)))
    columns = ["external_id", "title", "description", "price", "size_sqm", "city", "floor", "has_parking", "pets_allowed"]
    rooms = F.col("rooms").cast("double").alias("rooms")
    return rows.select(*columns, rooms, F.coalesce("reason", F.lit("")).alias("reason"))


# Composition


def structured_texts(spark: Session, sf_dir: str) -> DataFrame:
    return V.listing_view(spark, sf_dir).select("id", structured_text().alias("structured_text"))


def payload(spark: Session, sf_dir: str) -> DataFrame:
    return V.listing_view(spark, sf_dir).select(build_payload().alias("p")).select("p.*")


def payload_as_json(spark: Session, sf_dir: str) -> DataFrame:
    return V.listing_view(spark, sf_dir).select("id", payload_json().alias("payload"))


def points(spark: Session, sf_dir: str) -> DataFrame:
    built = build_points(embed_listings(V.listing_view(spark, sf_dir), EMBEDDER))
    return built.select(
        "id", _digest("structured").alias("structured"), _digest("description").alias("description"),
        F.col("payload.listing_id").alias("listing_id"), F.col("payload.furnished").alias("furnished"),
    )


def nested_points(spark: Session, sf_dir: str) -> DataFrame:
    point = V.index_view(spark, sf_dir).select(nested_point().alias("point"))
    return point.select(
        "point.id", _digest("point.vector.structured").alias("structured"),
        _digest("point.vector.description").alias("description"), "point.payload.external_id", "point.payload.rooms",
    )


def records(spark: Session, sf_dir: str) -> DataFrame:
    return listing_to_record(_stored(V.listing_view(spark, sf_dir)))


# Embedding


def hash_embed(spark: Session, sf_dir: str) -> DataFrame:
    embedded = embed_column(V.read(spark, sf_dir, "documents"), "text", EMBEDDER)
    weights = embedded.select("doc_id", F.posexplode("vector").alias("bucket", "weight"))
    return weights.select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def one_text(spark: Session, sf_dir: str) -> DataFrame:
    """The documents nearest to one embedded text."""
    text = "the and of large room"
    documents = V.read(spark, sf_dir, "documents").select("doc_id", EMBEDDER.column(F.col("text")).alias("v"))
    scored = documents.withColumn("score", score(F.col("v"), embed_text(text, EMBEDDER)))
    return scored.where("score is not null").select("doc_id", "score")


def listing_vectors(spark: Session, sf_dir: str) -> DataFrame:
    embedded = embed_listings(V.listing_view(spark, sf_dir), EMBEDDER)
    sides = F.array(
        F.struct(F.lit("structured").alias("name"), F.col("structured_vector").alias("v")),
        F.struct(F.lit("description").alias("name"), F.col("description_vector").alias("v")),
    )
    cells = embedded.select("id", F.explode(sides).alias("side")).select(
        "id", "side.name", F.posexplode("side.v").alias("bucket", "weight")
    )
    return cells.where("weight > 0").withColumn("weight", F.round(F.col("weight").cast("double"), 6))


def normalized(spark: Session, sf_dir: str) -> DataFrame:
    unit = V.read(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


def vector_dims(spark: Session, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "embeddings").groupBy(vector_dim(F.col("embedding")).alias("dim")).agg(
        F.count(F.lit(1)).alias("vectors")
    )


def index_info(spark: Session, sf_dir: str) -> DataFrame:
    return collection_info(V.index_view(spark, sf_dir), "listings", 64)


def named_vectors(spark: Session, sf_dir: str) -> DataFrame:
    return dimensions(V.index_view(spark, sf_dir), ["structured", "description"])


def scan_one_vector(spark: Session, sf_dir: str) -> DataFrame:
    scanned = scan_vectors(V.index_view(spark, sf_dir), "description", ["city", "price"])
    return scanned.select("id", "city", "price", _digest("description").alias("digest"))


def collection_profile(spark: Session, sf_dir: str) -> DataFrame:
    """Sketches of an index's files, merged, and whether the exact figures are within the stated bounds (four standard errors)."""
    stored = publish_index(V.index_view(spark, sf_dir), f"{_run_dir(spark)}/index").select("payload.price", "payload.rooms", "payload.city")
    names = ["price", "rooms", "city"]
    found = merged_profile(profile_files(stored, names), [0.25, 0.5, 0.75])
    cells = stored.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), F.expr(f"try_cast({c} as double)").alias("x")) for c in names])))
    exact = cells.groupBy("column").agg(F.countDistinct("text").alias("exact"))
    at = lambda n: F.get("quantiles", F.lit(n))
    joined = cells.join(F.broadcast(found.join(exact, "column")), "column")
    share = lambda condition: F.coalesce(F.avg(F.when(F.col("x").isNotNull(), condition.cast("int"))), F.lit(0.0))
    within = [(share(F.col("x") < at(n)) <= r + RANK_ERROR) & (r - RANK_ERROR <= share(F.col("x") <= at(n))) for n, r in enumerate([0.25, 0.5, 0.75])]
    return joined.groupBy("column", "rows", "nulls", "distinct", "exact", F.col("quantiles").isNotNull().alias("numbers")).agg(
        (within[0] & within[1] & within[2]).alias("ranks")
    ).select(
        "column", "rows", "nulls", (F.abs(F.col("distinct") - F.col("exact")) <= 4 * DISTINCT_ERROR * F.col("exact")).alias("distinct_within"),
        (F.col("ranks") | ~F.col("numbers")).alias("quantiles_within"),
    )


# Loading


def upsert_rows(spark: Session, sf_dir: str) -> DataFrame:
    merged = upsert_listings(_stored(V.listing_view(spark, sf_dir)), cut_lineage(_batch(spark, sf_dir)), LOADED)
    return merged.select(
        "id", "external_id", "title", "price", F.col("rooms").cast("double").alias("rooms"), "furnished", "status",
        (F.col("created_at") == F.lit(LOADED)).alias("created_now"),
        (F.col("updated_at") == F.lit(LOADED)).alias("updated_now"),
        (F.col("scraped_at") == F.lit(LOADED)).alias("scraped_now"),
    )


def upsert_partial(spark: Session, sf_dir: str) -> DataFrame:
    """A batch that brings three fields only: flags become false, other absent fields NULL."""
    batch = _batch(spark, sf_dir).select("external_id", "description", "price")
    merged = upsert_listings(_stored(V.listing_view(spark, sf_dir)), batch, LOADED)
    return merged.select("id", "external_id", "title", "price", "city", "has_parking", "furnished", "pets_allowed", "status")


def latest_wins(spark: Session, sf_dir: str) -> DataFrame:
    """Three loads that overlap, none later than the others in all its rows, in an order that is not theirs."""
    view = V.listing_view(spark, sf_dir)
    table = spark.createDataFrame([], LISTING)
    for n in (2, 3, 1):
        seen = F.timestamp_seconds(1_700_000_000 + 3600 * ((F.col("id") * 7 + n * 5) % 11) + n)
        batch = view.where((F.col("id") + n) % 4 > 0).select(
            "external_id", "description", (F.coalesce(F.col("price") + 100 * n, F.lit(-1))).alias("price"),
            F.lit(str(n)).alias("title"), seen.alias("scraped_at"),
        )
        table = cut_lineage(upsert_listings(table, batch, LOADED).drop("status"))
    return table.select(
        "external_id", "description", "price", F.col("title").cast("int").alias("load"), F.unix_timestamp("scraped_at").alias("seen")
    )


def load_counts(spark: Session, sf_dir: str) -> DataFrame:
    good, bad = split_rejects(clean(V.raw_view(spark, sf_dir)))
    merged = upsert_listings(_stored(V.listing_view(spark, sf_dir)), cut_lineage(good), LOADED)
    return load_stats(merged, bad)


def dedup_events(spark: Session, sf_dir: str) -> DataFrame:
    batch = V.read(spark, sf_dir, "events").select(
        F.concat(F.lit("ext-"), F.col("user_id").cast("string")).alias("external_id"),
        F.col("ts").alias("scraped_at"), "event_id", "event_type", "value",
    )
    return dedup_by_key(batch).drop("scraped_at")


def dedup_feed(spark: Session, sf_dir: str) -> DataFrame:
    """A feed in two files, in which later rows repeat keys: the later file, and in it the later row, counts."""
    folder = _run_dir(spark)
    rows = V.read(spark, sf_dir, "part").select(
        F.concat(F.lit("ext-"), (F.col("p_partkey") % 50).cast("string")).alias("external_id"),
        F.lit("text").alias("description"), F.col("p_partkey").cast("string").alias("price"),
    )
    for half in (0, 1):
        part = rows.where(F.col("price").cast("int") % 2 == half).coalesce(1).sortWithinPartitions(F.col("price").cast("int"))
        part.write.mode("append").json(folder)
    good, _ = prepare(read_listings(spark, folder))
    return dedup_by_key(good, latest="source_order").select("external_id", "price")


def keyed_rows(spark: Session, sf_dir: str) -> DataFrame:
    key = F.when(F.col("p_size") % 4 == 0, F.lit("")).when(F.col("p_size") % 4 != 1, F.col("p_name"))
    keyed, rest = require_key(V.read(spark, sf_dir, "part").withColumn("external_id", key))
    return keyed.select("p_partkey", "external_id", F.lit(True).alias("keyed")).unionByName(
        rest.select("p_partkey", "external_id", F.lit(False).alias("keyed"))
    )


def new_ids(spark: Session, sf_dir: str) -> DataFrame:
    return assign_ids(V.listing_view(spark, sf_dir).select("external_id", "title"), 1000)


def key_lookup(spark: Session, sf_dir: str) -> DataFrame:
    return ids_of_keys(_batch(spark, sf_dir), V.listing_view(spark, sf_dir)).select("id", "external_id", "price")


def upsert_points(spark: Session, sf_dir: str) -> DataFrame:
    """All points again, vectors exchanged, under ids half the table further: half of them replace one."""
    index = V.index_view(spark, sf_dir)
    moved = index.select(
        (F.col("id") + index.count() // 2).alias("id"), F.col("description").alias("structured"),
        F.col("structured").alias("description"), "payload",
    )
    merged = upsert_vectors(index, cut_lineage(moved))
    return merged.select(
        "id", F.col("payload.listing_id").alias("listing_id"), _digest("structured").alias("structured"),
        _digest("description").alias("description"),
    )


def point_counts(spark: Session, sf_dir: str) -> DataFrame:
    return vector_stats(build_points(embed_listings(V.listing_view(spark, sf_dir), EMBEDDER)))


def ingest_flow(spark: Session, sf_dir: str) -> DataFrame:
    load = ingest(V.raw_view(spark, sf_dir), _run_dir(spark), EMBEDDER, LOADED)
    index = load.index.select(
        "id", "payload.city", _digest("structured").alias("structured"), _digest("description").alias("about")
    )
    listings = load.listings.select(
        "id", "external_id", "title", "description", "price", F.col("rooms").cast("double").alias("rooms"), "size_sqm",
        "has_parking", "furnished", "pets_allowed",
    )
    return listings.join(index, "id")


def ingest_stats(spark: Session, sf_dir: str) -> DataFrame:
    """A third of the feed, then all of it twice over: inserts, updates, duplicates and errors."""
    root = _run_dir(spark)
    raw = V.raw_view(spark, sf_dir)
    first = ingest(raw.where(F.length("external_id") % 3 == 0), root, EMBEDDER, CREATED)
    second = ingest(raw.unionByName(raw), root, EMBEDDER, LOADED)
    return first.stats.withColumn("load", F.lit(1)).unionByName(second.stats.withColumn("load", F.lit(2)))


def stream_flow(spark: Session, sf_dir: str) -> DataFrame:
    """The feed as files in a landing folder, loaded in several epochs; one of them comes again."""
    root = _run_dir(spark)
    raw = V.raw_view(spark, sf_dir)
    # As many files as the feed needs, so that none is a large part of it; two thirds of them a load.
    files = 3 * max(1, -(-V.read(spark, sf_dir, "part").count() // FEED_FILE_ROWS // 3))
    raw.repartition(files, "external_id").write.json(f"{root}/landing")
    for _ in range(2):  # a new checkpoint repeats the epochs; the store knows them
        mark = _run_dir(spark)
        stream_ingest(spark, f"{root}/landing", root, EMBEDDER, mark, files_per_load=2 * files // 3, clock=lambda: LOADED).awaitTermination()
    compact(spark, root)
    table = read_table(spark, root, "listings")
    return table.select("external_id", "title", "price", "has_parking", (F.col("updated_at") == F.lit(LOADED)).alias("loaded"))


def stream_dedup(spark: Session, sf_dir: str) -> DataFrame:
    """Three versions of a feed that arrive out of order, the newest twice; what was delivered before is dropped by state."""
    root = _run_dir(spark)
    part = V.read(spark, sf_dir, "part")
    for n in (2, 3, 1, 2):
        rows = part.where((F.col("p_partkey") % 3 > 0) | F.lit(n != 2)).select(
            F.concat(F.lit("ext-"), F.col("p_partkey").cast("string")).alias("external_id"),
            F.concat(F.lit("flat "), F.col("p_partkey").cast("string")).alias("description"),
            (1000 * n + F.col("p_partkey") % 7).cast("string").alias("price"),
            F.lit({1: "2024-03-02T00:00:00Z", 2: "2024-03-03T00:00:00Z", 3: "2024-03-01T00:00:00Z"}[n]).alias("scraped_at"),
        )
        rows.coalesce(1).write.mode("append").json(f"{root}/landing")
    stream_ingest(
        spark, f"{root}/landing", root, EMBEDDER, _run_dir(spark), files_per_load=2, clock=lambda: LOADED, remember="7 days"
    ).awaitTermination()
    return read_table(spark, root, "listings").select("external_id", "description", "price", F.dayofmonth("scraped_at").alias("day"))


def _views(spark: Session, sf_dir: str) -> DataFrame:
    """Views among the events, as observations of a price by the user's number."""
    return V.read(spark, sf_dir, "events").where("event_type = 'view'")


def price_history(spark: Session, sf_dir: str) -> DataFrame:
    seen = _views(spark, sf_dir).select("user_id", "ts", F.floor(F.col("value") / 20).cast("int").alias("level"))
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("valid_from", "valid_to")]
    return validity(seen, "user_id", "ts", "level").select("user_id", "level", *times)


def price_as_of(spark: Session, sf_dir: str) -> DataFrame:
    """What was last seen before each purchase."""
    probes = V.read(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = _views(spark, sf_dir).select("user_id", "ts", F.col("event_id").alias("seen_id"), F.col("value").alias("price"))
    return as_of(probes, seen, "user_id", "ts", ["seen_id", "price"]).drop("ts")


def empty_tables(spark: Session, sf_dir: str) -> DataFrame:
    """Tables created twice, with a load in between; the load stays."""
    root = _run_dir(spark)
    ensure_tables(spark, root)
    ingest(V.raw_view(spark, sf_dir), root, EMBEDDER, LOADED)
    ensure_tables(spark, root)
    listings, index = (read_table(spark, root, name) for name in ("listings", "index"))
    return listings.select("id", "external_id").join(index.select("id", "payload.price"), "id")


def json_feed(spark: Session, sf_dir: str) -> DataFrame:
    folder = _run_dir(spark)
    V.raw_view(spark, sf_dir).write.json(folder)
    return read_listings(spark, folder).select("external_id", "title", "description", "price", "rooms", "city")


def snapshot_tables(spark: Session, sf_dir: str) -> DataFrame:
    root = _run_dir(spark)
    publish_listings(_stored(V.listing_view(spark, sf_dir)), f"{root}/listings")
    publish_index(V.index_view(spark, sf_dir), f"{root}/index")
    index = scan_table(spark, f"{root}/index").select("id", "payload.price", "payload.city")
    return scan_table(spark, f"{root}/listings").select("id", "external_id", "id_block").join(index, "id", "left")


# Evaluation


def _comparison(spark: Session, sf_dir: str) -> DataFrame:
    return compare_methods(V.index_view(spark, sf_dir), V.query_vectors(spark, sf_dir))


def _expected(spark: Session, sf_dir: str) -> DataFrame:
    """The item whose structured vector is the query."""
    return V.query_vectors(spark, sf_dir).select("query_id", F.array("query_id").alias("expected_ids"))


def compare_rankings(spark: Session, sf_dir: str) -> DataFrame:
    ids = {name: _id_text(F.col(name)) for name in ("regular_top_ids", "multivector_top_ids")}
    return _comparison(spark, sf_dir).withColumns(ids)


def top_ids(spark: Session, sf_dir: str) -> DataFrame:
    first = E.top_ids(knn_batch(V.index_view(spark, sf_dir), V.query_vectors(spark, sf_dir), 5, "description"), 5)
    return first.withColumn("top_ids", _id_text(F.col("top_ids")))


def overlap_at_k(spark: Session, sf_dir: str) -> DataFrame:
    return _comparison(spark, sf_dir).select("query_id", "overlap_count", "overlap_ratio")


def expected_hit(spark: Session, sf_dir: str) -> DataFrame:
    return E.expected_hit_at_k(_comparison(spark, sf_dir), _expected(spark, sf_dir))


def evaluation_summary(spark: Session, sf_dir: str) -> DataFrame:
    rounded = {name: F.round(name, 6) for name in ("avg_overlap", "avg_score_improvement")}
    return E.evaluation_summary(_comparison(spark, sf_dir)).withColumns(rounded)


def compare_models(spark: Session, sf_dir: str) -> DataFrame:
    items = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    queries = V.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return compare_embedders(items, queries, [HashingEmbedder(16), HashingEmbedder(64)])


def timing_summary(spark: Session, sf_dir: str) -> DataFrame:
    """Times from a table of measurements: here the values of events stand for them."""
    times = V.read(spark, sf_dir, "events").select(
        F.lit(0.01).alias("query_encode_time"), (F.col("value") / 1000 + 1).alias("regular_time"),
        (F.col("value") / 900 + 1.1).alias("multivector_time"),
    )
    found = E.timing_summary(times)
    return found.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])


# Display


def display_card(spark: Session, sf_dir: str) -> DataFrame:
    view = V.listing_view(spark, sf_dir).withColumn("score", F.col("rooms") / 7)
    return view.select(
        "id",
        D.card_title(F.col("id") + 1, F.col("title"), F.col("score")).alias("card_title"),
        D.format_price(F.col("price")).alias("price_text"),
        D.format_rooms(F.col("rooms")).alias("rooms_text"),
        D.format_size(F.col("size_sqm")).alias("size_text"),
        D.format_flag(F.col("pets_allowed")).alias("pets_text"),
        D.place_line().alias("place_line"),
        D.floor_line().alias("floor_line"),
        D.feature_line().alias("feature_line"),
        D.score_percent(F.col("score"), 1).alias("score_text"),
    )


QUERIES = {
    "knn_top10": knn_top10,
    "knn_batch": knn_all_queries,
    "knn_many_queries": knn_many_queries,
    "knn_filtered": knn_filtered,
    "rank_all": rank_all_items,
    "cosine_similarity": cosine_pairs,
    "max_sim_top10": max_sim_top10,
    "max_sim_batch": max_sim_all_queries,
    "fuse_max_sim_top10": fuse_max_sim_top10,
    "fuse_with_limits": fuse_with_limits,
    "filter_price": filter_price,
    "filter_rooms": filter_rooms,
    "filter_city": filter_city,
    "filter_location": filter_location,
    "filter_flags": filter_flags,
    "filter_all": filter_all,
    "filter_inverted": filter_inverted,
    "validate_requests": request_check,
    "normalize_ui_filters": ui_filters,
    "match_requests": matched_requests,
    "request_facets": request_facets,
    "keyword_match": keyword_hits,
    "search_filtered": search_filtered,
    "search_stored": search_stored,
    "search_one": search_single,
    "search_listings": search_hits,
    "search_text": search_text,
    "fetch_by_ids": fetch_by_ids,
    "fetch_page": fetch_page,
    "assign_rank": assign_ranks,
    "text_preview": text_preview,
    "html_unescape_pages": html_unescape_pages,
    "collapse_whitespace_documents": collapse_whitespace_documents,
    "trim_text": trim_text_names,
    "clean_text_documents": clean_text_documents,
    "clean_text_pages": clean_text_pages,
    "clean_text_columns": clean_text_columns,
    "clean_numbers": clean_numbers,
    "clean_flags": clean_flags,
    "clean_listings": clean_listings,
    "structured_text": structured_texts,
    "payload": payload,
    "payload_json": payload_as_json,
    "build_points": points,
    "nested_point": nested_points,
    "listing_to_record": records,
    "embed_text": one_text,
    "hash_embed": hash_embed,
    "embed_listings": listing_vectors,
    "l2_normalize": normalized,
    "vector_dim": vector_dims,
    "collection_info": index_info,
    "collection_profile": collection_profile,
    "named_vectors": named_vectors,
    "scan_vectors": scan_one_vector,
    "upsert_listings": upsert_rows,
    "upsert_partial_batch": upsert_partial,
    "latest_wins": latest_wins,
    "load_stats": load_counts,
    "dedup_latest_feed": dedup_feed,
    "ensure_tables": empty_tables,
    "dedup_by_key": dedup_events,
    "require_key": keyed_rows,
    "assign_ids": new_ids,
    "key_lookup": key_lookup,
    "upsert_vectors": upsert_points,
    "vector_stats": point_counts,
    "ingest": ingest_flow,
    "ingest_stats": ingest_stats,
    "stream_ingest": stream_flow,
    "stream_dedup": stream_dedup,
    "price_history": price_history,
    "price_as_of": price_as_of,
    "read_listings": json_feed,
    "snapshot_tables": snapshot_tables,
    "compare_rankings": compare_rankings,
    "top_ids": top_ids,
    "overlap_at_k": overlap_at_k,
    "expected_hit": expected_hit,
    "evaluation_summary": evaluation_summary,
    "compare_models": compare_models,
    "timing_summary": timing_summary,
    "display_card": display_card,
}
