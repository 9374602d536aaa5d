"""Benchmark decontamination by spaced seeds, tolerant of substituted words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.llm.rows import pack

#: 1: the word counts, 0: it is ignored. Any 13 words of which two are substituted leave one of them intact
#: somewhere (a test tries all placements).
MASKS = ("11101011", "110100111")
#: Words of an overlap, and how many of them may differ.
OVERLAP, SUBSTITUTED = 13, 2
#: Seeds of the test side that may be broadcast: 16 bytes each, so 32 MB; more are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words (runs of letters and digits, in lower case), in order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda word: F.xxhash64(word))


def seeds(words: Column, masks: tuple[str, ...]) -> Column:
    """For each place at which the mask fits, mask after mask: the hash of the words that count."""

    def of(mask: str) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - len(mask))
        hashed = F.transform(
            places,
            lambda at: F.struct(
                at.alias("at"),
                F.xxhash64(F.lit(mask), *[F.get(words, at + k) for k, c in enumerate(mask) if c == "1"]).alias("seed"),
            ),
        )
        return F.when(F.size(words) >= len(mask), hashed).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))

    return F.concat(*[of(mask) for mask in masks])


def _bits(bits: Column, above: Column, count: int) -> Column:
    """``count`` bits from the place ``above`` up."""
    return F.call_function("shiftright", bits, above).bitwiseAND(F.lit((1 << count) - 1).cast("long"))


def overlaps(doc: Column, item: Column, at: Column, item_at: Column, span: int, overlap: int, substituted: int) -> Column:
    """Starts in the document of the aligned windows around a hit that differ in few words.

    Document word ``at`` lies on item word ``item_at``; all windows of ``overlap`` words that
    hold some of the ``span`` hit words, and lie in both texts, are looked at.
    """
    back = F.least(at, item_at, F.lit(overlap - 1))
    ahead = F.least(F.size(doc) - at, F.size(item) - item_at, F.lit(span + overlap - 1))
    assert span + 2 * overlap < 64, "a bit for each word around a hit"
    starts = lambda bits: F.transform(
        F.filter(
            F.sequence(F.lit(0), back + ahead - overlap),
            lambda k: F.bit_count(_bits(bits, back + ahead - overlap - k, overlap)) >= overlap - substituted,
        ),
        lambda k: at - back + k,
    )
    # The first word compared ends up as the highest bit.
    found = F.aggregate(
        F.sequence(-back, ahead - 1),
        F.lit(0).cast("long"),
        lambda bits, k: bits * 2 + F.when(F.get(doc, at + k) == F.get(item, item_at + k), 1).otherwise(0),
        starts,
    )
    return F.when(back + ahead >= overlap, found).otherwise(F.array().cast("array<int>"))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    masks: tuple[str, ...] = MASKS,
    overlap: int = OVERLAP,
    substituted: int = SUBSTITUTED,
    broadcast_seeds: int = BROADCAST_SEEDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_windows, start_word, end_word``: documents that hold a part of a benchmark item.

    A leak is ``overlap`` aligned words of which at most ``substituted`` differ. ``start_word``
    and ``end_word`` (exclusive) span all such windows of the pair in the document.
    Texts with fewer words, NULL or empty ones, and rows without an id have none. Rows that
    share an id are one document (or item): their windows are counted together, equal places
    once. Empty tables give no rows; other columns are not read.

    The seeds of the test side are counted; up to ``broadcast_seeds`` they are sent to all
    tasks and the documents do not move. Beyond, seeds of both sides are joined by a shuffle
    (hot seeds are split by the join) and the words are joined on for the pairs found.
    Either way all windows around each hit are compared, so the rows are the same. Words are
    compared by 64-bit hashes.
    """
    span = max(map(len, masks))
    # Outer explodes: before an inner one Spark adds a filter that computes the array once more.
    named = pack(items, item_id=item_column, item_text=item_text_column).filter(F.col("item_id").isNotNull())
    test = named.select("item_id", word_hashes(F.col("item_text")).alias("item_words"))
    # Shorter items have no window; without them every item has seeds, which bound what is broadcast.
    test = test.filter(F.size("item_words") >= overlap).dropDuplicates()
    test_seeds = test.select("item_id", F.inline_outer(seeds(F.col("item_words"), masks)))
    test_seeds = test_seeds.withColumnsRenamed({"at": "item_at", "seed": "item_seed"})
    few = test_seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds

    train = (
        pack(docs, doc_id=id_column, text=text_column)
        .filter(F.col("doc_id").isNotNull())
        .select("doc_id", word_hashes(F.col("text")).alias("words"))
        .withColumn("seeds", seeds(F.col("words"), masks))
    )
    if few:
        by_seed = F.broadcast(test_seeds.groupBy("item_seed").agg(F.collect_list(F.struct("item_id", "item_at")).alias("places")))
        hits = (
            train.select("doc_id", "words", F.inline_outer("seeds"))
            .join(by_seed, F.col("seed") == F.col("item_seed"))
            .select("doc_id", "words", "at", F.inline_outer("places"))
            .join(F.broadcast(test), "item_id")
        )
    else:
        pairs = (
            train.select("doc_id", F.inline_outer("seeds"))
            .join(test_seeds, F.col("seed") == F.col("item_seed"))
            .select("doc_id", "at", "item_id", "item_at")
        )
        hits = pairs.join(train.select("doc_id", "words"), "doc_id").join(test, "item_id")
    starts = overlaps(F.col("words"), F.col("item_words"), F.col("at"), F.col("item_at"), span, overlap, substituted)
    # The windows of a pair that shares a long passage meet as single rows, already distinct by task.
    windows = hits.select("doc_id", "item_id", F.explode_outer(starts).alias("start"))
    windows = windows.filter(F.col("start").isNotNull()).distinct()
    return windows.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("start").alias("start_word"), (F.max("start") + overlap).alias("end_word")
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents without a leak, unchanged; those without an id stay."""
    found = leaks(docs, items, id_column=id_column, **options).select(F.col("doc_id").alias("leaking")).distinct()
    return docs.join(found, docs[f"`{id_column}`"] == F.col("leaking"), "left_anti")
