"""Line dedup: lines found in several documents stay in the first of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.llm.rows import BLANKS, ascii_lower, hash_pair, pack, unpack
from dwellspark.session import cut_lineage


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(
    docs: DataFrame, min_chars: int = 10, min_documents: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents with ``text`` cut, and ``n_lines`` (before) and ``n_dropped``.

    A line whose key has ``min_chars`` code points or more and is found in ``min_documents`` or
    more documents is dropped, except in the smallest id that holds it, where all its
    occurrences stay. NULL or empty text is one empty line; a document that loses all its
    lines has an empty text. Rows with one id count as one document, each row losing its own
    lines; a row without id takes no part and stays as it is, with its text NULL as empty.
    No rows in, no rows out; other columns are kept, those named like an output are replaced.

    Lines are exploded to 128-bit hashes. Counting them combines on the map side, so a line
    that a third of all documents hold costs each task one row. The shared hashes are written
    and joined back with the lines by a plain equi-join, whose hot keys Spark splits. The text
    itself moves once.
    """
    names = {"doc_id": id_column, "text": text_column}
    rows = pack(docs, **names).withColumn("mark", F.xxhash64("text"))
    lines = (
        # An outer explode: before an inner one Spark adds a filter that splits the text once more.
        rows.filter(F.col("doc_id").isNotNull())
        .select("doc_id", "mark", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
        .select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "mark", "pos", *hash_pair(F.col("key")))
    )
    first = F.min("doc_id").alias("first")
    if min_documents <= 2:
        shared = lines.groupBy("h1", "h2").agg(first, F.max("doc_id").alias("last"))
        shared = shared if min_documents < 2 else shared.filter(F.col("first") < F.col("last"))
    else:
        holders = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        shared = holders.groupBy("h1", "h2").agg(first, F.sum("one").alias("n")).filter(F.col("n") >= min_documents)
    # Written, so that the join shuffles both sides anew and Spark can split a line that very many documents hold.
    shared = cut_lineage(shared.select("h1", "h2", "first"))
    dropped = (
        lines.join(shared, ["h1", "h2"])
        .filter(F.col("doc_id") != F.col("first"))
        .groupBy("doc_id", "mark")
        .agg(F.collect_set("pos").alias("gone"))
    )
    none = F.array().cast("array<int>")
    parts = (
        rows.join(dropped, ["doc_id", "mark"], "left")
        .withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
        .withColumn("gone", F.coalesce("gone", none))
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda at: F.get("lines", at)), "\n")
    )
    parts = parts.withColumns(
        {"text": kept, "n_lines": F.size("lines").cast("long"), "n_dropped": F.size("gone").cast("long")}
    )
    return unpack(parts, docs, names, n_lines=F.col("n_lines"), n_dropped=F.col("n_dropped"))
