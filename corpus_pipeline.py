"""Documents to token ids: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but
the last return the columns of ``documents``. ``run`` writes each stage's rows to the shared
folder and reads them again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwellspark.llm.bpe import bpe
from dwellspark.llm.decontaminate import decontaminate
from dwellspark.llm.line_dedup import line_dedup
from dwellspark.llm.quality import quality_filter, train
from dwellspark.llm.queries import PATTERN, RANKS
from dwellspark.llm.simhash import simhash_dedup
from dwellspark.session import new_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, unchanged."""
    return quality_filter(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has; ``n_chars`` is of the new text."""
    cut = line_dedup(docs)
    return cut.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with near fingerprints the one with the smallest id."""
    return simhash_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, token_ids, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe(docs, RANKS, PATTERN)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level bpe", tokens),
]

#: SQL can express neither the classifier nor the fingerprints nor the encoding; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
