"""Quality rules: counts with fixed limits, and a calibrated n-gram classifier trained on labelled rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh32_intdigest

from dwellspark.llm.rows import BLANKS, column
from dwellspark.session import cut_lineage

#: Buckets of hashed features: the first half for words and word pairs, the second for character n-grams.
BUCKETS = 1 << 17
#: Characters (code points) in an n-gram.
GRAMS = (2, 4)
#: Labelled rows that training reads at most, drawn by a hash of the id.
SAMPLE = 2000
#: A document is kept from this probability of being of quality on.
LEAST = 0.4
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Words, or characters, whose features are in memory at a time.
BLOCK = 1 << 18


# Counts of a text


def counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    data = text.encode()
    words = data.split()  # bytes know ASCII white space only
    blank = sum(map(text.count, BLANKS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - blank,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that the text has twice or more, the first time included."""
    windows = list(zip(*[words[k:] for k in range(window)]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = np.zeros(len(words), bool)
    twice = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    for k in range(window):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


# Features


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return (values >> np.uint64(40)).astype(np.int64) % (BUCKETS // 2)


def word_features(words: list[bytes]) -> np.ndarray:
    """Buckets of words and of pairs of neighbours, repeats included."""
    hashed = np.fromiter(map(xxh32_intdigest, words), np.uint64, len(words))
    pairs = hashed[:-1] * np.uint64(31) + hashed[1:] + np.uint64(1 << 33)
    return _mix(np.concatenate([hashed, pairs]))


def char_features(points: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all runs of ``n`` code points, repeats included."""
    value = np.full(max(len(points) - n + 1, 0), n, np.uint64)
    for k in range(n):
        value = (value ^ points[k : k + len(value)]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return _mix(value) + BUCKETS // 2


def feature_blocks(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Kind (0 words, 1 characters) and buckets of a text's features, in blocks that lose none.

    A block goes on into the next by as much as a feature that begins in it needs.
    """
    words = text.encode().split()
    for at in range(0, len(words), BLOCK):
        part = words[at : at + BLOCK + 1]
        found = word_features(part)
        # A word that only ends a pair is counted in the next block.
        yield 0, found if len(part) <= BLOCK else np.delete(found, BLOCK)
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    for n in GRAMS:
        for at in range(0, len(points) - n + 1, BLOCK):
            yield 1, char_features(points[at : at + BLOCK + n - 1], n)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values: counts over all features of the kind, words and characters each."""
    total = np.zeros(BUCKETS)
    for _, found in feature_blocks(text):
        total += np.bincount(found, minlength=BUCKETS)
    half = BUCKETS // 2
    for part in (slice(0, half), slice(half, BUCKETS)):
        total[part] /= max(total[part].sum(), 1)
    used = np.flatnonzero(total)
    return used.astype(np.int32), total[used].astype(np.float32)


# The model


@dataclass(frozen=True)
class Model:
    """Weights by bucket; ``slope`` and ``offset`` turn scores into probabilities."""

    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, text: str) -> float:
        """Of a whole text; the score is the mean weight of its words' features plus that of its characters'."""
        sums, numbers = np.zeros(2), np.zeros(2)
        for kind, found in feature_blocks(text):
            sums[kind] += self.weights[found].sum(dtype=np.float64)
            numbers[kind] += len(found)
        score = float((sums / np.maximum(numbers, 1)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -50, 50))))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, stands: tuple[float, float] = (1.0, 1.0), steps: int = 150, rate: float = 0.5
) -> Model | None:
    """Logistic regression on three of four rows, calibrated on the others; None without both outcomes.

    Outcomes weigh the same in training, however rare one is; calibration goes by their
    true shares: ``stands`` tells how many labels a bad and a good row stand for.
    """
    held = np.arange(len(rows)) % 4 == 3
    if any(len(set(good[part].tolist())) < 2 for part in (held, ~held)):
        return None

    def table(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = [r for r, take in zip(rows, part) if take]
        row = np.repeat(np.arange(len(mine)), [len(r[0]) for r in mine])
        return row, np.concatenate([r[0] for r in mine]), np.concatenate([r[1] for r in mine])

    (row, at, value), y = table(~held), good[~held].astype(float)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    weights, bias, scale = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-12)
    for _ in range(steps):
        error = (_logistic(np.bincount(row, weights[at] * value, len(y)) + bias) - y) * share
        slope = np.bincount(at, error[row] * value, BUCKETS) + 1e-7 * weights
        scale += slope * slope
        weights -= rate * slope / np.sqrt(scale)
        bias -= rate * error.sum()
    row, at, value = table(held)
    score, y = np.bincount(row, weights[at] * value, held.sum()), good[held].astype(float)
    # Platt's two parameters by Newton steps, the outcomes a little off 0 and 1.
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    weight = np.where(y > 0, stands[1], stands[0])
    weight /= weight.mean()
    design, found = np.stack([score, np.ones_like(score)], 1), np.zeros(2)
    for _ in range(50):
        p = _logistic(design @ found)
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (weight * (p - target)) + 1e-6 * found)
        found -= np.clip(step, -5, 5)
    return Model(weights.astype(np.float32), float(found[0]), float(found[1]))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text",
    quality_column: str = "quality",
) -> Model | None:
    """A model from at most ``sample`` labelled documents.

    Documents of both outcomes are drawn alike, half and half where there are enough, by a
    hash of the id, so a task that runs again draws the same; in calibration they weigh by
    what they stand for among all labels. Labels without quality or document don't count, and of several for a
    document the lowest does. Only features of the sample reach the driver.
    """
    known = labels.select(column(id_column).alias("id"), column(quality_column).alias("quality")).dropna()
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    known = cut_lineage(known.join(docs.select(column(id_column).alias("id")), "id", "left_semi"))
    bad, labelled = known.agg(F.count_if(F.col("quality") == 0), F.count(F.lit(1))).first()
    stands = tuple(max(n, 1) / max(min(n, sample // 2), 1) for n in (bad, labelled - bad))
    drawn = None
    for outcome in (0, 1):
        part = known.filter((F.col("quality") == 0) if outcome == 0 else (F.col("quality") != 0))
        part = part.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample // 2).select("id", F.lit(outcome).alias("good"))
        drawn = part if drawn is None else drawn.union(part)
    texts = docs.select(column(id_column).alias("id"), column(text_column).alias("text")).join(F.broadcast(drawn), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["good"], pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
                ["key", "good", "at", "value"],
            )

    keyed = texts.select(F.xxhash64(F.lit("fold"), "id").alias("key"), "good", "text")
    rows = keyed.mapInArrow(run, "key bigint, good int, at array<int>, value array<float>").toArrow()
    order = np.argsort(rows["key"].to_numpy(), kind="stable")
    at, value = rows["at"].combine_chunks(), rows["value"].combine_chunks()
    parts = [(at[int(k)].values.to_numpy(), value[int(k)].values.to_numpy()) for k in order]
    return fit(parts, rows["good"].to_numpy()[order], stands) if parts else None


def judge(
    text: str, model: Model | None, least: float = LEAST, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED
) -> tuple:
    """The counts of a text, then ``base_failed, probability, kept``."""
    n = counts(text)
    failed = n[0] < min_words or 100 * n[4] > max_repeated * n[0]
    probability = None if failed or model is None else model.probability(text)
    return *n, failed, probability, not failed and (probability is None or probability >= least)


def quality_rules(
    docs: DataFrame, model: Model | None, least: float = LEAST, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """A row per document: its id, the counts, ``base_failed``, ``probability`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeated`` per cent of them
    inside repeated 3-word windows. Others are kept if the model gives them a probability of
    quality of ``least`` or more; without a model all are. NULL and empty texts have no
    words and fail. Repeated rows and rows without id are judged each; empty tables give no
    rows; other columns are not read.

    Scored in Arrow batches without a shuffle, whole texts in blocks; the model, of fixed
    size, goes along with the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t.as_py() or "", shared.value, least, min_words, max_repeated) for t in batch["text"]]
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch["id"], *map(pa.array, columns, kinds)], ["id", *made])

    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    wanted = docs.select(column(id_column).alias("id"), column(text_column).alias("text"))
    types = ["bigint"] * 5 + ["boolean", "double", "boolean"]
    schema = f"id {wanted.schema['id'].dataType.simpleString()}, " + ", ".join(map(" ".join, zip(made, types)))
    return wanted.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def quality_filter(docs: DataFrame, model: Model | None, text_column: str = "text", **limits) -> DataFrame:
    """The rows that ``quality_rules`` keeps, with all their columns; judged where they are, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keeps(texts: pa.Array) -> pa.Array:
        return pa.array([judge(t.as_py() or "", shared.value, **limits)[-1] for t in texts], pa.bool_())

    return docs.filter(keeps(column(text_column)))
