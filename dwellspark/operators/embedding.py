"""Texts to vectors behind one interface: an embedder turns a text column into a vector column."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dwellspark.functions.phrases import structured_text
from dwellspark.functions.text import byte_slices
from dwellspark.schema import VECTOR

# Default model, its vector size and the texts per encoder call.
MODEL_NAME = "intfloat/multilingual-e5-base"
MODEL_DIM = 768
ENCODE_BATCH = 32


class Embedder(Protocol):
    name: str
    dim: int

    def column(self, text: Column) -> Column:
        """Vector of the text as ARRAY<FLOAT>; NULL for NULL or blank text."""

    def columns(self, *texts: Column) -> Column:
        """Vectors of several texts as a struct of v0, v1, …"""


# Hashes of tokens that a Python worker keeps from batch to batch, some tens of MB.
HASHED = 300_000
_HASHES: dict[bytes, int] = {}


def not_blank(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, text)


def token_buckets(tokens: pa.Array, dim: int) -> np.ndarray:
    """Bucket of every token: the first 32 bits of its md5 modulo ``dim``.

    Each distinct token of the batch is looked up once, and hashed if it is not among the
    ``HASHED`` that the worker has kept.
    """
    coded = tokens.dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    if len(_HASHES) > HASHED:
        _HASHES.clear()
    _HASHES.update((w, int.from_bytes(md5(w).digest()[:4])) for w in words if w not in _HASHES)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.int64, len(words))
    return (hashes % dim)[coded.indices.to_numpy()]


def vector_array(rows: np.ndarray, known: np.ndarray) -> pa.Array:
    """The rows as vectors at the places where ``known`` is set, NULL elsewhere."""
    dim = rows.shape[1]
    offsets = np.concatenate([[0], np.cumsum(known * dim)]).astype(np.int32)
    values = pa.array(rows.astype(np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~known))


class HashingEmbedder:
    """Hashed counts of the white-space tokens, for runs without a model.

    Deterministic and free of state; a text without a token gets NULL.
    """

    def __init__(self, dim: int = 64, normalize: bool = True):
        self.name = f"hashing-{dim}"
        self.dim = dim
        self.normalize = normalize

    def column(self, text: Column) -> Column:
        dim, normalize = self.dim, self.normalize

        def part(texts: pa.Array) -> pa.Array:
            n = len(texts)
            parts = pc.ascii_split_whitespace(texts.fill_null(""))
            row = np.repeat(np.arange(n), pc.list_value_length(parts).to_numpy())
            tokens = parts.flatten()
            real = pc.not_equal(tokens, "")
            cell = row[real.to_numpy(zero_copy_only=False)] * dim + token_buckets(tokens.filter(real), dim)
            rows = np.bincount(cell, minlength=n * dim).reshape(n, dim).astype(np.float64)
            length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
            if normalize:
                rows /= np.where(length > 0, length, 1.0)[:, None]
            return vector_array(rows[length > 0], length > 0)

        @F.arrow_udf(VECTOR)
        def embed(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([part(some) for some in byte_slices(texts)])

        return embed(F.lower(text))

    def columns(self, *texts: Column) -> Column:
        return F.struct(*[self.column(text).alias(f"v{n}") for n, text in enumerate(texts)])


class ModelEmbedder:
    """A sentence-transformers model, loaded once per Python worker, when the first text comes.

    Its vectors must have the size ``dim``.
    """

    def __init__(
        self, name: str = MODEL_NAME, dim: int = MODEL_DIM, batch: int = ENCODE_BATCH, normalize: bool = True, load=None
    ):
        self.name, self.dim, self.batch, self.normalize = name, dim, batch, normalize
        self.load = load or _load_model

    def _encode(self, texts: pa.Array) -> pa.Array:
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        rows = np.empty((0, self.dim))
        if known.any():
            rows = _model(self.load, self.name).encode(
                texts.drop_null().to_pylist(), batch_size=self.batch, convert_to_numpy=True,
                normalize_embeddings=self.normalize, show_progress_bar=False,
            )
            if rows.shape[1] != self.dim:
                raise ValueError(f"{self.name} gives {rows.shape[1]} values, not {self.dim}")
        return vector_array(rows, known)

    def column(self, text: Column) -> Column:
        encode = self._encode

        @F.arrow_udf(VECTOR)
        def vector(texts: pa.Array) -> pa.Array:
            return encode(texts)

        return vector(not_blank(text))

    def columns(self, *texts: Column) -> Column:
        encode, names = self._encode, [f"v{n}" for n in range(len(texts))]

        @F.arrow_udf(T.StructType([T.StructField(name, VECTOR) for name in names]))
        def vectors(*texts: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays([encode(part) for part in texts], names)

        return vectors(*[not_blank(text) for text in texts])


# The models this Python worker has loaded.
_MODELS: dict[tuple, Any] = {}


def _model(load: Callable[[str], Any], name: str) -> Any:
    key = (load.__module__, load.__qualname__, name)
    if key not in _MODELS:
        _MODELS[key] = load(name)
    return _MODELS[key]


def _load_model(name: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


def embed_column(df: DataFrame, text: str, embedder: Embedder, name: str = "vector") -> DataFrame:
    """Adds the vector of one text column."""
    return df.withColumn(name, embedder.column(F.col(text)))


def embed_text(text: str, embedder: Embedder) -> Column:
    """The vector of one text; a blank one is an error."""
    if not text or not text.strip():
        raise ValueError("text cannot be empty")
    return embedder.column(F.lit(text))


def embed_listings(listings: DataFrame, embedder: Embedder) -> DataFrame:
    """Adds both vectors: of the structured sentence and of the description.

    The description column is taken, so its vector is called ``description_vector``. Blank
    descriptions get NULL; ``split_rejects`` sets them aside before.
    """
    both = listings.withColumn("_vectors", embedder.columns(structured_text(), F.col("description")))
    vectors = {"structured_vector": F.col("_vectors.v0"), "description_vector": F.col("_vectors.v1")}
    return both.withColumns(vectors).drop("_vectors")


def dimensions(vectors: DataFrame, names: list[str]) -> DataFrame:
    """Per named vector: rows, missing vectors, smallest and largest dimension."""
    long = vectors.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.size(n).alias("dim")) for n in names])).alias("v"))
    return (
        long.groupBy("v.name")
        .agg(
            F.count(F.lit(1)).alias("points_count"),
            F.count_if(F.col("v.dim").isNull()).alias("missing"),
            F.min("v.dim").alias("min_dim"),
            F.max("v.dim").alias("max_dim"),
        )
    )

