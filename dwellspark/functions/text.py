"""Text cleaning."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# Unicode white space as Python sees it: the Java class under (?U) plus four separators.
SPACE = r"(?U)[\s\x1c-\x1f]"


# Bytes of texts that a Python worker takes apart at once; an Arrow batch has many rows, however long they are.
SLICE_BYTES = 4 << 20


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in order, in slices of about ``most`` bytes, or one text where it is longer; at least one slice."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    borders = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for start, end in zip([0, *borders], [*borders, len(texts)]):
        yield texts.slice(start, end - start)


@F.arrow_udf(T.StringType())
def _decode_entities(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([
        pa.array([t if t is None else html.unescape(t) for t in part.to_pylist()], pa.string()) for part in byte_slices(texts)
    ])


def html_unescape(text: Column) -> Column:
    """Decode HTML5 entities, once. Only texts with an ampersand travel to Python."""
    return F.coalesce(_decode_entities(F.when(F.contains(text, F.lit("&")), text)), text)


def collapse_whitespace(text: Column) -> Column:
    """Every run of Unicode white space becomes one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def trim_text(text: Column) -> Column:
    """Strip both ends; after collapsing there are only plain spaces left to strip."""
    return F.trim(text)


def strip_whitespace(text: Column) -> Column:
    """Strip both ends of any Unicode white space."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clean_text(text: Column) -> Column:
    """NULL and empty become ``''``; otherwise unescape, collapse, strip, in this order."""
    return trim_text(collapse_whitespace(html_unescape(F.coalesce(text, F.lit("")))))


def preview(text: Column, length: int = 60) -> Column:
    """The first characters of a text and ``...``, as shown beside a score."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))
