"""Byte-level BPE: texts to token ids and back to bytes, by a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from dwellspark.llm.rows import column

#: Characters of a text that are encoded at a time, or a little more.
PIECE = 1 << 16
#: A cut before a blank or line end that follows something else: no match of the patterns meant here
#: (words, numbers or signs with a blank before them, runs of white space) reaches across it or looks back.
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: Unicode white space, as the patterns' ``\s`` has it, in runs so long that looking back over them would exhaust the stack.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; loaded once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def blank_runs(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether each is one match of ``\\s+(?!\\S)`` or ``\\s+``: a very long run of white space.

    A run starts a match, and leaves its last character to what follows, unless the text ends there.
    """
    at = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``size``, cut only where no token can lie across."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(coder: tiktoken.Encoding, text: str, whole: tiktoken.Encoding) -> np.ndarray:
    """Ids of the whole text, as encoding it at once would give them; special tokens are ordinary text.

    ``whole`` has the same ranks and takes a run of white space as one match.
    """
    found = []
    for part, is_run in blank_runs(text):
        found += [np.array(whole.encode_ordinary(part), "<u4")] if is_run else [np.array(coder.encode_ordinary(p), "<u4") for p in pieces(part)]
    return np.concatenate(found)


def bpe(
    docs: DataFrame, path: str, pattern: str, ids_column: str | None = "token_ids", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """A row per document: its id, ``token_ids``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit numbers, ``decoded_sha256``
    of the bytes that the ids stand for; both in lower-case hex. NULL text is empty and has
    no ids. ``ids_column`` None leaves the ids out. Repeated rows and rows without id are
    encoded each; empty tables give no rows; other columns are not read, and their names
    don't matter. ``path`` must lead to the rank file on every worker.

    Each text is encoded by itself in Arrow batches, without a shuffle; texts of any length
    go through in pieces, very long runs of white space as the single matches that they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder, whole, ids, rest = encoding(path, pattern), encoding(path, r"\s+"), [], []
            for text in batch["text"]:
                ids.append(encode(coder, text.as_py() or "", whole))
                back = sha256()
                for at in range(0, len(ids[-1]), PIECE):
                    back.update(coder.decode_bytes(ids[-1][at : at + PIECE].tolist()))
                rest.append((len(ids[-1]), sha256(ids[-1].tobytes()).hexdigest(), back.hexdigest()))
            made = [batch["id"]]
            if ids_column:
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                made.append(pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))
            made += [pa.array([r[k] for r in rest], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(made, names)

    types = [pa.int64(), pa.string(), pa.string()]
    names = ["id", *(["ids"] if ids_column else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    wanted = docs.select(column(id_column).alias("id"), column(text_column).alias("text"))
    id_type = wanted.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, " + ("ids array<int>, " if ids_column else "") + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    made = wanted.mapInArrow(run, schema)
    return made.withColumnsRenamed({"id": id_column, "ids": ids_column} if ids_column else {"id": id_column})


def decode(encoded: DataFrame, path: str, pattern: str, ids_column: str = "token_ids", bytes_column: str = "bytes") -> DataFrame:
    """The rows with ``bytes``: the raw bytes that the ids stand for, which need not be whole characters.

    NULL ids stay NULL; an input column named like the output is replaced.
    """

    @F.arrow_udf("binary")
    def back(ids: pa.Array) -> pa.Array:
        coder = encoding(path, pattern)
        return pa.array([None if x.as_py() is None else coder.decode_bytes(x.as_py()) for x in ids], pa.binary())

    return encoded.withColumn(bytes_column, back(column(ids_column)))
