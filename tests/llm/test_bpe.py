import base64
import hashlib

import numpy as np
import pytest
import tiktoken

from dwellspark.llm import bpe as B
from dwellspark.llm.queries import PATTERN, RANKS, op7_bpe


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def row(coder, doc_id, text):
    ids = np.array(coder.encode_ordinary(text or ""), "<u4")
    return doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query(spark, folder, documents, coder):
    assert sorted(map(tuple, op7_bpe(spark, folder).collect())) == sorted(row(coder, r.doc_id, r.text) for r in documents.collect())


def test_odd_rows_and_round_trip(make, odd, coder):
    rows = odd + [(20, "<|endoftext|> it's"), (21, "日本語 🎉\r\n\t x  "), (22, "a" * 3000)]
    df = B.bpe(make(rows), RANKS, PATTERN)
    assert df.columns == ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted([(r.doc_id, *r[2:]) for r in df.collect()], key=repr)
    assert got == sorted([row(coder, *r) for r in rows], key=repr)
    back = {r.doc_id: bytes(r.bytes) for r in B.decode(df, RANKS, PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}
    assert B.bpe(make(rows).limit(0), RANKS, PATTERN).collect() == []


@pytest.mark.parametrize("blank", [" ", "\n", "  ", " \n\n ", "\t", "\x1c ", "  ", "\x85\n", "'s ", " 's"])
def test_pieces_encode_like_the_whole(coder, blank):
    text = blank.join(f"Wört{i} 12 it'll !? é{blank}" for i in range(300))
    for size in (1, 7, 50, 10**6):
        parts = list(B.pieces(text, size))
        assert "".join(parts) == text
        assert [x for p in parts for x in coder.encode_ordinary(p)] == coder.encode_ordinary(text), size


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n\t", "\u3000 ", "\x85"])
def test_long_runs_of_white_space_encode_like_their_matches(coder, blank):
    import regex

    whole = B.encoding(RANKS, r"\s+")
    for text in (blank * 5000, f"a{blank * 5000}b", f"{blank * 5000}'s{blank * 6000} {blank * 4500}", f"x{blank * 4096}\x1c{blank * 4096}7"):
        matches = regex.findall(PATTERN, text)
        assert "".join(matches) == text
        expected = [i for m in matches for i in coder._encode_single_piece(m)]
        assert B.encode(coder, text, whole).tolist() == expected == coder.encode_ordinary(text)


def test_ten_million_blanks_do_not_end_a_worker(make, coder):
    n = 10**7
    texts = {1: " " * n + "word", 2: "\n" * n, 3: "a" + "\t" * n + "é", 4: " \n" * (n // 2)}
    got = {r.doc_id: r for r in B.bpe(make(list(texts.items())), RANKS, PATTERN, ids_column=None).collect()}
    for i, text in texts.items():
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    matches = [" " * (n - 1), " word"]
    ids = np.array([i for m in matches for i in coder._encode_single_piece(m)], "<u4")
    assert (got[1].n_tokens, got[1].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
