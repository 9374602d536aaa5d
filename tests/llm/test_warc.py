import base64
import gzip
import hashlib
import io
import json

import pytest

from dwellspark.llm import warc as W
from dwellspark.llm.queries import op8_warc
from dwellspark.session import new_folder


def expected(rows, least=0):
    top = {}
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= least:
            top[html or ""] = max(top.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data, to = (html or "").encode(), top.get(html or "")
        revisit = page_id is not None and to is not None and to != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


ODD = [
    (1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u\r\nX-Page-Id: 9", ""), (5, "é", "ü\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "u", "long " * 500_000), (7, "u", "long " * 500_000), (7, "u", "long " * 500_000), (None, "n", "<p>x</p>"), (8, "u", None), (9, "", "tiny"), (10, "", "tiny"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, least):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], "page_id bigint, url string, html string, digest string, refers_to int").repartition(3)
    assert found(W.through_warc(df, least)) == expected(ODD, least)
    assert W.through_warc(df.limit(0)).collect() == []


def test_query(spark, folder):
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    assert found(op8_warc(spark, folder)) == expected(pages)


def test_members_index_and_payloads(spark):
    folder = new_folder(spark, "warc-test")
    df = spark.createDataFrame(ODD, "page_id bigint, url string, html string").repartition(2)
    raw = W.write_archives(df, folder, archive_bytes=1_000_000)
    assert raw.count() > 2  # a task goes on in another archive
    members = W.normalise(raw, folder)
    files, root = W.file_system(folder)
    total = 0
    for path, count in members.collect():
        data = files.open_input_file(f"{root}/{path}").read()
        index = [json.loads(x) for x in files.open_input_file(f"{root}/{path}.idx").read().splitlines()]
        assert len(index) == count and sum(x["length"] for x in index) == len(data)
        assert b"".join(gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index) == gzip.decompress(data)
        stream = files.open_input_stream(f"{root}/{path.replace('members', 'raw')}", compression=None).read()
        assert gzip.decompress(stream) == gzip.decompress(data) and gzip.GzipFile(fileobj=io.BytesIO(stream)).read(8) == b"WARC/1.1"
        total += count
    assert total == len(ODD)
    rows = W.read_records(members, folder, payloads=True).collect()
    texts = {h for _, _, h in ODD if h}
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response" and r.payload_bytes} == texts


def test_a_cut_stream_is_an_error():
    class Source(io.BytesIO):
        pass

    whole = gzip.compress(b"x" * 10_000_000) + gzip.compress(b"y" * 10)
    assert b"".join(W.inflate(Source(whole))) == b"x" * 10_000_000 + b"y" * 10
    for cut in (whole[:-3], whole[:5000], gzip.compress(b"abc")[:-9]):
        with pytest.raises(EOFError):
            list(W.inflate(Source(cut)))
    assert list(W.inflate(Source(b""))) == []
    short = W.record(1, "u", b"abc", None)[:-6]
    with pytest.raises(EOFError):
        records = W._Records(iter([short]))
        head = records.head()
        list(records.block(int(W.fields(head)["content-length"]) + 4))
