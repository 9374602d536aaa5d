"""WARC: archives written as one gzip stream, normalised to a member per record with an offset index."""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dwellspark.llm.rows import column
from dwellspark.session import cut_lineage, file_system, new_folder

#: Payload bytes after which a task begins another archive, and bytes read at a time.
ARCHIVE, CHUNK = 128 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _publish(files: fs.FileSystem, made: str, path: str) -> None:
    """A file appears whole; if a task runs again, the same bytes replace it."""
    files.move(made, path)


def _attempt() -> str:
    return f"{TaskContext.get().taskAttemptId()}"


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that refers to the page which has it."""
    digest = base64.b32encode(sha1(payload).digest()).decode()
    http = HTTP.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name, without the first line."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs if name.strip()}


def revisits(pages: DataFrame, min_bytes: int = 0, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload the page of the largest id also has.

    Only ids, digests and sizes are shuffled. Largest ids combine on the map side; Spark
    splits a digest that very many pages share in the join.
    """
    payload = F.coalesce(column(html_column), F.lit(""))
    seen = pages.select(column(id_column).alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    seen = seen.filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
    shared = seen.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    # Written, so that the join shuffles both sides anew and Spark can split a hot digest.
    shared = cut_lineage(shared.filter("n > 1").select("digest", "size", "refers_to"))
    return seen.join(shared, ["digest", "size"]).filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE,
    id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
) -> DataFrame:
    """Writes each page as a record into archives under ``folder``; returns ``path, records``.

    Every archive is one gzip stream. A task writes its pages in order of id, so the same
    files come out if it runs again; each is written beside its place and then moved there.
    """
    payload = F.coalesce(column(html_column), F.lit(""))
    rows = pages.select(
        column(id_column).alias("page_id"), column(url_column).alias("url"), payload.alias("html"), F.sha1(payload).alias("digest")
    )
    rows = rows.join(revisits(pages, min_bytes, id_column, html_column), ["page_id", "digest"], "left").drop("digest")
    rows = rows.sortWithinPartitions("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        part, out, count, size, done = TaskContext.get().partitionId(), None, 0, 0, []

        def close() -> None:
            out.write(packer.flush())
            out.close()
            _publish(files, hidden, path)
            done.append((path, count))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name = f"pages-{part:05d}-{len(done):03d}.warc.gz"
                    files.create_dir(f"{root}/raw", recursive=True)
                    path, hidden = f"{root}/raw/{name}", f"{root}/raw/_{_attempt()}-{name}"
                    out, packer, count, size = files.open_output_stream(hidden, compression=None), zlib.compressobj(6, wbits=31), 0, 0
                body = html.as_py().encode()
                out.write(packer.compress(record(page_id.as_py(), url.as_py(), body, refers_to.as_py())))
                count, size = count + 1, size + len(body)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0].removeprefix(root + "/") for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return _kept(rows.mapInArrow(run, "path string, records bigint"), f"{folder}/raw-list")


def _kept(made: DataFrame, path: str) -> DataFrame:
    """The list of written files, itself written: the tasks that wrote them are not run again by reading it."""
    made.write.parquet(path)
    spark = made.sparkSession
    files = spark.read.schema(made.schema).parquet(path)
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "path")


def inflate(source: pa.NativeFile) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or several, a chunk at a time; a stream cut short is an error."""
    unpacker, inside = zlib.decompressobj(wbits=31), False
    while chunk := source.read(CHUNK):
        inside = True
        while True:
            part = unpacker.decompress(chunk, CHUNK)
            yield part
            if unpacker.eof:
                chunk, unpacker = unpacker.unused_data, zlib.decompressobj(wbits=31)
                if not chunk:
                    inside = False
                    break
            elif not (chunk := unpacker.unconsumed_tail) and len(part) < CHUNK:
                break
    if inside:
        raise EOFError("the gzip stream ends inside a member")


class _Records:
    """Takes a stream apart: each record's header, then its block in pieces."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.have = chunks, bytearray()

    def _more(self) -> bool:
        for chunk in self.chunks:
            self.have += chunk
            return True
        return False

    def head(self) -> bytes | None:
        while (end := self.have.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.have.strip():
                    raise EOFError("the archive ends inside a record's header")
                return None
        head = bytes(self.have[: end + 4])
        del self.have[: end + 4]
        return head

    def block(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.have and not self._more():
                raise EOFError("the archive ends inside a record's block")
            part = bytes(self.have[:length])
            del self.have[: len(part)]
            length -= len(part)
            yield part


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive of ``path`` rewritten with a gzip member per record; returns ``path, records``.

    An archive is inflated once, from begin to end, in pieces: memory does not grow with
    archive or record. Beside it goes an index (``.idx``, a JSON line for each record:
    offset and length of its member, record id, type, page). A task works on whole archives,
    whose size the writer bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        for batch in batches:
            done = []
            for path in (p.as_py() for p in batch["path"]):
                name = path.rsplit("/", 1)[-1]
                files.create_dir(f"{root}/members", recursive=True)
                hidden, index = f"{root}/members/_{_attempt()}-{name}", []
                with files.open_input_stream(f"{root}/{path}", compression=None) as source, files.open_output_stream(hidden, compression=None) as out:
                    records = _Records(inflate(source))
                    while (head := records.head()) is not None:
                        about, at, packer = fields(head), out.tell(), zlib.compressobj(6, wbits=31)
                        out.write(packer.compress(head))
                        for part in records.block(int(about["content-length"]) + 4):
                            out.write(packer.compress(part))
                        out.write(packer.flush())
                        index.append({"offset": at, "length": out.tell() - at, "id": about["warc-record-id"], "type": about["warc-type"], "page": about.get("x-page-id")})
                with files.open_output_stream(hidden + ".idx", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                _publish(files, hidden + ".idx", f"{root}/members/{name}.idx")
                _publish(files, hidden, f"{root}/members/{name}")
                done.append((f"members/{name}", len(index)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return _kept(archives.select("path").mapInArrow(run, "path string, records bigint"), f"{folder}/members-list")


#: Bytes of payloads in a batch of records, or one record more.
HELD_BYTES = 16 << 20
READ = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def read_records(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of normalised archives, each member found by the index and read by itself.

    ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) are of the full payload, of a
    revisit as its header has them. A response whose payload does not match its digest is
    an error. With ``payloads`` also ``payload``, NULL for revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        for path in (p.as_py() for batch in batches for p in batch["path"]):
            with files.open_input_stream(f"{root}/{path}.idx", compression=None) as source:
                index = [json.loads(line) for line in source.read().splitlines()]
            with files.open_input_file(f"{root}/{path}") as source:
                rows, held = [], 0
                for at, x in enumerate(index, 1):
                    row = read_record(zlib.decompress(source.read_at(x["length"], x["offset"]), 31))
                    rows.append(row[: len(kinds)])  # the payload goes at once unless it is asked for
                    held += len(row[-1] or b"") if payloads else 0
                    if len(rows) == 500 or held > HELD_BYTES or at == len(index):
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names)
                        rows, held = [], 0

    names = [f.split()[0] for f in READ.split(", ")] + ["payload"] * payloads
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payloads
    return archives.select("path").mapInArrow(run, READ + ", payload binary" * payloads)


def read_record(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    about = fields(head)
    block = rest[: int(about["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = about["warc-payload-digest"].removeprefix("sha1:")
    revisit = about["warc-type"] == "revisit"
    if not revisit and base64.b32encode(sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {about['warc-record-id']} does not match its digest")
    size = int(fields(http)["content-length"])
    return about.get("x-page-id"), about.get("warc-target-uri"), size, digest, about["warc-type"], about.get("x-refers-to-page-id"), None if revisit else payload


def through_warc(pages: DataFrame, min_bytes: int = 0, id_column: str = "page_id", **options) -> DataFrame:
    """Pages written as archives, normalised, and read back: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id
    is a response, the others are revisits that refer to it. NULL html is an empty payload;
    rows without id are responses and not referred to; rows that share the largest id of a
    payload are all responses. Line ends in a url are percent-encoded. Empty tables give no
    rows; other columns are not archived.

    Files go to a new folder in the shared folder and stay there, since the rows are read
    from them; ``spark.checkpoint.dir`` is where to clear them.
    """
    folder = new_folder(pages.sparkSession, "warc")
    kind = pages.schema[id_column].dataType
    members = normalise(write_archives(pages, folder, min_bytes, id_column=id_column, **options), folder)
    read = read_records(members, folder)
    return read.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("page_id", id_column)
