"""WARC archives from pages: monolithic gzip files, normalised to one member for each record.

Tasks write their pages as WARC records into files that are one gzip stream
each. The normaliser inflates such a stream once from its beginning, writes
every record again as a gzip member of its own, and beside it an index of
offsets. With the index any record can be read without the rest, which is how
the pages are read back. Of pages with equal payloads one is kept as a response
and the others as revisits that refer to it.

Archives go to the folder that driver and executors share, by the file system
its address names; a file appears under its name only when it is complete.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import scratch_path, table, written

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Bytes of records after which a new archive begins, and bytes read at a time.
ARCHIVE_BYTES = 64 << 20
READ = 1 << 20
#: Tasks that normalise or read archives, at most.
TASKS = 10_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str):
    """The file system of an address, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "" if page_id is None else f"{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(source) -> Iterator[bytes]:
    """A gzip file's contents in pieces, whether it has one member or many."""
    engine = zlib.decompressobj(31)
    while data := source.read(READ):
        while data:
            yield engine.decompress(data, READ)
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data or data
                engine = zlib.decompressobj(31)
    yield engine.flush()


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each record in a stream."""
    held = bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's head is cut off")
        head = headers(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("a record's block is cut off")
        yield head, bytes(held[:size])
        del held[:size]


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in lines[1:]))


class _Whole:
    """A file that gets its name only when it is closed without an error."""

    def __init__(self, uri: str):
        self.fs, self.path = opened(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        ctx = TaskContext.get()
        self.part = f"{self.path}.{ctx.taskAttemptId() if ctx else 0}.part"

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def write_monolith(uri: str, rows: Iterator[bytes]) -> int:
    """Writes records as one gzip stream; returns how many."""
    n, engine = 0, zlib.compressobj(6, zlib.DEFLATED, 31)
    with _Whole(uri) as out:
        for row in rows:
            out.write(engine.compress(row))
            n += 1
        out.write(engine.flush())
    return n


def normalise(source: str, target: str) -> int:
    """Rewrites an archive with a member for each record, and `target`.index with a line for each.

    A line is a JSON list: offset, length, type and id. Returns the number of records.
    """
    files, path = opened(source)
    at = n = 0
    with files.open_input_stream(path, compression=None) as stream, _Whole(target) as out, _Whole(target + ".index") as index:
        for head, whole in records(inflated(stream)):
            engine = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = engine.compress(whole) + engine.flush()
            out.write(member)
            index.write(json.dumps([at, len(member), head["warc-type"], head["warc-record-id"]]).encode() + b"\n")
            at += len(member)
            n += 1
    return n


def indexed_records(target: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record of a normalised archive, found by the index and inflated by itself."""
    files, path = opened(target)
    with files.open_input_stream(path + ".index", compression=None) as index:
        lines = index.read().splitlines()
    with files.open_input_file(path) as archive:
        for at, length, *_ in map(json.loads, lines):
            archive.seek(at)
            whole = zlib.decompress(archive.read(length), 31)
            yield headers(whole[: whole.index(b"\r\n\r\n")]), whole


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _write_rows(base: str, limit: int):
    def rows(batches):
        part, size, held = 0, 0, []
        pid = TaskContext.get().partitionId()

        def finish():
            nonlocal part, size, held
            uri = f"{base}/pages-{pid:06d}-{part:04d}.warc.gz"
            n = write_monolith(uri, iter(held))
            part, size, held = part + 1, 0, []
            return pa.RecordBatch.from_pydict({"archive": [uri], "n": [n]}, schema=pa.schema([("archive", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= limit:
                    yield finish()
        if held:
            yield finish()

    return rows


def _normalise_rows(batches):
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            target = uri.removesuffix(".warc.gz") + ".records.warc.gz"
            n = normalise(uri, target)
            yield pa.RecordBatch.from_pydict({"archive": [target], "n": [n]}, schema=pa.schema([("archive", pa.string()), ("n", pa.int64())]))


_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read_rows(batches):
    def row(head, whole):
        body = whole.index(b"\r\n\r\n") + 4
        http_end = whole.index(b"\r\n\r\n", body) + 4
        http = dict(x.partition(": ")[::2] for x in whole[body : http_end - 4].decode().split("\r\n")[1:])
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        if head["warc-type"] == "response" and hashlib.sha1(whole[http_end:-4]).hexdigest() != digest:
            raise ValueError("a payload differs from its digest")
        to = head.get("warc-refers-to")
        return _page(head["warc-record-id"]), int(http["Content-Length"]), digest, head["warc-type"], _page(to) if to else None

    for batch in batches:
        for target in batch.column("archive").to_pylist():
            held = []
            for head, whole in indexed_records(target):
                held.append(row(head, whole))
                if len(held) == 4096:
                    yield pa.RecordBatch.from_pydict(dict(zip(_BACK.names, zip(*held, strict=True), strict=True)), schema=_BACK)
                    held = []
            if held:
                yield pa.RecordBatch.from_pydict(dict(zip(_BACK.names, zip(*held, strict=True), strict=True)), schema=_BACK)


def _apart(archives: DataFrame) -> DataFrame:
    """A task for each archive, up to a bound. The rows are but paths, so Spark would put them all in one task."""
    return archives.repartitionByRange(max(1, min(TASKS, archives.count())), "archive")


def archived(pages: DataFrame, base: str, least: int = LEAST, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages to archives below `base`, normalises them, and returns a table of these: archive, n.

    pages has page_id (long), url and html; other columns are left out. A null
    html is an empty payload, a null url leaves its header out. Payloads count as
    equal if SHA-1 and length are. A payload of any length is one record; a task
    holds an archive's records, 64 MB and one more. Rows that share the largest page_id of equal
    payloads are all responses; a null page_id is smaller than any other, and if
    no other has that payload, its rows are all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    equal = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    marked = rows.join(equal, ["digest", "size"], "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    marked = marked.select("page_id", "url", "payload", "digest", refers.cast("long").alias("refers_to"))
    monoliths = written(marked.mapInArrow(_write_rows(f"{base}/monolithic", limit), "archive string, n long"), "monoliths")
    return written(_apart(monoliths).mapInArrow(_normalise_rows, "archive string, n long"), "archives")


def read_back(archives: DataFrame) -> DataFrame:
    """A row for each record of normalised archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return _apart(archives).mapInArrow(_read_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir):
    return read_back(archived(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")))


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, payload_bytes, max(page_id) as page_id, count(*) as n from p where payload_bytes >= 1000 group by all)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when m.n > 1 and p.page_id < m.page_id then 'revisit' else 'response' end as record_type,
  case when m.n > 1 and p.page_id < m.page_id then m.page_id end as refers_to
from p left join m on p.payload_digest = m.payload_digest and p.payload_bytes = m.payload_bytes
"""
