"""WARC files: write, index, and read selected records.

Reading goes by the index. First every file is scanned once and a row per record is written: file, offset, length, type, URL,
digest, record id. Records are then selected with ordinary DataFrame filters or joins on that small table; no file is touched.
Last, the selected rows are put in ranges of (file, offset) of some ``TASK_BYTES`` each, and in each those less than ``gap`` bytes apart are
coalesced into one read of at most ``most`` bytes, of which only the selected records are inflated and parsed.

A record that can't be read (cut off, damaged, without a header) has a row that says so in ``problem``; the scan goes on at the next record.

Files are .warc.gz with one gzip member for each record, or plain .warc. Paths are URIs of any file system that
pyarrow.fs can open, on which all executors must see the files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, shared_folder, table

GAP = 1 << 16
MOST = 16 << 20
FILE_BYTES = 1 << 30
TASK_BYTES = 64 << 20
#: More files than this are scanned several to a task.
MAX_TASKS = 20_000
INDEX = "file string, offset long, length long, type string, url string, digest string, record_id string, problem string"
RECORDS = INDEX + ", payload string, digest_ok boolean"


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes) -> bytes:
    """A response record with its payload as an HTTP message. White space in a URL is percent-encoded; a field of our own then has the URL as it was."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        target = "".join(f"%{ord(c):02X}" if c in "\r\n\t " else c for c in url)
        head.append("WARC-Target-URI: " + target)
        if target.strip() != url:
            head.append("X-Original-URL: " + quote(url, safe=""))
    head += [f"WARC-Payload-Digest: {_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _member(raw: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_files(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as .warc.gz files below ``folder``; returns a row (file, records) for each file.

    Every attempt of a task writes files of its own, and only those of the successful attempt are in the result, so
    lost executors and repeated tasks do no harm. A null html has no record; an empty one has an empty payload. A null
    page_id is written as record id "urn:page:". Rows are written as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is not None and size > file_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n]})
                    out = None
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)  # else the name makes it compress once more
                raw = _member(record_bytes(f"urn:page:{'' if page_id is None else page_id}", url, html.encode()))
                out.write(raw)
                size += len(raw)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n]})

    return pages.filter("html IS NOT NULL").select("page_id", "url", "html").mapInArrow(run, "file string, records long")


def _header(raw: bytes) -> tuple[dict[str, str], int, int]:
    """Named fields of a record (names in small letters), where its block begins, and where it ends."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdecimal():
        raise ValueError("a WARC record without a length")
    return fields, end + 4, end + 4 + int(size)


def _dechunked(body: bytes) -> bytes:
    """The body of chunks; as far as they go where they are damaged."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes, bytes, bytes]:
    """The payload as stored, without its transfer encoding, and without its content encoding (gzip and deflate; others stay)."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, block, block
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return block, block, block
    http = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        http[name.strip().lower()] = value.strip().lower()
    whole = _dechunked(body) if b"chunked" in http.get(b"transfer-encoding", b"") else body
    plain = whole
    for kind in reversed(http.get(b"content-encoding", b"").split(b",")):
        try:
            if kind.strip() in (b"gzip", b"x-gzip"):
                plain = zlib.decompressobj(31).decompress(plain)
            elif kind.strip() == b"deflate":
                plain = zlib.decompressobj(15 if plain[:1] == b"x" else -15).decompress(plain)
        except zlib.error:
            break
    return body, whole, plain


class _Window:
    """A stream read forwards; ``data`` is what is held of it, from byte ``at`` of the file on."""

    def __init__(self, stream) -> None:
        self.stream, self.data, self.at = stream, bytearray(), 0

    def more(self) -> bool:
        got = self.stream.read(1 << 20)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _resume(w: _Window, mark: bytes, good) -> int:
    """How far it is to the next place at which a record begins, or to the end of the file."""
    i = 1
    while True:
        found = w.data.find(mark, i)
        if found < 0:
            i = max(1, len(w.data) - len(mark) + 1)
            if not w.more():
                return len(w.data)
        elif len(w.data) - found < 4096 and w.more():
            pass
        elif good(bytes(w.data[found : found + 4096])):
            return found
        else:
            i = found + 1


def _begins_member(raw: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(raw, 5) == b"WARC/"
    except zlib.error:
        return False


def _scan(fs: pafs.FileSystem, path: str) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """(offset, length in the file, record, None) of each record, one at a time; (offset, length, None, problem) of what can't be read."""
    with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
        w = _Window(f)
        w.more()
        packed = w.data[:2] == b"\x1f\x8b"
        while w.data or w.more():
            problem, raw, size = None, None, 0
            try:
                if packed:
                    z, parts = zlib.decompressobj(31), []
                    while not z.eof:
                        if size == len(w.data) and not w.more():
                            raise ValueError("cut off")
                        parts.append(z.decompress(bytes(w.data[size:])))
                        size = len(w.data) - len(z.unused_data)
                    raw = b"".join(parts)
                else:
                    while (end := w.data.find(b"\r\n\r\n")) < 0 and len(w.data) < 1 << 22 and w.more():
                        pass
                    size = _header(bytes(w.data[: max(0, end + 4)]))[2] + 4
                    while len(w.data) < size and w.more():
                        pass
                    if len(w.data) < size - 4:
                        raise ValueError("cut off")
                    size = min(size, len(w.data))
                    raw = bytes(w.data[:size])
            except (ValueError, zlib.error) as e:
                problem, raw = str(e), None
                if packed:
                    size = _resume(w, b"\x1f\x8b\x08", _begins_member)
                else:
                    size = _resume(w, b"WARC/1.", lambda x: b"\r\nwarc-type:" in x[: x.find(b"\r\n\r\n")].lower())
            yield w.at, size, raw, problem
            w.skip(size)


def index(files: DataFrame) -> DataFrame:
    """The index of the WARC files named in ``files``.file: a row for each record, see ``INDEX``. Written to the shared folder.

    Records without a URL have null there; a digest that a record doesn't name is computed. What can't be read has a row with only its place and a
    ``problem``. Files named twice are scanned once, null names never, an empty file or table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                rows: list[tuple] = []
                for at, size, raw, problem in _scan(fs, path):
                    fields: dict[str, str] = {}
                    url = digest = ident = None
                    if raw is not None:
                        try:
                            fields, begin, end = _header(raw)
                            if end > len(raw):
                                raise ValueError("cut off")
                            url = unquote(fields["x-original-url"]) if "x-original-url" in fields else fields.get("warc-target-uri")
                            digest = fields.get("warc-payload-digest") or _digest(_payload(fields, raw[begin:end])[0])
                            ident = fields.get("warc-record-id", "").strip("<>")
                        except ValueError as e:
                            fields, problem = {}, str(e)
                    rows.append((uri, at, size, fields.get("warc-type"), url, digest, ident, problem))
                    if len(rows) == 10_000:
                        yield _batch(rows, _INDEX_SCHEMA)
                        rows = []
                if rows:
                    yield _batch(rows, _INDEX_SCHEMA)

    names = cut(files.select("file").filter("file IS NOT NULL").distinct(), "warc-names")
    return cut(names.repartitionByRange(max(1, min(names.count(), MAX_TASKS)), "file").mapInArrow(run, INDEX), "warc-index")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(schema.names, zip(*rows))}, schema=schema)


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, int, int]]:
    """(offset, length, first, end) of the reads that cover ranges sorted by offset; ranges[first:end] lie in the read.

    A record longer than ``most`` is one read.
    """
    out: list[tuple[int, int, int, int]] = []
    for i, (at, size) in enumerate(ranges):
        if out:
            start, length, a, _ = out[-1]
            end = max(start + length, at + size)
            if at <= start + length + gap and end - start <= most:
                out[-1] = (start, end - start, a, i + 1)
                continue
        out.append((at, size, i, i + 1))
    return out


def read_records(selected: DataFrame, gap: int = GAP, most: int = MOST) -> DataFrame:
    """The records of the index rows ``selected`` with their payload as text; see ``RECORDS``. Rows repeated are read and given as often.

    Transfer encodings and gzip or deflate are undone; bytes that aren't UTF-8 become U+FFFD. ``digest_ok`` compares the payload (with or
    without its transfer encoding) with the index's digest, null if that isn't a sha1. Rows with a problem, and records that
    can't be read any more, have a null payload and their ``problem``. Tasks are as many as the records' bytes need, whatever the number of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_uri, stream = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            a = 0
            while a < len(rows):
                b = a
                while b < len(rows) and rows[b][0] == rows[a][0]:
                    b += 1
                if open_uri != rows[a][0]:
                    if stream:
                        stream.close()
                    fs, path = pafs.FileSystem.from_uri(rows[a][0])
                    stream, open_uri = fs.open_input_file(path), rows[a][0]
                for start, length, i, j in coalesce([(r[1], r[2]) for r in rows[a:b]], gap, most):
                    stream.seek(start)
                    chunk = stream.read(length)
                    out = []
                    for r in rows[a + i : a + j]:
                        text = ok = None
                        problem = r[7]
                        try:
                            if problem is None:
                                raw = chunk[r[1] - start : r[1] - start + r[2]]
                                raw = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
                                fields, begin, end = _header(raw)
                                stored, whole, plain = _payload(fields, raw[begin:end])
                                ok = r[5] in (_digest(stored), _digest(whole)) if (r[5] or "").startswith("sha1:") else None
                                text = plain.decode("utf-8", "replace")
                        except (ValueError, zlib.error) as e:
                            problem = str(e)
                        out.append((*r[:7], problem, text, ok))
                    yield _batch(out, _SCHEMA)
                a = b
        if stream:
            stream.close()

    columns = [x.split()[0] for x in INDEX.split(", ")]
    rows = selected.select(*columns)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-total // TASK_BYTES), min(n, rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA, _INDEX_SCHEMA = (pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in form.split(", ")]) for form in (RECORDS, INDEX))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` by way of WARC files: written, indexed, and every HTML response read back through the index.

    Pages with a null html, which have no record, are given as they are. Null and negative ids, empty pages, repeated rows and an empty
    table come back as they were.
    """
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    files = cut(write_files(pages, folder), "warc-files")
    found = index(files)
    records = read_records(found.filter("type = 'response'"))
    read = records.select(F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1).try_cast("long").alias("page_id"), "url", F.col("payload").alias("html"), F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"), "digest_ok")
    bare = pages.filter("html IS NULL").select("page_id", "url", "html", F.octet_length("html").cast("long").alias("n_bytes"), F.sha1("html").alias("sha1"), F.lit(True).alias("digest_ok"))
    return read.unionByName(bare)


OP10_SQL = "SELECT page_id, url, html, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha1(html) AS sha1, true AS digest_ok FROM pages"
