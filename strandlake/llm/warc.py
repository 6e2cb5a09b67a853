"""WARC archives: whole-file gzip streams rewritten as one member a record, with an offset index.

Archives are rows of a table (name, data, cdx), so that they can be in any
store that Spark writes; export() makes files of them. The first write is one
gzip stream for a whole archive. The normaliser inflates that stream once, in
pieces, and writes every record as its own gzip member, with a line of the
sidecar index: record id, type, offset, length. Reading goes by that index.

Of pages with equal payloads of at least LEAST bytes the one with the smallest
page_id is a response, the others revisit it; equal page_ids are one page
repeated and stay responses together. A null page_id ranks last, a null html is
an empty payload, a null url about:blank. An empty table gives an empty one. A
very long page is an archive by itself, held at once. Other columns than
page_id, url and html are not looked at.
"""

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import join_checked, map_arrow, text_or_empty, written

LEAST = 100
#: Bytes of records in an archive, about.
ARCHIVE_BYTES = 16 << 20
STREAM_LEVEL, MEMBER_LEVEL = 1, 4
_END = b"\r\n\r\n"


def _uri(url: str | None) -> bytes:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank").encode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit has the HTTP head only, and the length of what it stands for."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    block = head + payload if refers_to is None else head
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Target-URI: " + _uri(url),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Record-ID: <urn:page:%s>" % str("" if page_id is None else page_id).encode(),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + _END + block + _END


def inflated(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces."""
    at, z = 0, zlib.decompressobj(31)
    while at < len(data) or z.unconsumed_tail:
        chunk = z.unconsumed_tail
        if not chunk:
            chunk, at = data[at : at + step], at + step
        while chunk:
            yield z.decompress(chunk, 4 * step)
            if z.eof:
                chunk, z = z.unused_data, zlib.decompressobj(31)
            else:
                chunk = z.unconsumed_tail


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream, as they stand in it."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                if (end := held.find(_END)) < 0:
                    break
                need = end + 4 + int(field(bytes(held[:end]), b"Content-Length")) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def field(head: bytes, name: bytes) -> bytes | None:
    """Value of a header line."""
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.lower() == name.lower():
            return value.strip()
    return None


def normalised(data: bytes) -> tuple[bytes, list[tuple[str, str, int, int]]]:
    """A whole-file stream as one member a record, with id, type, offset and length of each."""
    parts, index, at = [], [], 0
    for one in records_of(inflated(data)):
        z = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
        member = z.compress(one) + z.flush()
        head = one[: one.find(_END)]
        index.append((field(head, b"WARC-Record-ID").decode(), field(head, b"WARC-Type").decode(), at, len(member)))
        parts.append(member)
        at += len(member)
    return b"".join(parts), index


def _page(value: bytes | None) -> int | None:
    name = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(name) if name else None


def parsed(one: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; a payload is checked against its digest."""
    head, _, block = one[:-4].partition(_END)
    http, _, payload = block.partition(_END)
    kind, digest = field(head, b"WARC-Type").decode(), field(head, b"WARC-Payload-Digest").decode().removeprefix("sha256:")
    n = int(field(http, b"Content-Length"))
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"a payload differs from its digest {digest}")
    return _page(field(head, b"WARC-Record-ID")), n, digest, kind, _page(field(head, b"WARC-Refers-To"))


def write_streams(pages: DataFrame) -> DataFrame:
    """name and data of archives, each one gzip stream, from pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = rows.where(F.octet_length("html") >= LEAST).select("digest", "page_id")
    again = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marked = join_checked(rows, written(again, "warc-again"), "digest", "left")
    marked = marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches):
        from pyspark import TaskContext

        part, k, z, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for page, url, digest, refers, html in zip(*cols, b.column("html").cast(pa.binary()), strict=True):
                z = z or zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, 31)
                one = record(page, url, html.as_py(), digest, refers)
                held.append(z.compress(one))
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    held.append(z.flush())
                    yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:06d}"]), pa.array([b"".join(held)])], ["name", "data"])
                    k, z, held, size = k + 1, None, [], 0
        if z:
            held.append(z.flush())
            yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:06d}"]), pa.array([b"".join(held)])], ["name", "data"])

    return marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "name string, data binary")


def normalise(streams: DataFrame) -> DataFrame:
    """name, data and cdx: archives of one member a record, and their index, one line a record."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("data"), strict=True):
                out, index = normalised(data.as_py())
                cdx = "".join(f"{i} {t} {o} {n}\n" for i, t, o, n in index)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out]), pa.array([cdx])], ["name", "data", "cdx"])

    return streams.mapInArrow(run, "name string, data binary, cdx string")


def read_back(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, each inflated at its offset."""

    def f(batch: pa.RecordBatch):
        rows = []
        for data, cdx in zip(batch.column("data"), batch.column("cdx").to_pylist(), strict=True):
            raw = memoryview(data.as_buffer())
            for line in cdx.splitlines():
                _, _, at, n = line.rsplit(" ", 3)
                rows.append(parsed(zlib.decompress(raw[int(at) : int(at) + int(n)], 31)))
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], names)

    return map_arrow(archives, f, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written, normalised and read back."""
    streams = written(write_streams(pages), "warc-streams", "none")
    return read_back(written(normalise(streams), "warc-archives", "none"))


def export(archives: DataFrame, folder: str) -> None:
    """Archives as name.warc.gz and name.cdx in a folder that all executors reach."""

    def run(batches):
        import pyarrow.fs as pafs

        fs, inner = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(inner)
        for b in batches:
            for name, data, cdx in zip(b.column("name").to_pylist(), b.column("data").to_pylist(), b.column("cdx").to_pylist(), strict=True):
                for end, content in ((".warc.gz", data), (".cdx", cdx.encode())):
                    with fs.open_output_stream(f"{inner}/{name}{end}", compression=None) as out:
                        out.write(content)
            yield b.select(["name"])

    archives.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
