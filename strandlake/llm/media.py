"""Media columns: texts as 8-bit images, stored in content-defined chunks without repeats.

A text's UTF-8 bytes, padded with 255 to a positive multiple of WIDTH, are the
samples of a binary grey image (PGM) of that width. A gear hash over the image's
bytes cuts it into chunks; digests are compared over all documents by joins, and
a chunk is stored with the first document that has it, by (doc_id, image
digest, number). Every document has the ordered list of its digests; those that
own all of their chunks are read back alone, the others join the chunks that
they borrow. What is read back is checked against the image's digest.

Rows of one doc_id with equal texts are one document repeated; with different
texts, or without a doc_id, they are images of their own. A null text is an
empty one, which is one row of padding. An empty table gives an empty one. A
very long text is one row, of which the image is held at once. Other columns
are not looked at.
"""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import join_checked, map_arrow, text_or_empty, written

WIDTH, PAD = 576, b"\xff"
#: Least and most bytes of a chunk; bits of the hash that are zero at a cut.
LEAST, MOST, BITS = 512, 16384, 11

_GEAR = np.random.default_rng(17).integers(0, 2**32, 256, dtype=np.uint32)
_GRID = np.arange(0, 257, 16)


def payload_of(data: bytes) -> bytes:
    rows = max(1, -(-len(data) // WIDTH))
    return data + PAD * (rows * WIDTH - len(data))


def image_of(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples_of(image: bytes) -> bytes:
    """The payload in an image, after its three header lines."""
    kind, size, depth, samples = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or width != WIDTH or len(samples) != width * height:
        raise ValueError("not an image of this width")
    return samples


def cuts(data: bytes) -> list[int]:
    """Ends of chunks: where the gear hash of the last 32 bytes has BITS leading zeros, within the bounds."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            low = h[:-s] << np.uint32(s)
            h[s:] += low
    out, last = [], 0
    for p in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist() + [len(data)]:
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p - last >= LEAST or p == len(data) and p > last:
            out.append(p)
            last = p
    return out


def chunks(image: bytes) -> list[bytes]:
    ends = cuts(image)
    return [image[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def feature(payload: bytes) -> str:
    """Shares of 16 bands of sample values, then mean and deviation, all in whole thousandths, rounded down from exact values."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    shares = np.add.reduceat(counts, _GRID[:-1]) * 1000 // len(x)
    v, n = np.arange(256), len(x)
    one, two = int((counts * v).sum()), int((counts * v * v).sum())
    return ",".join(map(str, [*shares.tolist(), one * 1000 // n, math.isqrt((n * two - one * one) * 1_000_000 // (n * n))]))


def _images(batch: pa.RecordBatch):
    for data in batch.column("text").cast(pa.binary()):
        text = data.as_py()
        yield len(text), image_of(payload_of(text))


def chunk_list(docs: DataFrame) -> DataFrame:
    """doc_id, key (the image's digest), k and digest of each chunk."""

    def f(batch: pa.RecordBatch):
        rows = []
        for doc, (_, image) in zip(batch.column("doc_id").to_pylist(), _images(batch), strict=True):
            key = xxhash.xxh3_128_digest(image)
            rows += [(doc, key, k, xxhash.xxh3_128_digest(c)) for k, c in enumerate(chunks(image))]
        types = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "key", "k", "digest"])

    return map_arrow(docs, f, "doc_id long, key binary, k int, digest binary")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored images, and the chunks that documents borrow.

    Stored: doc_id, key, n_bytes, digests (of all chunks in order), own (their
    bytes, null where another document has them) and borrows. Borrowed:
    doc_id, key, k, digest, owner_doc, owner_key, owner_k.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    listed = written(chunk_list(texts), "media-lists")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "k")
    owners = listed.groupBy("digest").agg(F.min(place).alias("o"), F.count("*").alias("n")).where("n > 1").select("digest", "o")
    owners = written(owners, "media-owners")  # with a table on either side, a very common chunk is a partition that can be split
    borrowed = listed.join(owners.hint("shuffle_merge"), "digest").where(~place.eqNullSafe(F.col("o"))).select("doc_id", "key", "k", "digest", F.col("o.doc_id").alias("owner_doc"), F.col("o.key").alias("owner_key"), F.col("o.k").alias("owner_k"))
    borrowed = written(written(borrowed, "media-again").distinct(), "media-borrowed")  # apart, as the join could not be split below it
    lists = written(borrowed.groupBy("doc_id").agg(F.collect_list(F.struct("key", "k")).alias("absent")), "media-absent")  # no more than a document has

    def f(batch: pa.RecordBatch):
        rows = []
        for doc, absent, (n, image) in zip(batch.column("doc_id").to_pylist(), batch.column("absent").to_pylist(), _images(batch), strict=True):
            key, parts = xxhash.xxh3_128_digest(image), chunks(image)
            gone = {x["k"] for x in absent or () if x["key"] == key}
            rows.append((doc, key, n, [xxhash.xxh3_128_digest(c) for c in parts], [None if k in gone else c for k, c in enumerate(parts)], len(gone)))
        types = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "key", "n_bytes", "digests", "own", "borrows"])

    both = join_checked(texts, lists, "doc_id", "left")
    return written(map_arrow(both, f, "doc_id long, key binary, n_bytes long, digests array<binary>, own array<binary>, borrows int"), "media-store"), borrowed


def read_back(stored: DataFrame, borrowed: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the digest columns of each stored image, from stored bytes only."""
    wanted = borrowed.select(F.col("owner_doc").alias("doc_id"), F.col("owner_key").alias("owner_key"), F.col("owner_k").alias("owner_k"), "digest").distinct()
    wanted = written(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("owner_key", "owner_k", "digest")).alias("lent")), "media-lent")
    lent = join_checked(stored, wanted, "doc_id", "inner").select("key", "own", F.explode("lent").alias("x")).where("key = x.owner_key")
    lent = lent.select(F.col("x.digest").alias("digest"), F.get("own", F.col("x.owner_k")).alias("data")).dropDuplicates(["digest"])
    lent = written(lent, "media-lent-chunks")
    parts = borrowed.select("doc_id", "key", "k", "digest").join(lent.hint("shuffle_merge"), "digest").groupBy("doc_id", "key").agg(F.collect_list(F.struct("k", "data")).alias("parts"))
    whole = stored.where("borrows = 0").select("doc_id", "key", "n_bytes", "own", F.lit(None).cast("array<struct<k:int,data:binary>>").alias("parts"))
    mixed = join_checked(stored.where("borrows > 0"), parts, ["doc_id", "key"], "left", payload=True).select(whole.columns)

    def f(batch: pa.RecordBatch):
        rows = []
        cols = (batch.column(c) for c in ("doc_id", "key", "n_bytes", "own", "parts"))
        for doc, key, n, own, parts in zip(*cols, strict=True):
            own, lent = own.as_py(), {x["k"]: x["data"] for x in parts.as_py() or ()}
            image = b"".join(lent[k] if c is None else c for k, c in enumerate(own))
            if xxhash.xxh3_128_digest(image) != key.as_py():
                raise ValueError(f"the image of document {doc} is not what was stored")
            p = samples_of(image)
            rows.append((doc.as_py(), n.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(p)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return map_arrow(whole.unionByName(mixed), f, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digest(docs: DataFrame) -> DataFrame:
    """Documents stored and read back."""
    return read_back(*store(docs))
