"""The two length-prefixed cache formats as Spark sources and sinks.

Both are little-endian: a four-byte magic, one byte, a 64-bit row count, then
rows of 32-bit lengths and raw bytes. A row count in front and rows without
marks mean one task a file; the store's own Parquet form has no such bound.
"""

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandlake.schema import FORMAT_NAMES, KEY_VALUE, SCAN
from strandlake.sources.paths import files_of, open_store

# Fixed values of the formats.
SMRT_MAGIC, TRAC_MAGIC, TRAC_VERSION = b"SMRT", b"TRAC", 2
FASTA_ROW, FASTQ_ROW = 0, 1
BATCH, BLOCK = 4096, 4 << 20
LIMIT = 2**32 - 1


class CacheFile(InputPartition):
    def __init__(self, file: str):
        self.file = file


class _Cursor:
    """Sequential exact reads from blocks; a short one means a cut-off file."""

    def __init__(self, path: str):
        fs, inner = open_store(path)
        self.path, self.f, self.held, self.at = path, fs.open_input_stream(inner, compression=None), b"", 0

    def take(self, n: int) -> bytes:
        end = self.at + n
        if end > len(self.held):
            parts = [self.held[self.at :]]
            left = n - len(parts[0])
            while left > 0 and (more := self.f.read(max(left, BLOCK))):
                parts.append(more)
                left -= len(more)
            if left > 0:
                raise ValueError(f"{self.path} ends inside a record")
            self.held, self.at, end = b"".join(parts), 0, n
        out = self.held[self.at : end]
        self.at = end
        return out

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def sized(self) -> bytes:
        return self.take(self.number(4))


def smrt_rows(path: str) -> Iterator[tuple]:
    at = _Cursor(path)
    if at.take(4) != SMRT_MAGIC:
        raise ValueError(f"{path} is no SMRT file")
    if (code := at.number(1)) not in FORMAT_NAMES:
        raise ValueError(f"{path} has the unknown format code {code}")
    for k in range(at.number(8)):
        name, sequence, quality = (at.sized().decode("utf-8", "replace") for _ in range(3))
        yield name, sequence, quality, path, 0, k


def trac_rows(path: str) -> Iterator[tuple]:
    at = _Cursor(path)
    if at.take(4) != TRAC_MAGIC:
        raise ValueError(f"{path} is no TRAC file")
    if at.number(1) != TRAC_VERSION:
        return
    for _ in range(at.number(8)):
        key = at.sized().decode("utf-8", "replace")
        kind = at.number(1)
        if kind == FASTA_ROW:
            yield key, "FASTA", at.sized(), None, None
        elif kind == FASTQ_ROW:
            yield key, "FASTQ", None, at.sized(), at.sized()
        else:
            raise ValueError(f"{path} has the unknown record type {kind}")


def smrt_code(path: str) -> int:
    """The file-kind code in the header."""
    at = _Cursor(path)
    at.take(4)
    return at.number(1)


class CacheReader(DataSourceReader):
    def __init__(self, path: str, rows, arrow: pa.Schema):
        self.path, self.rows, self.arrow = path, rows, arrow

    def partitions(self):
        return [CacheFile(f) for f in files_of(self.path)]

    def read(self, part):
        held: list[tuple] = []
        size = 0
        for row in self.rows(part.file):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(held) == BATCH or size > 32 << 20:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.arrow.types, strict=True)], schema=self.arrow)


def _sized(data: bytes) -> bytes:
    if len(data) > LIMIT:
        raise ValueError("a value is too long for a 32-bit length")
    return struct.pack("<I", len(data)) + data


class Written(WriterCommitMessage):
    def __init__(self, rows: int):
        self.rows = rows


class CacheWriter(DataSourceWriter):
    def __init__(self, options: dict, head: bytes, body):
        self.path, self.count, self.head, self.body = options["path"], int(options["count"]), head, body

    def write(self, iterator):
        fs, inner = open_store(self.path)
        n = 0
        with fs.open_output_stream(inner, compression=None, buffer_size=1 << 20) as out:
            out.write(self.head + struct.pack("<Q", self.count))
            for row in iterator:
                out.write(self.body(row))
                n += 1
        return Written(n)

    def commit(self, messages):
        if (n := sum(m.rows for m in messages if m is not None)) != self.count:
            raise ValueError(f"{self.path} announces {self.count} rows and has {n}")

    def abort(self, messages):
        pass


def smrt_body(row) -> bytes:
    return b"".join(_sized((x or "").encode()) for x in (row["id"], row["sequence"], row["quality"]))


def trac_body(row) -> bytes:
    key = _sized((row["key"] or "").encode())
    if row["kind"] == "FASTQ":
        return key + bytes([FASTQ_ROW]) + _sized(bytes(row["sequence"] or b"")) + _sized(bytes(row["quality"] or b""))
    return key + bytes([FASTA_ROW]) + _sized(bytes(row["data"] or b""))


SMRT_ARROW = pa.schema([("id", pa.string()), ("sequence", pa.string()), ("quality", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("ord", pa.int64())])
TRAC_ARROW = pa.schema([("key", pa.string()), ("kind", pa.string()), ("data", pa.binary()), ("sequence", pa.binary()), ("quality", pa.binary())])


class SmrtSource(DataSource):
    @classmethod
    def name(cls):
        return "smrt"

    def schema(self):
        return SCAN

    def reader(self, schema):
        return CacheReader(self.options["path"], smrt_rows, SMRT_ARROW)

    def writer(self, schema, overwrite):
        return CacheWriter(self.options, SMRT_MAGIC + struct.pack("<B", int(self.options.get("code", 0))), smrt_body)


class TracSource(DataSource):
    @classmethod
    def name(cls):
        return "trac"

    def schema(self):
        return KEY_VALUE

    def reader(self, schema):
        return CacheReader(self.options["path"], trac_rows, TRAC_ARROW)

    def writer(self, schema, overwrite):
        return CacheWriter(self.options, TRAC_MAGIC + struct.pack("<B", TRAC_VERSION), trac_body)


def _write(frame: DataFrame, form: str, path: str, **options) -> None:
    from strandlake.sources.register import register

    register(frame.sparkSession)
    n = frame.count()
    frame.coalesce(1).write.format(form).options(count=n, **options).mode("append").save(path)


def write_smrt(records: DataFrame, path: str, code: int = 0) -> None:
    """id, sequence, quality to one SMRT file; code is the file kind."""
    _write(records.select("id", "sequence", "quality"), "smrt", path, code=code)


def write_trac(pairs: DataFrame, path: str) -> None:
    """key, kind, data, sequence, quality to one TRAC file."""
    _write(pairs.select("key", "kind", "data", "sequence", "quality"), "trac", path)


def scan_smrt(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a SMRT file in schema.SCAN; a bad magic, code or length raises."""
    from strandlake.sources.register import register

    register(spark)
    return spark.read.format("smrt").load(path)


def scan_trac(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a TRAC file in schema.KEY_VALUE; none for other versions."""
    from strandlake.sources.register import register

    register(spark)
    return spark.read.format("trac").load(path)


def smrt_size(records: DataFrame) -> DataFrame:
    """total_bytes that a SMRT file of these rows has."""
    n = sum((F.octet_length(F.coalesce(c, F.lit(""))).cast("bigint") for c in ("id", "sequence", "quality")), F.lit(12).cast("bigint"))
    return records.agg((F.lit(13).cast("bigint") + F.coalesce(F.sum(n), F.lit(0))).alias("total_bytes"))


def trac_size(pairs: DataFrame) -> DataFrame:
    """total_bytes that a TRAC file of these rows has."""
    of = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    n = of("key") + F.when(F.col("kind") == "FASTQ", of("sequence") + of("quality") + 13).otherwise(of("data") + 9)
    return pairs.agg((F.lit(13).cast("bigint") + F.coalesce(F.sum(n), F.lit(0))).alias("total_bytes"))
