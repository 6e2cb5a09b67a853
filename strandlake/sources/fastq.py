"""FASTQ source: byte ranges that find record starts by themselves."""

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from strandlake.schema import SCAN
from strandlake.sources.paths import file_size, files_of, open_store

#: Rows and bytes of a batch that goes back to the engine; bytes of a read.
BATCH, BATCH_BYTES = 8192, 8 << 20
BLOCK = 4 << 20
ARROW = pa.schema([("id", pa.string()), ("sequence", pa.string()), ("quality", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("ord", pa.int64())])


class Piece(InputPartition):
    def __init__(self, file: str, start: int, end: int | None):
        self.file, self.start, self.end = file, start, end


def lines_from(path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each line from a byte on, without line ends; only inflated for names in .gz.

    A gzip file that ends inside a member raises.
    """
    fs, inner = open_store(path)
    inflate = zlib.decompressobj(31) if path.endswith(".gz") else None
    at, rest, inside = start, b"", False
    with fs.open_input_file(inner) as f:
        f.seek(start)
        while raw := f.read(BLOCK):
            if inflate is None:
                rest += raw
            else:
                while raw:
                    rest += inflate.decompress(raw)
                    raw, inside = inflate.unused_data, not inflate.eof
                    if inflate.eof:
                        inflate = zlib.decompressobj(31)  # a file may be several gzip members
            *whole, rest = rest.split(b"\n")
            for line in whole:
                yield at, line.rstrip(b"\r")
                at += len(line) + 1
    if inside:
        raise ValueError(f"{path} ends inside a gzip member")
    if rest:
        yield at, rest.rstrip(b"\r")


def records_between(lines: Iterator[tuple[int, bytes]], start: int, end: int | None, strict: bool) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Records that begin in [start, end): offset, header, sequence, quality.

    A record is an @ line and three more; strict asks for a plus at the third
    and otherwise goes on with the line after the @ line. A range that begins
    inside a file thereby finds the next record, since a quality line that
    looks like a header has a sequence two lines on.
    """
    ahead: list[tuple[int, bytes]] = []
    while True:
        while len(ahead) < 4 and (one := next(lines, None)) is not None:
            ahead.append(one)
        if not ahead or end is not None and ahead[0][0] >= end:
            return
        at, head = ahead[0]
        if not head.startswith(b"@"):
            del ahead[0]
        elif len(ahead) < 4:
            if not strict:
                return
            del ahead[0]
        elif strict and not ahead[2][1].startswith(b"+"):
            del ahead[0]
        else:
            yield at, head, ahead[1][1], ahead[3][1]
            ahead.clear()


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.strict = options.get("mode", "validated") != "lenient"
        self.split = int(options.get("splitbytes", 64 << 20))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters):
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == ("id",):
                self.wanted = {one.value} if self.wanted is None else self.wanted & {one.value}
            elif isinstance(one, In) and one.attribute == ("id",):
                self.wanted = set(one.value) if self.wanted is None else self.wanted & set(one.value)
            yield one

    def partitions(self):
        out = []
        for f in files_of(self.path):
            n = file_size(f)
            if f.endswith(".gz") or not self.strict:
                out.append(Piece(f, 0, None))
            else:
                out += [Piece(f, s, min(s + self.split, n)) for s in range(0, n, self.split)]
        return out or [Piece(self.path, 0, 0)]

    def read(self, piece):
        if piece.end == 0:
            return
        lines = lines_from(piece.file, max(0, piece.start - 1))
        if piece.start:
            next(lines, None)  # the rest of a line that an earlier range has, or just its end
        rows: list[tuple] = []
        size = 0
        for at, head, sequence, quality in records_between(lines, piece.start, piece.end, self.strict):
            name = head[1:].split(b" ", 1)[0].decode("utf-8", "replace")
            if self.wanted is None or name in self.wanted:
                rows.append((name, sequence.decode("utf-8", "replace"), quality.decode("utf-8", "replace"), piece.file, piece.start, at))
                size += len(sequence) + len(quality)
            if len(rows) >= BATCH or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCAN

    def reader(self, schema):
        return FastqReader(self.options)


def scan_fastq(spark: SparkSession, path: str, mode: str = "validated", split_bytes: int = 64 << 20) -> DataFrame:
    """Every record of a file or folder with its place, in schema.SCAN.

    mode validated takes only records whose third line begins with a plus and
    reads byte ranges in parallel; lenient takes any three lines after an @
    line, which only one pass in file order can do. Lengths of sequence and
    quality may differ. Gzip files are one range each.
    """
    from strandlake.sources.register import register

    register(spark)
    return spark.read.format("fastq").options(mode=mode, splitbytes=split_bytes).load(path)
