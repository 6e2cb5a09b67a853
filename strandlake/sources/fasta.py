"""FASTA scan: the text source splits files at record starts, each split is parsed where it is read."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.schema import SCAN

#: Rows and bytes of a batch that goes back to the engine.
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20


def scan_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every record of one or more files with its place, in schema.SCAN.

    A record separator of newline and marker lets Spark cut plain files into
    splits that resynchronise at record starts. The first piece of each file
    still has its marker, or is text before the first record, which is left
    out; it is the first that a task sees of a file's block 0, so that neither
    a second scan nor a shuffle is needed. Records without an id are left out;
    an id may come more than once. Gzip files by their suffix are one split each.
    """
    pieces = spark.read.option("lineSep", "\n>").text([path] if isinstance(path, str) else list(path))
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return pieces.mapInArrow(_parser(BATCH_ROWS, BATCH_BYTES), SCAN)


def _parser(most_rows: int, most_bytes: int):
    """What turns pieces into records; it travels to the workers by itself, without this package."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def text(values: list[bytes]) -> pa.Array:
            raw = pa.array(values, pa.binary())
            try:
                return raw.cast(pa.string())
            except pa.ArrowInvalid:
                return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            names, sequences, files, blocks, places = zip(*rows, strict=True)
            columns = [text(names), text(sequences), pa.array([""] * len(rows)), pa.array(files), pa.array(blocks, pa.int64()), pa.array(places, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["id", "sequence", "quality", "file", "block", "ord"])

        now, place, rows, size = None, 0, [], 0
        for b in batches:
            for piece, file, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                place += 1
                if block == 0 and file != now:
                    now = file
                    if not piece.startswith(b">"):
                        continue
                    piece = piece[1:]
                head, _, body = piece.partition(b"\n")
                name = head.rstrip(b"\r").split(b" ", 1)[0]
                if not name:
                    continue
                body = b"".join([line.rstrip(b"\r") for line in body.split(b"\n")]) if b"\r" in body else body.replace(b"\n", b"")
                rows.append((name, body, file, block, place))
                size += len(body)
                if len(rows) >= most_rows or size >= most_bytes:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return parse
