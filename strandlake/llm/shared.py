"""Storage, joins and Arrow plumbing that the operators share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.sources import paths

#: Rows of a side that may be broadcast, and their measured bytes together.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share, with Spark's checkpoints in it too."""
    at = paths.shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


_MADE: list[str] = []


def written(frame: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, no lineage, safe from lost executors.

    The table goes with the application's folder when the driver ends, or with written_alone().
    """
    at = paths.scratch(frame.sparkSession, name)
    _MADE.append(at)
    frame.write.option("compression", codec).parquet(at)
    return frame.sparkSession.read.schema(frame.schema).parquet(at)


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives as a written table; the tables that were written on the way to it are removed."""
    before = len(_MADE)
    out = written(make(), name)
    for at in _MADE[before:-1]:
        paths.delete(out.sparkSession, at)
    del _MADE[before:]
    return out


def row_bytes(x: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory: texts and lists by their real length."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(x), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((row_bytes(x[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        own = F.aggregate(x, F.lit(16).cast("long"), lambda n, y: n + row_bytes(y, kind.elementType))
        return F.coalesce(own, F.lit(16).cast("long"))
    return F.lit(16 if isinstance(kind, T.DecimalType) else 8).cast("long")


def small_enough(frame: DataFrame) -> bool:
    """The frame has few enough rows and bytes to broadcast; rows of a written table are counted from its footers, bytes measured only below the bound."""
    if frame.count() > BROADCAST_ROWS:
        return False
    taken = sum((row_bytes(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema.fields), F.lit(16).cast("long"))
    return (frame.agg(F.sum(taken)).first()[0] or 0) <= BROADCAST_BYTES


def join_checked(big: DataFrame, side: DataFrame, on: list[str] | str, how: str, payload: bool = False) -> DataFrame:
    """A join that broadcasts side only if it was measured and is small; else a sort-merge join.

    side should be a written table: then both sides are shuffled as they are,
    with no aggregate in the join's stage, and adaptive execution can split the
    partition of a key with very many rows. A side with payloads is never
    broadcast. Nulls match nulls.
    """
    on = [on] if isinstance(on, str) else on
    side = side.hint("shuffle_merge") if payload or not small_enough(side) else F.broadcast(side)
    keys = [f"__side_key_{k}" for k in range(len(on))]
    side = side.withColumnsRenamed(dict(zip(on, keys, strict=True)))
    cond = F.lit(True)
    for a, b in zip(on, keys, strict=True):
        cond = cond & big[a].eqNullSafe(side[b])
    return big.join(side, cond, how).drop(*keys)


def map_arrow(frame: DataFrame, f: Callable[[pa.RecordBatch], "pa.RecordBatch | pa.Table | None"], schema) -> DataFrame:
    """f over each Arrow batch; what it returns is cut into batches of bounded size.

    A worker gives memory back after each partition, as it waits for others with what it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                out = f(part)
                if out is not None and out.num_rows:
                    yield from out.to_batches(max_chunksize=20_000) if isinstance(out, pa.Table) else [out]
                del out
        give_back()

    return frame.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of at most so many bytes, single larger rows by themselves."""
    if batch.nbytes <= most or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """What tells the rows of one doc_id apart: half a SHA-256 of the text, a null one being empty."""
    return F.substring(F.unhex(F.sha2(text_or_empty(column), 256)), 1, 16)
