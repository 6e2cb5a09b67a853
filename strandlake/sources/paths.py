"""Storage access that does not assume a local disk."""

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it; any scheme that Arrow knows, plain paths are local."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def file_size(path: str) -> int:
    """Bytes of a file; FileNotFoundError where there is none."""
    fs, inner = open_store(path)
    info = fs.get_file_info(inner)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def files_of(path: str) -> list[str]:
    """The file itself, or a folder's files by name without hidden ones."""
    fs, inner = open_store(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def first_bytes(path: str, n: int) -> bytes:
    """The first n bytes, as stored."""
    fs, inner = open_store(path)
    with fs.open_input_stream(inner, compression=None) as f:
        return f.read(n)


def first_line(path: str) -> bytes | None:
    """First line without its end, inflated for names in .gz; None for a file of no bytes."""
    if file_size(path) == 0:
        return None
    fs, inner = open_store(path)
    got = b""
    with fs.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None) as f:
        while b"\n" not in got and (more := f.read(65536)):
            got += more
    return got.split(b"\n", 1)[0].rstrip(b"\r\n")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share; gone when the driver ends.

    An unset spark.checkpoint.dir is set here for a local master; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    run = f"{base.rstrip('/')}/run-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        path, fs = _hadoop(spark, run)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _RUNS.add(run)
    return run


_RUNS: set[str] = set()


def _hadoop(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, at: str) -> None:
    """Removes a file or folder of any store that Spark knows."""
    path, fs = _hadoop(spark, at)
    fs.delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
