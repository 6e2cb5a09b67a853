"""The store: files as one immutable snapshot, updates as another, lookups over both."""

import logging

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import encode_payload, format_label
from strandlake.operators import lookup
from strandlake.operators.dedup import bloom, file_order, last_wins, latest, repeated_ids, write_keyed
from strandlake.operators.metrics import file_mb, payload_bytes, rates, timed, total_size
from strandlake.schema import FORMAT_CODES, FORMAT_NAMES, KEY_VALUE, RECORDS
from strandlake.sources.binary import SMRT_MAGIC, TRAC_MAGIC, TRAC_VERSION, scan_smrt, scan_trac, smrt_code, write_smrt, write_trac
from strandlake.sources.fasta import scan_fasta
from strandlake.sources.fastq import scan_fastq
from strandlake.sources.paths import file_size, files_of, first_bytes, first_line, scratch

log = logging.getLogger(__name__)

#: Ids, sequences and qualities of a snapshot that the driver may hold for lookups by single keys.
HELD_BYTES = 64 << 20
#: Files of a snapshot whose sizes are looked up for that.
MOST_FILES = 200


def load_scan(spark: SparkSession, path: str, mode: str = "validated") -> DataFrame | None:
    """Scan of a FASTA or FASTQ file by its first character; None for a file of no bytes.

    A blank first line raises ValueError, a missing file FileNotFoundError.
    """
    if (head := first_line(path)) is None:
        return None
    if not head:
        raise ValueError(f"{path} begins with a blank line")
    return scan_fastq(spark, path, mode) if head.startswith(b"@") else scan_fasta(spark, path)


class SequenceStore:
    """load() and restore() replace the snapshot that they fill and leave the other as it was."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.files = self._no_files()
        self.format = "DNA_FASTA"
        self._base: DataFrame | None = None
        self._fresh: dict[str, str] = {}
        self._held: dict[str, Row] | None = None
        self._held_of: DataFrame | None = None
        #: What the last load, save or restore did.
        self.summary: dict[str, object] = {}

    # loading and saving

    def load(self, path: str, mode: str = "validated") -> DataFrame:
        """Replaces the file snapshot; one row per id, the last in file order.

        The file is parsed once: the snapshot is a table that lookups read by id.
        """
        self.clear_file_cache()
        scan = load_scan(self.spark, path, mode)
        if scan is not None:
            (n, first), seconds = timed(lambda: self._hold(scan))
            self.format = first or "DNA_FASTA"
            self._said("loaded", path, self.format, n, seconds)
        return self.files

    def _hold(self, scan: DataFrame) -> tuple[int, str | None]:
        """Keeps a scan as the file snapshot; its number of rows and the kind of its first record."""
        table = write_keyed(scan, "id", scratch(self.spark, "scan"))
        twice = repeated_ids(table)
        rows = latest(table, twice)
        self.files = rows if twice is None else write_keyed(rows, "id", scratch(self.spark, "files"))
        place = table.agg(F.min(file_order()).alias("p")).first()["p"]
        kind = place and table.where((F.col("file") == place["file"]) & (F.col("block") == place["block"]) & (F.col("ord") == place["ord"])).select(format_label(F.col("sequence"), F.col("quality"))).first()[0]
        return self.files.count(), kind

    def _said(self, done: str, path: str, kind: str, n: int, seconds: float) -> None:
        """Keeps and logs the summary of an action: rows, MiB of its file, and rates."""
        size = sum(file_mb(f) for f in files_of(path))
        self.summary = {"action": done, "path": path, "format": kind, "rows": n, "mb": size, "seconds": seconds, **rates(n, size, seconds)}
        log.info("%s %s as %s: %d rows, %.1f MiB in %.2f s, %.1f MiB/s", done, path, kind, n, size, seconds, self.summary["mb_per_second"])

    load_smart_file = load

    def save(self, path: str) -> None:
        """Updates as TRAC if there are any, and then only they; else the files as SMRT; else nothing."""
        if self._has_pairs():
            _, seconds = timed(lambda: write_trac(self.pairs, path))
            self._said("saved", path, "TRAC", self.pairs.count(), seconds)
        elif not self.files.isEmpty():
            self.save_smart_binary(path)

    def save_smart_binary(self, path: str) -> None:
        """The file snapshot as SMRT, whatever the updates are."""
        _, seconds = timed(lambda: write_smrt(self.files, path, FORMAT_CODES[self.format]))
        self._said("saved", path, self.format, self.files.count(), seconds)

    def restore(self, path: str) -> None:
        """TRAC fills the updates, SMRT the files; another TRAC version changes nothing."""
        head = first_bytes(path, 5)
        if head[:4] != TRAC_MAGIC:
            self.load_smart_binary(path)
        elif len(head) < 5 or head[4] != TRAC_VERSION:
            log.warning("%s has an unknown version; nothing restored", path)
        else:
            rows = last_wins(scan_trac(self.spark, path).withColumn("_n", F.monotonically_increasing_id()), "key", F.col("_n")).drop("_n")
            base, seconds = timed(lambda: write_keyed(rows, "key", scratch(self.spark, "pairs")))
            self._fresh, self._base = {}, base
            self._said("restored", path, "TRAC", base.count(), seconds)

    def load_smart_binary(self, path: str) -> None:
        """Fills the file snapshot from SMRT."""
        self.clear_file_cache()
        if first_bytes(path, 4) != SMRT_MAGIC:
            raise ValueError(f"{path} is neither cache format")
        if (code := smrt_code(path)) not in FORMAT_NAMES:
            raise ValueError(f"{path} has the unknown format code {code}")
        scan = scan_smrt(self.spark, path)
        (n, _), seconds = timed(lambda: self._hold(scan))
        self.format = FORMAT_NAMES[code]
        self._said("restored", path, self.format, n, seconds)

    def save_native(self, folder: str) -> None:
        """Both snapshots as Parquet, sorted by key in each file, with bloom filters on the key."""
        for name, key, rows in (("files", "id", self.files), ("pairs", "key", self.pairs)):
            rows.sortWithinPartitions(key).write.mode("overwrite").options(**bloom(key)).parquet(f"{folder}/{name}")

    def restore_native(self, folder: str) -> None:
        """Both snapshots from Parquet; unlike the one-file formats, read in parallel and pruned by key."""
        self.files = self.spark.read.schema(RECORDS).parquet(f"{folder}/files")
        self._base, self._fresh = self.spark.read.schema(KEY_VALUE).parquet(f"{folder}/pairs"), {}

    def clear_file_cache(self) -> None:
        self.files = self._no_files()

    # updates

    def set(self, key: str, value: str) -> None:
        """Upserts one FASTA entry, replacing one of either kind."""
        self._fresh[key] = value

    def set_all(self, rows: DataFrame) -> None:
        """Upserts rows of key, value and version; the greatest version of a key stays."""
        new = last_wins(rows.select("key", "value", "version"), "key", F.col("version")).select("key", F.lit("FASTA").alias("kind"), encode_payload(F.col("value")).alias("data"), F.lit(None).cast("binary").alias("sequence"), F.lit(None).cast("binary").alias("quality"))
        self._base, self._fresh = self.pairs.join(new.select("key"), "key", "left_anti").unionByName(new), {}

    @property
    def pairs(self) -> DataFrame:
        """The updates in schema.KEY_VALUE."""
        fresh = self.spark.createDataFrame([(k, "FASTA", v.encode(), None, None) for k, v in self._fresh.items()], KEY_VALUE)
        if self._base is None:
            return fresh
        return self._base.join(fresh.select("key"), "key", "left_anti").unionByName(fresh) if self._fresh else self._base

    # lookups

    def _file(self, key: str):
        """The row of a key in the files, or None.

        Files of at most HELD_BYTES are kept in the driver from the first such
        lookup on; others are read with a filter that row groups are skipped by.
        """
        if self._held_of is not self.files:
            self._held_of, self._held = self.files, None
            if self._stored_bytes() <= HELD_BYTES and (payload_bytes(self.files).first()["total_bytes"] or 0) <= HELD_BYTES:
                columns = self.files.select("id", "sequence", "quality").toArrow().to_pydict()
                self._held = {i: Row(sequence=a, quality=b) for i, a, b in zip(columns["id"], columns["sequence"], columns["quality"], strict=True)}
        if self._held is not None:
            return self._held.get(key)
        return self.files.where(F.col("id") == key).select("sequence", "quality").first()

    def _stored_bytes(self) -> float:
        """Bytes of the files that hold the snapshot, as listed; more than any bound for very many of them."""
        files = self.files.inputFiles()
        return sum(file_size(f) for f in files) if len(files) <= MOST_FILES else float("inf")

    def _pair(self, key: str):
        """kind, data, sequence and quality (bytes) of a key among the updates, or None."""
        if key in self._fresh:
            return "FASTA", self._fresh[key].encode(), None, None
        found = self._base.where(F.col("key") == key).select("kind", "data", "sequence", "quality").first() if self._base is not None else None
        return found and tuple(found)

    def get(self, key: str) -> str:
        """A FASTA update, else the file's sequence, else the empty string."""
        if (held := self._pair(key)) and held[0] == "FASTA":
            return bytes(held[1] or b"").decode("utf-8", "replace")
        row = self._file(key)
        return row["sequence"] if row else ""

    def get_fastq_record(self, key: str):
        """A row of sequence and quality, or None."""
        if (held := self._pair(key)) and held[0] == "FASTQ":
            return Row(sequence=bytes(held[2] or b"").decode("utf-8", "replace"), quality=bytes(held[3] or b"").decode("utf-8", "replace"))
        return self._file(key)

    def get_all(self, keys: DataFrame) -> DataFrame:
        """get() for a table of keys."""
        return lookup.batch_get(keys, self.files, self.pairs)

    def get_all_records(self, keys: DataFrame) -> DataFrame:
        """get_fastq_record() for a table of keys."""
        return lookup.batch_get_record(keys, self.files, self.pairs)

    def get_sequence(self, key: str) -> str:
        """From the files only, empty on a miss."""
        row = self._file(key)
        return row["sequence"] if row else ""

    def get_quality(self, key: str) -> str:
        """From the files only, empty on a miss and for FASTA."""
        row = self._file(key)
        return row["quality"] if row else ""

    def has_sequence(self, key: str) -> bool:
        """The files hold the key."""
        return self._file(key) is not None

    # sizes

    def size(self) -> int:
        """Rows of both snapshots; a key in both counts twice."""
        return total_size(self.pairs, self.files).first()["total"]

    def file_cache_size(self) -> int:
        return self.files.count()

    def get_stored_size(self, key: str) -> int:
        """Payload bytes among the updates, else 0."""
        kind, *parts = self._pair(key) or ("FASTA", None, None, None)
        return sum(len(p or b"") for p in (parts[1:] if kind == "FASTQ" else parts[:1]))

    def detected_format(self) -> str:
        """Kind of the last load's first record; DNA_FASTA before any."""
        return self.format

    def _has_pairs(self) -> bool:
        return bool(self._fresh) or self._base is not None and not self._base.isEmpty()

    def _no_files(self) -> DataFrame:
        return self.spark.createDataFrame([], RECORDS)


__all__ = ["SequenceStore", "file_size", "load_scan"]
