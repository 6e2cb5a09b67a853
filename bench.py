"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and rates over larger files that it makes; prints one JSON line.

queries has seconds of each query, run once before it is timed. rates has MB
of input a second, or lookups a second, over one file, a folder and a gzip file
of $BENCH_MB each (512, the gzip file half of that before it is packed), for a whole load or restore of
the store.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINES = [
    "fasta_scan", "fasta_multiline_scan", "fastq_scan", "smrt_roundtrip", "trac_roundtrip", "integrity_check",
    "classify_sequences", "batch_get", "overlay_get", "fastq_record_lookup", "get_quality", "has_key",
    "upsert_last_wins", "total_size", "stored_size", "smrt_bytes",
]
LENGTH = 1000


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def seconds(action) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def rates(spark: SparkSession, megabytes: int, cpus: int) -> dict[str, float]:
    """Loads, restores and lookups over files of so many MB."""
    from strandlake import SequenceStore
    from strandlake.functions import synthetic_dna
    from strandlake.sources import sinks
    from strandlake.sources.fasta import scan_fasta
    from strandlake.sources.fastq import scan_fastq
    from strandlake.sources.paths import delete, file_size, files_of, scratch

    key, sequence = F.col("id").cast("string"), synthetic_dna(F.col("id").cast("string"), LENGTH)
    size = lambda at: sum(file_size(f) for f in files_of(at)) / 1e6
    out: dict[str, float] = {}

    def made(name: str, mb: int, parts: int, text, **how) -> tuple[str, float]:
        at, n = scratch(spark, f"bench-{name}"), mb * 1_000_000 // (LENGTH if name.startswith("fasta") else 2 * LENGTH)
        sinks.write_text(spark.range(0, n, 1, cpus).coalesce(parts).select(text.alias("r")), "r", at, **how)
        return files_of(at)[0] if parts == 1 else at, size(at)

    fasta, fastq = sinks.fasta_text(F.concat(F.lit("chr"), key), sequence, " made", 60), sinks.fastq_text(F.concat(F.lit("chr"), key), sequence, sequence, " made")
    one, mb = made("fasta", megabytes, 1, fasta)
    folder, folder_mb = made("fasta-folder", megabytes, cpus, fasta)
    packed, _ = made("fasta-gz", megabytes // 2, 1, fasta, gzip=True)
    reads, reads_mb = made("fastq", megabytes, 1, fastq)

    out["fasta_scan_mb_s"] = mb / seconds(lambda: drain(scan_fasta(spark, one)))
    out["fasta_folder_scan_mb_s"] = folder_mb / seconds(lambda: drain(scan_fasta(spark, folder)))
    out["fastq_scan_mb_s"] = reads_mb / seconds(lambda: drain(scan_fastq(spark, reads)))
    store = SequenceStore(spark)
    out["fastq_load_mb_s"] = reads_mb / seconds(lambda: store.load(reads))
    out["fasta_gzip_load_mb_s"] = size(packed) / seconds(lambda: store.load(packed))  # packed MB
    out["fasta_load_mb_s"] = mb / seconds(lambda: store.load(one))
    native, smrt = scratch(spark, "bench-native"), scratch(spark, "bench-smrt") + ".bin"
    out["native_save_mb_s"] = mb / seconds(lambda: store.save_native(native))
    out["smrt_save_mb_s"] = mb / seconds(lambda: store.save_smart_binary(smrt))
    back = SequenceStore(spark)
    out["smrt_restore_mb_s"] = mb / seconds(lambda: back.restore(smrt))
    out["native_restore_mb_s"] = mb / seconds(lambda: (back.restore_native(native), drain(back.files)))
    n = store.file_cache_size()
    store.get("chr0")
    out["point_lookups_s"] = 20 / seconds(lambda: [store.get(f"chr{k * 997 % n}") for k in range(20)])
    small = SequenceStore(spark)
    small.load(made("fasta-small", 32, 1, fasta)[0])
    small.get("chr0")
    out["held_lookups_s"] = 200_000 / seconds(lambda: [small.get(f"chr{k * 997 % 32_000}") for k in range(200_000)])
    keys = spark.range(2_000_000).select(F.concat(F.lit("chr"), (F.col("id") % n).cast("string")).alias("key"))
    out["batch_lookups_s"] = 2_000_000 / seconds(lambda: drain(store.get_all(keys)))
    for at in (one, folder, packed, reads, native, smrt):
        delete(spark, at)
    return {k: round(v, 1) for k, v in out.items()}


def main() -> None:
    from strandlake.plans.queries import QUERIES

    at, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR")
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .getOrCreate()
    )
    took = {}
    for name in HEADLINES:
        drain(QUERIES[name](spark, at))
        took[name] = round(seconds(lambda name=name: drain(QUERIES[name](spark, at))), 3)
    found = rates(spark, int(os.environ.get("BENCH_MB", "512")), int(cpus))
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": found, "sf": os.path.basename(at.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
