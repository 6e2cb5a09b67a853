"""Sizes, rates and ratios of stores."""

from collections.abc import Callable
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import size_reduction_pct
from strandlake.sources.paths import file_size

MIB = 1024 * 1024


def payload_bytes(records: DataFrame) -> DataFrame:
    """rows, total_bytes and bytes_per_row of a table of records."""
    n = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in records.columns), F.lit(0).cast("bigint"))
    return records.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(n), F.lit(0)).alias("total_bytes")).select(
        "n_rows", "total_bytes", F.when(F.col("n_rows") > 0, F.col("total_bytes") / F.col("n_rows")).alias("bytes_per_row")
    )


def size_report(original: Column, stored: Column) -> list[Column]:
    """original_mb, stored_mb, reduction_pct, size_ratio."""
    return [
        (original / MIB).alias("original_mb"),
        (stored / MIB).alias("stored_mb"),
        size_reduction_pct(original, stored).alias("reduction_pct"),
        F.when(original != 0, stored / original).alias("size_ratio"),
    ]


def total_size(*stores: DataFrame) -> DataFrame:
    """total: rows of all stores; a key in two of them counts twice."""
    out = stores[0].select(F.lit(1).alias("one"))
    for s in stores[1:]:
        out = out.unionAll(s.select(F.lit(1).alias("one")))
    return out.agg(F.count("one").alias("total"))


def integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_before, n_after and same: equal counts and an equal sum of row hashes, whatever the order."""
    mark = lambda d, n: d.agg(F.count(F.lit(1)).alias(n), F.coalesce(F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)")), F.lit(0)).alias(f"{n}_hash"))
    both = mark(before, "n_before").join(mark(after.select(before.columns), "n_after"))  # one row each
    return both.select("n_before", "n_after", ((F.col("n_before") == F.col("n_after")) & (F.col("n_before_hash") == F.col("n_after_hash"))).alias("same"))


def recommendation(reduction_pct: Column, restore_speedup: Column) -> Column:
    """Wording for how well a cache pays; thresholds 50 and 30 percent and a speedup of 5."""
    size = F.when(reduction_pct > 50, "high reduction").when(reduction_pct > 30, "medium reduction").otherwise("low reduction")
    return F.concat_ws("; ", size, F.when(restore_speedup > 5, "fast restore").otherwise("slow restore"))


def file_mb(path: str) -> float:
    """MiB of a file, 0 where there is none."""
    try:
        return file_size(path) / MIB
    except FileNotFoundError:
        return 0.0


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """An action's result and seconds."""
    began = perf_counter()
    out = action()
    return out, perf_counter() - began


def rates(items: int, megabytes: float, seconds: float) -> dict[str, float]:
    """Throughput of a timed action."""
    s = max(seconds, 1e-9)
    return {"per_second": items / s, "mb_per_second": megabytes / s, "mean_us": s * 1e6 / max(items, 1)}


def break_even(load_ms: Column) -> Column:
    """Lookups after which a cache has paid for its load, at a tenth of a second each."""
    return F.floor(load_ms / 100).cast("bigint")


def report(load: dict, save: dict, restore: dict) -> dict[str, float | str]:
    """Sizes, rates and advice from the summaries of a load, a save and a restore."""
    original, stored, speedup = load["mb"], save["mb"], load["seconds"] / max(restore["seconds"], 1e-9)
    saved = (original - stored) / original * 100 if original else 0.0
    return {
        "rows": restore["rows"], "original_mb": original, "stored_mb": stored, "size_ratio": stored / original if original else 0.0, "reduction_pct": saved,
        "load_mb_per_second": load["mb_per_second"], "save_mb_per_second": save["mb_per_second"], "restore_mb_per_second": restore["mb_per_second"],
        "restore_speedup": speedup, "break_even_lookups": int(load["seconds"] * 10),
    }
