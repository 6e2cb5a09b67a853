"""One row per key, the last in input order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.sources.paths import scratch


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The row with the greatest order for each key; partial results are made before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def first_match(rows: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """For each key the value met first in input order, as a scan that stops at a hit would give."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def file_order() -> Column:
    """Sorts scanned records as they stand in their files, splits included."""
    return F.struct("file", "block", "ord")


def bloom(key: str) -> dict[str, str]:
    """Writer options for bloom filters on a key, as large as each row group needs."""
    return {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def write_keyed(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The rows as Parquet with bloom filters on the key, so that a lookup skips row groups without it."""
    rows.write.option("compression", "lz4").options(**bloom(key)).parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def repeated_ids(table: DataFrame) -> DataFrame | None:
    """Ids that a table has more than once; None without such ids."""
    twice = table.groupBy("id").count().where("count > 1").select("id")
    twice = write_keyed(twice, "id", scratch(table.sparkSession, "twice"))
    return None if twice.isEmpty() else twice


def latest(table: DataFrame, twice: DataFrame | None) -> DataFrame:
    """id, sequence and quality of a stored scan, the last record of each id in twice."""
    rows = table.select("id", "sequence", "quality")
    if twice is None:
        return rows
    last = last_wins(table.join(twice, "id", "left_semi"), "id", file_order())
    return rows.join(twice, "id", "left_anti").unionAll(last.select(rows.columns))


def dedup_scan(scan: DataFrame) -> DataFrame:
    """id, sequence and quality of a scan; the last record of an id stays.

    The scan is parsed once, into a table. Only ids are grouped, and only
    records of ids that occur twice are compared: sequences of others are never
    shuffled. Without such ids the table is the result.
    """
    table = write_keyed(scan, "id", scratch(scan.sparkSession, "scan"))
    return latest(table, repeated_ids(table))
