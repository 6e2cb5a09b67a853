"""Batch lookups: joins of a key table with the stores.

No broadcast is asked for: sequences are wide, and adaptive execution turns a
join into a broadcast once it has measured a side as small, or splits skewed
partitions where it has not.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import decode_payload
from strandlake.operators.dedup import file_order


def _files(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("key"), F.col("sequence").alias("_f_sequence"), F.col("quality").alias("_f_quality"), F.lit(True).alias("_in_file"))


def _overlay(keys: DataFrame, pairs: DataFrame | None, records: DataFrame) -> DataFrame:
    out = keys.join(_files(records), "key", "left")
    if pairs is None:
        none = F.lit(None)
        return out.withColumns({"_kind": none.cast("string"), "_data": none.cast("binary"), "_k_sequence": none.cast("binary"), "_k_quality": none.cast("binary")})
    held = pairs.select("key", F.col("kind").alias("_kind"), F.col("data").alias("_data"), F.col("sequence").alias("_k_sequence"), F.col("quality").alias("_k_quality"))
    return out.join(held, "key", "left")


def batch_get(keys: DataFrame, records: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """keys plus value: a FASTA entry of pairs, else the file's sequence, else the empty string.

    An entry of kind FASTQ is passed over, as if the key were absent.
    """
    out = _overlay(keys, pairs, records)
    value = F.coalesce(F.when(F.col("_kind") == "FASTA", decode_payload(F.col("_data"))), F.col("_f_sequence"), F.lit(""))
    return out.select(*keys.columns, value.alias("value"))


def batch_get_record(keys: DataFrame, records: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """keys plus record, a struct of sequence and quality.

    A FASTQ entry of pairs comes first, then a row of the files, whose quality
    is empty for FASTA; null where neither has the key.
    """
    out = _overlay(keys, pairs, records)
    held = F.struct(decode_payload(F.col("_k_sequence")).alias("sequence"), decode_payload(F.col("_k_quality")).alias("quality"))
    filed = F.struct(F.coalesce("_f_sequence", F.lit("")).alias("sequence"), F.coalesce("_f_quality", F.lit("")).alias("quality"))
    return out.select(*keys.columns, F.when(F.col("_kind") == "FASTQ", held).when(F.col("_in_file"), filed).alias("record"))


def batch_project(keys: DataFrame, records: DataFrame, column: str) -> DataFrame:
    """keys plus value: sequence or quality of the files, empty on a miss."""
    out = keys.join(records.select(F.col("id").alias("key"), F.col(column).alias("_v")), "key", "left")
    return out.select(*keys.columns, F.coalesce("_v", F.lit("")).alias("value"))


def batch_has(keys: DataFrame, records: DataFrame) -> DataFrame:
    """The keys that the files hold."""
    return keys.join(records.select(F.col("id").alias("key")), "key", "left_semi")


def batch_stored_size(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """keys plus stored_size: payload bytes in pairs; 0 for keys that only files hold or nothing does."""
    of = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    n = F.when(F.col("kind") == "FASTQ", of("sequence") + of("quality")).otherwise(of("data"))
    out = keys.join(pairs.select("key", n.alias("_n")), "key", "left")
    return out.select(*keys.columns, F.coalesce("_n", F.lit(0).cast("bigint")).alias("stored_size"))


def first_in_file(scan: DataFrame, key: str) -> DataFrame:
    """id and sequence of the first record of a key in file order, or no row; the lookup is made at the call.

    Tasks take the splits of one file in order, so they are read in that order
    and no more of them once one has the key. A limit inside of a larger plan
    would not do: it takes whichever split's row a shuffle brings first. Several
    files are dealt to tasks by size: there all are read, and the least place stays.
    """
    hits = scan.where(F.col("id") == key)
    if len(scan.inputFiles()) != 1:
        hits = hits.orderBy(file_order())
    return scan.sparkSession.createDataFrame(hits.select("id", "sequence").take(1), "id string, sequence string")
