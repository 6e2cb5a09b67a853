"""Files that arrive over time; ours, there is no such feature to match."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import header_id, join_sequence_lines, strip_line_end


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """id and sequence of FASTA files as they land in a folder; files must begin with a record."""
    text = F.regexp_replace(F.col("value"), "^>", "")
    head = F.substring_index(text, "\n", 1)
    return (
        spark.readStream.option("lineSep", "\n>").text(folder)
        .select(header_id(strip_line_end(head)).alias("id"), join_sequence_lines(F.substring(text, F.length(head) + 2, F.lit(2**31 - 1))).alias("sequence"))
        .where("id <> ''")
    )
