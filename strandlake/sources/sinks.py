"""Text renderings of records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_text(name: Column, sequence: Column, note: str = "", wrap: int = 0, end: str = "\n") -> Column:
    """One record as lines; wrap cuts the sequence into lines of so many characters."""
    body = F.regexp_replace(sequence, f"(.{{{wrap}}})(?=.)", f"$1{end}") if wrap else sequence
    return F.concat(F.lit(">"), name, F.lit(note + end), body)


def fastq_text(name: Column, sequence: Column, quality: Column, note: str = "", end: str = "\n") -> Column:
    """One record as its four lines, the third a bare plus."""
    return F.concat(F.lit("@"), name, F.lit(note + end), sequence, F.lit(f"{end}+{end}"), quality)


def write_text(rows: DataFrame, column: str, path: str, gzip: bool = False, end: str = "\n") -> None:
    """One column as text files; end closes each row."""
    rows.select(column).write.mode("overwrite").options(lineSep=end, compression="gzip" if gzip else "none").text(path)
