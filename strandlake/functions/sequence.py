"""Header, residue and naming functions over string columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.schema import FORMAT_CODES


def header_id(header: Column) -> Column:
    """Record id of a header line without its marker: all before the first space (a tab does not end it)."""
    return F.substring_index(header, " ", 1)


def strip_line_end(line: Column) -> Column:
    """The line without any trailing carriage returns and line feeds."""
    return F.regexp_replace(line, r"[\r\n]+$", "")


def join_sequence_lines(body: Column) -> Column:
    """Body lines joined with nothing; a carriage return inside a line is content and stays."""
    return F.regexp_replace(body, r"\r*\n|\r+$", "")


def is_nucleotide(sequence: Column) -> Column:
    """Over 80 % of the ASCII letters are among A, T, G, C, U and N; false without letters."""
    letters = F.length(F.regexp_replace(sequence, "[^A-Za-z]", ""))
    bases = F.length(F.regexp_replace(sequence, "[^ATGCUNatgcun]", ""))
    return F.coalesce((letters > 0) & (bases / letters > 0.8), F.lit(False))


def has_rna(sequence: Column) -> Column:
    """A u in either case occurs."""
    return F.coalesce(F.contains(F.upper(sequence), F.lit("U")), F.lit(False))


def residue_kind(sequence: Column) -> Column:
    """RNA, DNA or PROTEIN; the RNA test comes first, so a protein with a u is RNA."""
    return F.when(has_rna(sequence), "RNA").when(is_nucleotide(sequence), "DNA").otherwise("PROTEIN")


def format_label(sequence: Column, quality: Column) -> Column:
    """The file kind that a record with this content stands for."""
    return F.concat_ws("_", residue_kind(sequence), F.when(F.coalesce(quality, F.lit("")) != "", "FASTQ").otherwise("FASTA"))


def format_code(sequence: Column, quality: Column) -> Column:
    """format_label() as its number."""
    label = format_label(sequence, quality)
    code = F.lit(None).cast("int")
    for name, number in FORMAT_CODES.items():
        code = F.when(label == name, number).otherwise(code)
    return code


def encode_payload(value: Column) -> Column:
    """Stored form of a string: its bytes."""
    return F.encode(value, "UTF-8")


def decode_payload(data: Column) -> Column:
    """String of a stored form."""
    return F.decode(data, "UTF-8")


def is_gzip_name(path: Column) -> Column:
    """The name ends in .gz and has more than that; case counts."""
    return F.endswith(path, F.lit(".gz")) & (F.length(path) > 3)


def is_fastq_name(path: Column) -> Column:
    """The name holds .fastq or .fq anywhere."""
    return F.contains(path, F.lit(".fastq")) | F.contains(path, F.lit(".fq"))


def size_reduction_pct(original: Column, stored: Column) -> Column:
    """Percent saved; negative where the stored form is larger, null for an empty original."""
    return F.when(original != 0, (original - stored) / original * 100)
