"""Row shapes and file-kind codes shared by every source, operator and sink."""

from pyspark.sql import types as T

#: What a load exposes: one row per id.
RECORDS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("quality", T.StringType()),
    ]
)

#: What a scan yields: the record and where in the input it stood.
SCAN = T.StructType(
    RECORDS.fields
    + [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("ord", T.LongType()),
    ]
)

#: The mutable store; kind tells which payload columns are set.
KEY_VALUE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("sequence", T.BinaryType()),
        T.StructField("quality", T.BinaryType()),
    ]
)

# The file-kind codes of the binary format.
FORMAT_CODES = {
    "DNA_FASTA": 0,
    "RNA_FASTA": 1,
    "PROTEIN_FASTA": 2,
    "DNA_FASTQ": 3,
    "RNA_FASTQ": 4,
    "PROTEIN_FASTQ": 5,
}
FORMAT_NAMES = {code: name for name, code in FORMAT_CODES.items()}
