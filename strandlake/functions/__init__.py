"""Column-to-column functions; all stay inside the JVM."""

from strandlake.functions.sequence import (
    decode_payload,
    encode_payload,
    format_code,
    format_label,
    has_rna,
    header_id,
    is_fastq_name,
    is_gzip_name,
    is_nucleotide,
    join_sequence_lines,
    residue_kind,
    size_reduction_pct,
    strip_line_end,
)
from strandlake.functions.synth import synthetic_dna, synthetic_quality

__all__ = [
    "decode_payload", "encode_payload", "format_code", "format_label", "has_rna", "header_id",
    "is_fastq_name", "is_gzip_name", "is_nucleotide", "join_sequence_lines", "residue_kind",
    "size_reduction_pct", "strip_line_end", "synthetic_dna", "synthetic_quality",
]
