"""Deterministic synthetic residues: a digest's hex digits renamed."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
DNA, RNA, PROTEIN = "ACGTACGTACGTACGT", "ACGUACGUACGUACGU", "ARNDCQEGHILKMFPS"
#: Holds both marker characters of the four-line format, so that scans meet them in quality lines.
QUALITY = "!#%+5:?@ABCDEFHI"


def _digits(key: Column, length: int) -> Column:
    """length hex digits that only depend on key."""
    blocks = [F.md5(key if k == 0 else F.concat(key, F.lit(f"/{k}"))) for k in range((length + 31) // 32)]
    return F.substring(F.concat(*blocks), 1, length)


def synthetic_dna(key: Column, length: int = 32, alphabet: str = DNA) -> Column:
    """Uniform residues for a key."""
    return F.translate(_digits(key, length), HEX, alphabet)


def synthetic_quality(key: Column, length: int = 32) -> Column:
    """Uniform quality symbols for a key, independent of its residues."""
    return F.translate(_digits(F.concat(F.lit("q"), key), length), HEX, QUALITY)
