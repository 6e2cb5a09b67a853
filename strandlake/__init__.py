"""Spark-native store for biological sequence files."""

from strandlake.operators.store import SequenceStore

__all__ = ["SequenceStore"]
