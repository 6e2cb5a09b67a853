"""Corpus pipeline: five operators in a row, each over all that the one before kept.

The quality classifier drops documents that it rejects; line deduplication
takes out repeated runs of lines; of each group of near-duplicates one document
stays; documents with benchmark passages go; what is left is mixed to target
weights, so the last stage has a row for each time that a document comes.

Nulls in any column, repeated rows, empty and very long texts and further
columns are as each operator says; all stages but the last pass on the columns
that documents have. An empty table gives an empty one.
"""

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.decontaminate import decontaminate
from strandlake.llm.line_dup import dedup_lines
from strandlake.llm.mixing import mix_documents
from strandlake.llm.near_dup import drop_near_dups
from strandlake.llm.quality import keep_quality
from strandlake.llm.shared import written_alone

#: Common shingles of two documents, in percent of all of theirs, from which the near_dedup stage links them; op10 has its own.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand in an earlier one; those with nothing else go."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at a similarity of NEAR_PERCENT or more."""
    return drop_near_dups(docs, percent=NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, n_chars, domain, epoch of the mix."""
    return mix_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: A trained classifier and signatures are no SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again; what a stage wrote for itself goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
