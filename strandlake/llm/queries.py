"""The registered queries of this folder: each operator over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontaminate, license_scan, line_dup, media, mixing, near_dup, oracles, pii, quality, substring_dup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark, sf_dir):
    """doc_id, start, end, keeper_doc_id, keeper_start of each line, or sentence in a line, that goes."""
    return substring_dup.repeated_units(table(spark, sf_dir, "documents"))


SQL["op1_substring_dedup"] = oracles.SUBSTRING_DUP


@query
def op2_license_scan(spark, sf_dir):
    """doc_id, paragraph, start, end, family, probability, shared of each notice."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark, sf_dir):
    """doc_id, domain, lang, source, n_tokens, epoch."""
    return mixing.mix(table(spark, sf_dir, "documents"))


SQL["op3_mixing"] = mixing.ORACLE


@query
def op4_pii(spark, sf_dir):
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, scores."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


SQL["op4_pii"] = oracles.PII


@query
def op5_line_dedup(spark, sf_dir):
    """doc_id, n_removed, removed_bytes, kept_bytes, kept_sha256, spans."""
    return line_dup.line_dedup_report(table(spark, sf_dir, "documents"))


SQL["op5_line_dedup"] = oracles.LINE_DUP


@query
def op6_decontaminate(spark, sf_dir):
    """doc_id, item_id, common, n_item, containment."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op6_decontaminate"] = oracles.DECONTAMINATE


@query
def op7_quality(spark, sf_dir):
    """doc_id, held_out, score, predicted."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_media(spark, sf_dir):
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return media.media_digest(table(spark, sf_dir, "documents"))


SQL["op8_media"] = oracles.MEDIA


@query
def op9_warc(spark, sf_dir):
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL["op9_warc"] = oracles.WARC


@query
def op10_near_dup(spark, sf_dir):
    """doc_id, n_shingles, component_id, kept."""
    return near_dup.near_dup_groups(table(spark, sf_dir, "documents"))


SQL["op10_near_dup"] = oracles.NEAR_DUP


@query
def pipeline(spark, sf_dir):
    """doc_id, text, lang, source, n_chars, domain, epoch."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
