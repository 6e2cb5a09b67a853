"""Nulls, repeated rows, clashing columns, ties and very long texts, operator by operator."""

import hashlib
from collections import Counter

import pytest

from strandlake.llm import decontaminate, license_scan, line_dup, media, near_dup, pii, quality, substring_dup, warc

SCHEMA = "doc_id long, text string, lang string, source string, start int, key string, item string, spans int, size int, extra int, n int, x int, hash int"
PRIVATE = "mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111, phone +49 30 1234567"
NOTICE = "so it is\nReleased under the MIT License.\nend of it"
LEAK = "these are the words of an item that should not be in here at all"
TEXTS = [PRIVATE, NOTICE, f"so it says: {LEAK}", None, "", " \n\t", "plain words only"]
ROWS = [(i, t, None, None, 1, "k", "i", 2, 3, 4, 5, 6, 7) for i in (None, None, 5, 5, 6) for t in TEXTS]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def big(spark):
    """Texts of 20 MB: one line, and many lines."""
    return spark.createDataFrame([(1, f"{'w' * 50} " * 400_000 + PRIVATE), (2, "\n".join(f"line {k} of many words that go on" for k in range(600_000)) + f"\n{NOTICE}\n{LEAK}")], "doc_id long, text string")


def test_pii(odd):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.pii_digest(odd).collect())
    want = Counter((i, *([1] * 4 if t == PRIVATE else [0] * 4)) for i, t, *_ in ROWS)
    assert got == want and pii.pii_digest(odd.limit(0)).count() == 0


def test_licenses(odd):
    got = Counter((r.doc_id, r.family, r.paragraph) for r in license_scan.scan_licenses(odd).collect())
    assert got == Counter((i, "MIT", 1) for i, t, *_ in ROWS if t == NOTICE)


def test_items(spark, odd):
    items = [(1, LEAK), (1, LEAK), (1, "plain words only"), (None, "PLAIN  words only"), (2, None), (3, "")]
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == Counter((i, k) for i, t, *_ in ROWS for k, words in ((1, LEAK), (1, "plain words only"), (None, "plain words only")) if t and words in t)


def test_scores(spark, odd):
    rows = [(k, f"good words in a line number {k} of it", 1) for k in range(40)] + [(100 + k, "!!! $$$ 1234 " * (k + 1), 0) for k in range(40)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    texts = spark.createDataFrame([(1000 if i is None else i, t) for i, t, *_ in rows], "doc_id long, text string")
    both = texts.unionByName(odd.select("doc_id", "text"))
    got = {}
    for r in quality.score_documents(both, labels).join(both.select("doc_id").distinct(), "doc_id", "left").collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        got.setdefault(r.doc_id, set()).add(round(r.score, 9))
    scored = quality.score_documents(both.selectExpr("cast(null as long) as doc_id", "text"), labels.limit(0)).collect()
    assert len(scored) == both.count() and {r.score for r in scored} == {1.0} and not any(r.held_out for r in scored)
    kept = quality.keep_quality(odd, labels)
    assert kept.columns == odd.columns
    assert quality.score_documents(odd.limit(0), labels).count() == 0


def test_images(odd):
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in media.media_digest(odd).collect())
    want = Counter()
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        want[i, len(data), hashlib.sha256(data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))).hexdigest()] += 1
    assert got == want


def test_rows_go_together(odd):
    """Equal rows of one id are one document: all stay or all go."""
    lines = Counter((r.doc_id, r.text) for r in line_dup.dedup_lines(odd).collect())
    assert all(n == sum((i, t) == k for i, t, *_ in ROWS) for k, n in lines.items() if k[1] == PRIVATE)
    cut = Counter((r.doc_id, r.text) for r in substring_dup.cut_spans(odd).collect())
    assert sum(cut.values()) == len(ROWS) and cut[5, PRIVATE] == 2 and cut[6, PRIVATE] == cut[None, PRIVATE] == 0
    near = near_dup.near_dup_groups(odd)
    assert near.count() == len(ROWS) and {r.component_id for r in near.where("doc_id = 6").collect()} == {5, 6}


def test_long_texts(spark, big):
    found = {r.doc_id: r for r in pii.pii_digest(big).collect()}
    assert [found[1].n_email, found[1].n_ip, found[1].n_card, found[1].n_phone] == [1] * 4 and found[2].n_email == 0
    assert [(r.doc_id, r.family, r.paragraph) for r in license_scan.scan_licenses(big).collect()] == [(2, "MIT", 600_001)]
    items = spark.createDataFrame([(7, LEAK)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(big, items).collect()] == [(2, 7)]
    texts = dict(big.collect())
    for r in media.media_digest(big).collect():
        data = texts[r.doc_id].encode()
        assert r.n_bytes == len(data) and r.payload_sha256 == hashlib.sha256(data + b"\xff" * (-len(data) % 576)).hexdigest()
    pages = big.selectExpr("doc_id as page_id", "cast(null as string) as url", "text as html")
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in warc.round_trip(pages).collect()} == {(i, len(t.encode()), "response") for i, t in texts.items()}
    assert line_dup.line_dedup_report(big).where("n_removed > 0").count() == 0
