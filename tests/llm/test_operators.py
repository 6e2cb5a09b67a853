"""Each operator against brute force, on small tables and on odd ones."""

import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_whole_lines import pairs_brute

from strandlake.llm import decontaminate, license_scan, media, mixing, near_dup, quality, substring_dup, warc, words

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 4000 + "z" * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string, key int, rep int, digest string, spans int, start int, epoch int, h int"
TEXT = "one two three four five six seven.\nsecond line of this text here.\nthird line, with some words.\nfourth one ends it all now."
ODD = [(1, TEXT, "en", "src1"), (2, TEXT, "en", "src1"), (2, TEXT, "en", "src1"), (3, None, None, None), (4, "", "", ""), (5, LONG, "fr", "x"), (None, TEXT, "de", "src2"), (6, "short one", "en", "src99999999999999999999"), (7, "SHORT  One", "en", "src3"), (8, " \n\t ", "en", "src3")]
ODD = [(*r, 0, "c", 1, 2, "d", 3, 4, 5, 6) for r in ODD]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def grouped(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, parent = defaultdict(list), {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for g in s for j in holders[g])
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: root(i) for i in texts}, sets


def test_words_and_shingles():
    texts = [r[1] for r in ODD] + ["A b\x0bC é Ü x y", "a b c é Ü x y"]
    h, at = words.shingle_sets(pa.array(texts))
    assert [len(shingles(t)) for t in texts] == np.diff(at).tolist()
    assert h[at[-3] : at[-2]].tolist() == h[at[-2] :].tolist()


def test_superminhash_is_unbiased_and_calm():
    rng, same = np.random.default_rng(1), []
    for _ in range(150):
        u = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.sort(u[:300]), np.sort(u[100:])
        s = near_dup.superminhash(np.concatenate([a, b]), np.array([0, 300, 600]))
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - 0.5) < 0.02 and np.std(same) < np.sqrt(0.25 / near_dup.SLOTS)
    one = near_dup.superminhash(np.array([5], np.uint64), np.array([0, 1]))[0]
    assert sorted((one >> np.uint64(56)).tolist()) == list(range(near_dup.SLOTS))


def test_near_dup(spark, docs, odd, none):
    rows = {d.doc_id: d.text for d in docs.collect()}
    chain = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split() * 4
    near = {1000 + k: " ".join(f"{w}{i}" for i, w in enumerate(chain)) for k in range(1)}
    for k in range(1, 12):  # each like the one before it, the ends not like each other
        w = near[999 + k].split()
        w[k * 5] += "x"
        near[1000 + k] = " ".join(w)
    want, sets = grouped(rows | near)
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(near.items()), "doc_id long, text string"))
    got = {r.doc_id: r for r in near_dup.near_dup_groups(both).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and len(got) == len(want)
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in want)
    odds = near_dup.near_dup_groups(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in odds) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (8, 8, True)]
    kept = near_dup.drop_near_dups(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8]
    assert near_dup.near_dup_groups(none).collect() == []


def test_open_buckets(spark):
    """Links that no bucket's least member has are found among the others."""
    members = spark.createDataFrame([(1, r, n, 4) for r, n in ((1, 10), (2, 20), (3, 19), (4, 10))], "key long, rep long, n long, members long")
    sets = spark.createDataFrame([(1, list(range(100, 110))), (2, list(range(20))), (3, list(range(19))), (4, list(range(50, 60)))], "rep long, shingles array<long>")
    alone = spark.createDataFrame([], "node long, component long")
    found = near_dup._compare_open_buckets(members, alone, sets, 85)
    assert [tuple(r) for r in found.collect()] == [(2, 3)]


@pytest.mark.parametrize("block", [1 << 24, 4000, 300])
def test_open_buckets_in_blocks(spark, block):
    """One large group, many strays and links among them, however the bucket is dealt into blocks."""
    rng = np.random.default_rng(3)
    base = {k: set(rng.integers(0, 10**6, 60).tolist()) for k in range(12)}
    sets, comp = {}, {}
    for rep in range(150):
        own = sorted(base[rep % 12 if rep % 3 else 0])
        own = own[: len(own) - rep % 4] + rng.integers(2 * 10**6, 10**7, rep % 3).tolist()
        sets[rep], comp[rep] = own, 0 if rep % 3 == 0 else rep
    members = spark.createDataFrame([(7, r, len(s), len(sets)) for r, s in sets.items()], "key long, rep long, n long, members long")
    groups = spark.createDataFrame([(r, c) for r, c in comp.items() if not c], "node long, component long")
    lists = spark.createDataFrame(list(sets.items()), "rep long, shingles array<long>")
    links = [tuple(r) for r in near_dup._compare_open_buckets(members, groups, lists, 85, block).collect()]
    def joined(edges):
        up = {r: r for r in sets}
        def root(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in [*edges, *((r, c) for r, c in comp.items())]:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return {r: root(r) for r in sets}
    true = [(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))]
    assert joined(links) == joined(true) and len(set(joined(true).values())) < 20


def test_hub(spark):
    """A node with half of all links."""
    edges = [(5, k) for k in range(10, 3000)] + [(k, k + 1) for k in range(5000, 5100)] + [(1, 2999), (2, 5100)]
    got = dict(near_dup.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    assert {k: v for k, v in got.items() if k < 4000 and k != 2} == {k: 1 for k in (1, 5, *range(10, 3000))} and got[5000] == got[2] == 2


def test_components(spark):
    path = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 3), (200, 201)]
    got = dict(near_dup.components(spark.createDataFrame(path, "a long, b long").repartition(5)).collect())
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


def lower(text):
    return re.sub("[A-Z]", lambda c: c[0].lower(), text)


def units_brute(rows):
    """Lines, and sentences of five words or more in lines of several, that stand earlier as either."""
    units = defaultdict(set)
    for doc, text in rows:
        text = text or ""
        key = hashlib.sha256(text.encode()).digest()
        at = 0
        for line in text.split("\n"):
            w = lower(line).split()
            if w:
                units[" ".join(w)].add((doc is None, doc or 0, key, at, at + len(line), at, False))
            for m in re.finditer(r".*?[.!?]+(?=\s|$)|.+", line):
                if 5 <= len(v := lower(m[0]).split()) < len(w):
                    units[" ".join(v)].add((doc is None, doc or 0, key, at + m.start(), at + m.end(), at, True))
            at += len(line) + 1
    gone = [(p, min(places)) for places in units.values() for p in places if p[:4] != min(places)[:4]]
    whole = {(*p[:3], p[5]) for p, _ in gone if not p[6]}
    return sorted((p[1], p[3], p[4], k[1], k[3]) for p, k in gone if not p[6] or (*p[:3], p[5]) not in whole)


def test_substring(docs, odd, none):
    for frame in (docs, odd, none):
        got = substring_dup.repeated_units(frame).distinct().collect()
        assert sorted((r.doc_id or 0, r.start, r.end, r.keeper_doc_id or 0, r.keeper_start) for r in got) == units_brute([(d.doc_id, d.text) for d in frame.collect()])
    cut = substring_dup.cut_spans(odd)
    assert cut.columns == odd.columns and {(r.doc_id, r.text) for r in cut.collect() if r.doc_id in (1, 2, None)} == {(1, TEXT), (2, ""), (None, "")}


def test_units_of_odd_rows(spark):
    """Rows without an id are documents by their texts; sentences within lines; very long texts."""
    long = f"{'x' * 3_000_000} {'word ' * 3_000_000}"
    rows = [(None, "a first line here.\nanother of this text"), (None, "clean and whole\nin all of its two lines"), (3, "Head. so it is by now here. A first line HERE."), (4, long), (5, f"{long}\nof its own."), (6, "Of  its own.\nBefore it. so it is by now here. and more")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = substring_dup.repeated_units(docs).collect()
    assert sorted((r.doc_id, r.keeper_doc_id) for r in got) == [(5, 4), (6, 3), (6, 5)]
    want = [*(r[1] for r in rows[:4]), "\nof its own.", "\nBefore it. and more"]
    assert sorted(r.text for r in substring_dup.cut_spans(docs).collect()) == sorted(want)
    assert sorted((r.doc_id, r.keeper_doc_id) for r in substring_dup.repeated_units(docs, sentences=False).collect()) == [(5, 4), (6, 5)]
    assert [r.doc_id for r in substring_dup.repeated_units(docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(9).cast("long"))), "paragraph", False).collect()] == [9]


def test_decontaminate(spark, docs, odd, none):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    have = {i.item_id: shingles(i.text) for i in items.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, s in have.items() if 100 * len(s & shingles(d.text)) >= 80 * len(s)}
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    long = [(d.doc_id, tokens(d.text)) for d in docs.collect() if d.doc_id % 5 == 0]
    cuts = [" ".join(w[k : k + n]) for _, w in long for n in (5, 6, 8, 23, 24) for k in range(0, len(w) - n, max(1, len(w) // 3))]
    short = spark.createDataFrame(list(enumerate(cuts)), "item_id long, text string")
    have = {i: shingles(t) for i, t in enumerate(cuts)}
    want = {(i, k) for i, w in long for own in [shingles(" ".join(w))] for k, s in have.items() if 100 * len(s & own) >= 80 * len(s)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs.where("doc_id % 5 = 0"), short).collect()} == want
    few = spark.createDataFrame([(1, "short ONE", 3), (2, None, 3), (3, "", 3), (4, "sit amet lorem ipsum dolor sit amet", 3)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, few).collect()) == [(5, 4), (6, 1), (7, 1)]
    left = decontaminate.decontaminate(odd, few)
    assert left.columns == odd.columns and left.count() == len(ODD) - 3
    assert decontaminate.contaminated(none, few).collect() == [] == decontaminate.contaminated(odd, few.limit(0)).collect()


def test_quality(spark, docs, odd, none):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = quality.score_documents(spark.read.parquet(f"{base}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    for frame, lab in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        out = quality.score_documents(frame, lab)
        assert sorted(r.doc_id or 0 for r in out.collect()) == sorted(r.doc_id or 0 for r in frame.collect())
    kept = quality.keep_quality(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert np.interp([0, 1, 2, 3], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_mixing(spark, docs, odd, none):
    con = duckdb.connect()
    for frame in (docs, odd, none):
        table = frame.select("doc_id", "text", "lang", "source").toArrow()
        con.register("documents", table)
        want = con.execute(mixing.ORACLE).fetchall()
        got = mixing.mix(frame).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        con.unregister("documents")
    assert mixing.mix_documents(odd).columns == ["doc_id", "text", "lang", "source", "n_chars", "domain", "epoch"]


def test_media(docs, odd, none):
    for frame in (docs, odd, none):
        got = media.media_digest(frame).collect()
        rows = Counter()
        for d in frame.collect():
            data = (d.text or "").encode()
            p = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
            image = media.image_of(p)
            rows[d.doc_id, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(p)] += 1
        assert Counter(map(tuple, got)) == rows
    big = np.random.default_rng(1).bytes(200_000)
    a, b = set(media.chunks(big)), set(media.chunks(b"x" + big))
    assert b"".join(media.chunks(big)) == big and len(a & b) > 0.9 * len(a)
    stored, borrowed = media.store(odd)
    assert borrowed.count() >= 1


def test_warc(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    same, html = "s" * 100, "<p>é</p>" + "y" * 99
    rows = [(5, "u", same), (3, "u\r\nX: 1", same), (3, "u", same), (9, None, same), (1, "u", "s" * 99), (2, "u", "s" * 99), (4, "u", None), (6, "u", ""), (None, "u", html), (7, "u", html), (8, "u", "\r\n\r\nWARC/1.1" + LONG)]
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    for frame in (pages, odd, odd.limit(0)):
        own = [(p.page_id, (p.html or "").encode()) for p in frame.collect()]
        least = {}
        for p, h in own:
            if p is not None:
                least[h] = min(p, least.get(h, p))
        want = [(p, len(h), hashlib.sha256(h).hexdigest(), *(("revisit", least[h]) if len(h) >= 100 and h in least and least[h] != p else ("response", None))) for p, h in own]
        assert Counter(map(tuple, warc.round_trip(frame).collect())) == Counter(want)
    warc.export(warc.normalise(warc.write_streams(odd)), str(tmp_path / "out"))
    n = 0
    for f in (tmp_path / "out").glob("*.warc.gz"):
        raw = f.read_bytes()
        index = [x.rsplit(" ", 3) for x in f.with_name(f.name.replace(".warc.gz", ".cdx")).read_text().splitlines()]
        n += len(index)
        assert sum(int(x[3]) for x in index) == len(raw) and gzip.decompress(raw) == b"".join(zlib.decompress(raw[int(x[2]) :], 31) for x in index)
    assert n == len(rows)


def test_licenses(spark, docs, odd, none):
    known = {"Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved."}
    rows = {d.doc_id: d.text for d in docs.collect()}
    got = license_scan.scan_licenses(docs).collect()
    assert {(r.doc_id, r.paragraph) for r in got} == {(i, k) for i, t in rows.items() for k, x in enumerate(t.split("\n")) if x in known}
    assert all(rows[r.doc_id][r.start : r.end] in known for r in got)
    texts, kinds = license_scan._examples(9, 60)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.family for r in license_scan.scan_licenses(frame).collect()}
    right = [found.get(k, "unknown") == license_scan.FAMILIES[c] for k, c in enumerate(kinds)]
    assert np.mean(right) > 0.9 and not any(k in found for k, c in enumerate(kinds) if c == len(license_scan.TEMPLATES))
    assert license_scan.scan_licenses(odd).collect() == [] == license_scan.scan_licenses(none).collect()


def test_pipeline(spark, docs):
    """Every stage against brute force on what the one before it kept."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(d.doc_id, d.text) for d in now.collect()]
        out = near_dup.written(stage(spark, now, DATA), "test")
        got = sorted((r.doc_id, r.text) for r in out.collect())
        if name == "quality":
            want = sorted((r.doc_id, dict(before)[r.doc_id]) for r in quality.score_documents(now, labels).collect() if r.predicted)
        elif name == "line_dedup":
            kept = pairs_brute(sorted(before))
            want = sorted((d, kept[d].decode()) for d, t in before if kept[d] == t.encode() or kept[d].strip())
        elif name == "near_dedup":
            want = sorted(r for r in before if grouped(dict(before), corpus_pipeline.NEAR_PERCENT)[0][r[0]] == r[0])
        elif name == "benchmark_decontamination":
            items = [shingles(i.text) for i in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            want = sorted(r for r in before if not any(100 * len(s & shingles(r[1])) >= 80 * len(s) for s in items))
        else:
            con = duckdb.connect()
            con.register("documents", now.toArrow())
            want = sorted((r[0], dict(before)[r[0]]) for r in con.execute(mixing.ORACLE).fetchall())
        assert got == want, name
        if name != "mixing":
            assert out.columns == docs.columns
        now = out
