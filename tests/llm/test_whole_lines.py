"""Line deduplication against brute force over runs of lines, wherever they stand."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from strandlake.llm import line_dup, oracles, shared


def lines_of(text):
    lines = (text or "").encode().split(b"\n")
    return lines if lines[-1] else lines[:-1]


def runs_brute(rows):
    """Rows of doc_id, text with what stays: each line that is in no run found at an earlier place; a run has two lines that are not blank, or more, at its ends and any between."""
    places, out = [], []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())):
        own = lines_of(text)
        if (doc, own) not in places:
            places.append((doc, own))
    for doc, text in rows:
        own = lines_of(text)
        where = places.index((doc, own))
        earlier = [(k, i, o) for k, (_, o) in enumerate(places[: where + 1]) for i in range(len(o))]
        gone = set()
        for at in range(len(own)):
            for k, i, o in earlier:
                if (k, i) < (where, at):
                    n = 0
                    while at + n < len(own) and i + n < len(o) and own[at + n] == o[i + n]:
                        n += 1
                    full = [j for j in range(at, at + n) if own[j].strip()]
                    if len(full) >= 2:
                        gone |= set(range(full[0], full[-1] + 1))
        data = (text or "").encode()
        parts = [x + b"\n" for x in own]
        if own and not data.endswith(b"\n"):
            parts[-1] = own[-1]
        kept = b"".join(x for k, x in enumerate(parts) if k not in gone)
        if gone and len(own) - 1 in gone and not data.endswith(b"\n"):
            kept = kept.removesuffix(b"\n")
        kept = kept.decode() if gone else text
        out.append((doc, kept, len(gone)))
    return out


A, B, C, D, E = (f"passage {x}, one of the lines that go around" for x in "abcde")
ROWS = [
    (1, "\n".join(["own one", A, B, C, D, E, "own two"])),
    (2, "\n".join([B, C])),  # short, in the middle of a run
    (3, "\n".join(["other", C, D, "another"])),  # two lines between others
    (4, "\n".join(["p", "q", A, B, C, "r", "s", D, E]) + "\n"),
    (5, "\n".join([A, "alone", B])),  # single lines are no run
    (6, "\n".join(["x", "x", "x", "y", "x", "x", "y"])),  # repeats in one text, overlapping
    (7, "\n".join(["u", "", "", "", "v", "é\u2028w", "\r"])),
    (8, "\n".join(["t", "", "", "", "v", "é\u2028w", "\r"])),
    (9, None),
    (10, ""),
    (11, "\n\n\n"),
    (12, f"own start\n\n{C}\n{D}\n\n\n"),  # its own line ends stay
    (13, f"own start too\n\n{C}\n{D}"),
]


def test_runs_of_lines(spark):
    want = runs_brute(ROWS)
    assert [n for _, _, n in want][:5] == [0, 2, 2, 5, 0]
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in ROWS], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in line_dup.line_dedup_report(docs).collect()}
    assert {d: r.kept_sha256 for d, r in got.items()} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t, _ in want}
    assert got[3].spans == f"6:{6 + 2 * len(C) + 2}" and got[3].n_removed == 1
    runs = {r.doc_id: r.removed for r in line_dup.with_removed(docs).collect()}
    assert [(x.start, x.keeper_doc_id, x.keeper_start) for x in runs[3]] == [(6, 1, ROWS[0][1].index(C))]
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    cols = ["doc_id", "n_removed", "removed_bytes", "kept_bytes", "kept_sha256", "spans"]
    assert sorted(map(str, con.execute(f"select {', '.join(cols)} from ({oracles.LINE_DUP})").fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in got.values())
    kept = {r.doc_id: r for r in line_dup.dedup_lines(docs).collect()}
    assert {d: r.text for d, r in kept.items()} == {d: t for d, t, n in want if not n or t.strip()}
    assert all(r.n_chars == len(r.text or "") for r in kept.values()) and 2 not in kept


def pairs_brute(rows):
    """What stays of rows in order of doc_id: lines that are in no pair of lines, with blank ones between, found at an earlier place."""
    first, want = set(), {}
    for doc, text in rows:
        own, gone = lines_of(text), set()
        full = [k for k, x in enumerate(own) if x.strip()]
        for i, j in zip(full, full[1:], strict=False):
            pair = tuple(own[i : j + 1])
            gone |= set(range(i, j + 1)) if pair in first else set()
            first.add(pair)
        parts = [x + b"\n" for x in own[:-1]] + own[-1:] if not text.endswith("\n") else [x + b"\n" for x in own]
        kept = b"".join(x for k, x in enumerate(parts) if k not in gone)
        want[doc] = kept.removesuffix(b"\n") if len(own) - 1 in gone and not text.endswith("\n") else kept
    return want


def test_whole_table(spark):
    """Every covered line of a small scale goes, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = pairs_brute((d.doc_id, d.text) for d in docs.orderBy("doc_id").collect())
    got = {r.doc_id: r for r in line_dup.line_dedup_report(docs).collect()}
    assert {i: r.kept_sha256 for i, r in got.items()} == {d: hashlib.sha256(t).hexdigest() for d, t in want.items()}
    assert all(r.removed_bytes + r.kept_bytes == n for (d, n) in docs.selectExpr("doc_id", "octet_length(text) n").collect() for r in [got[d]])


def test_share_of_blocks_removed(spark):
    """Blocks of 2 to 30 lines, each within two texts of other lines: at least 0.9 of the later one's bytes go."""
    rng, rows, block = random.Random(5), [], {}
    line = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 9)))
    for n in (2, 3, 4, 6, 10, 20, 30):
        for _ in range(40):
            own = [line() for _ in range(n)]
            for _ in range(2):
                block[len(rows)] = n, sum(len(x) + 1 for x in own)
                rows.append((len(rows), "\n".join([line() for _ in range(rng.randrange(1, 6))] + own + [line() for _ in range(rng.randrange(1, 6))])))
    got = {r.doc_id: r.removed_bytes for r in line_dup.line_dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for n in (2, 3, 4, 6, 10, 20, 30):
        later = [d for d, (m, _) in block.items() if m == n and d % 2]
        assert sum(got[d] for d in later) >= 0.9 * sum(block[d][1] for d in later) and not any(got[d - 1] for d in later)


def test_coarse_chunks_move_with_their_lines():
    lines = [f"line {k}" for k in range(400)]
    whole, moved = (line_dup.boundaries([x.encode() for x in t]) for t in (lines, ["new", *lines[:200], "in between", *lines[200:]]))
    shifted = {e + 1 + (e > 200) for e in whole}
    assert len(whole) > 25 and len(shifted & set(moved)) >= len(whole) - 2
    text = "\n".join(lines).encode()
    assert {text[s:e] for s, e in line_dup.line_chunks(text) if text[s:e].count(b"\n") > 2}


def test_one_common_chunk_is_split(spark):
    """Half of all chunks are one and the same: the join on digests has no task with more than a part of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    new = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 40_000, 1, 16).selectExpr("xxhash64(id) as doc_id", "xxhash64(id, 1) as key", "cast(id % 7 as int) as start", "if(id % 2 = 0, 1L, id) as d1", "if(id % 2 = 0, 1L, id) as d2")
        rows, known = shared.written(rows, "test"), shared.written(rows.groupBy("d1", "d2").count(), "test")
        out = rows.join(known.hint("shuffle_merge"), ["d1", "d2"]).select("doc_id", F.spark_partition_id().alias("p")).toPandas()
        tasks = out.groupby("p").size()
        assert len(out) == 40_000 and tasks.max() < 10_000, tasks  # the common one has 20,000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
