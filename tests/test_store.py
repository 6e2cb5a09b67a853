import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandlake import SequenceStore
from strandlake import functions as fn
from strandlake.operators.dedup import dedup_scan
from strandlake.sources.fasta import scan_fasta
from strandlake.sources.fastq import scan_fastq

FASTA = b">seq1 dna sequence\r\nGATTACA\r\n>seq2 dna sequence\r\n" + b"CG" * 14
FASTQ = b"@seq1 First sequence\r\nGATTACA\r\n+\r\n@@@DDDD\r\n@seq2 Second sequence\r\n" + b"CG" * 14 + b"\r\n+\r\nHHH" + b"I" * 23


@pytest.fixture
def put(tmp_path):
    def f(name, data):
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        return str(tmp_path / name)

    return f


def rows(frame):
    return {r["id"]: (r["sequence"], r["quality"]) for r in frame.collect()}


def test_set_and_get(spark):
    s = SequenceStore(spark)
    s.set("seq1", "GATTACA")
    assert s.get("seq1") == "GATTACA" and s.size() == 1 and s.get("other") == ""
    s.set("seq1", "GATTACA" * 4)
    assert s.get_stored_size("seq1") == 28 and s.get_stored_size("other") == 0 and s.size() == 1


@pytest.mark.parametrize("name", ["a.fasta", "a.fasta.gz"])
def test_fasta(spark, put, name):
    s = SequenceStore(spark)
    s.load(put(name, FASTA))
    assert s.size() == s.file_cache_size() == 2
    assert s.get("seq1") == "GATTACA" and s.get_sequence("seq2") == "CG" * 14
    assert s.get_quality("seq1") == "" and s.has_sequence("seq1") and not s.has_sequence("x")
    assert s.detected_format() == "DNA_FASTA"
    assert tuple(s.get_fastq_record("seq1")) == ("GATTACA", "") and s.get_fastq_record("x") is None


@pytest.mark.parametrize("name", ["a.fastq", "a.fastq.gz"])
def test_fastq(spark, put, name):
    s = SequenceStore(spark)
    s.load(put(name, FASTQ))
    assert s.size() == 2 and s.detected_format() == "DNA_FASTQ"
    assert tuple(s.get_fastq_record("seq1")) == ("GATTACA", "@@@DDDD")
    assert tuple(s.get_fastq_record("seq2")) == ("CG" * 14, "HHH" + "I" * 23)


def test_save_and_restore(spark, put, tmp_path):
    s = SequenceStore(spark)
    s.set("seq1", "GATTACA")
    s.set("seq2", "CGCGCGCG")
    s.load(put("a.fasta", FASTA))
    s.save(str(tmp_path / "c.trac"))
    raw = (tmp_path / "c.trac").read_bytes()
    assert raw[:5] == b"TRAC\x02" and struct.unpack("<Q", raw[5:13])[0] == 2
    t = SequenceStore(spark)
    t.restore(str(tmp_path / "c.trac"))
    assert t.size() == 2 and t.get("seq2") == "CGCGCGCG" and t.file_cache_size() == 0
    s.save_smart_binary(str(tmp_path / "c.smrt"))
    assert len((tmp_path / "c.smrt").read_bytes()) == 13 + 2 * (12 + 4) + 7 + 28
    t.restore(str(tmp_path / "c.smrt"))
    assert t.size() == 4 and t.get_sequence("seq1") == "GATTACA" and t.get("seq2") == "CGCGCGCG"
    t.save_native(str(tmp_path / "native"))
    u = SequenceStore(spark)
    u.restore_native(str(tmp_path / "native"))
    assert u.size() == 4


def test_nothing_to_save(spark, tmp_path):
    SequenceStore(spark).save(str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_trac_kinds_and_precedence(spark, put):
    one = lambda b: struct.pack("<I", len(b)) + b
    body = one(b"seq1") + b"\x01" + one(b"AC") + one(b"II") + one(b"k") + b"\x00" + one(b"TT")
    s = SequenceStore(spark)
    s.load(put("a.fasta", FASTA))
    s.restore(put("a.trac", b"TRAC\x02" + struct.pack("<Q", 2) + body))
    assert s.get("seq1") == "GATTACA"  # passes over the FASTQ entry
    assert tuple(s.get_fastq_record("seq1")) == ("AC", "II") and s.get_stored_size("seq1") == 4
    assert s.get("k") == "TT" and s.get_fastq_record("k") is None and s.size() == 4
    s.set("seq1", "A")
    assert s.get("seq1") == "A" and s.size() == 4
    s.restore(put("v1", b"TRAC\x01" + struct.pack("<Q", 0)))
    assert s.size() == 4
    for bad in (b"TRAC\x02" + struct.pack("<Q", 1) + one(b"k") + b"\x07", b"TRAC\x02" + struct.pack("<Q", 3) + body):
        with pytest.raises(Exception, match="unknown record type|ends inside"):
            s.restore(put("bad", bad))
        assert s.size() == 4
    for bad in (b"XXXX", b"SM", b"SMRT\x09" + bytes(8)):
        with pytest.raises(ValueError):
            s.restore(put("bad2", bad))


def test_load_errors(spark, put):
    s = SequenceStore(spark)
    s.load(put("empty", b""))
    assert s.size() == 0
    with pytest.raises(ValueError):
        s.load(put("blank", b"\n>a\nA\n"))
    with pytest.raises(FileNotFoundError):
        s.load("/no/such/file")
    s.load(put("junk", b"no record\nhere"))
    assert s.size() == 0 and s.detected_format() == "DNA_FASTA"


def test_fasta_quirks(spark, put):
    data = b"junk\nA\n>a x\tb\nAC\n\nGT\n>b\ty\nA\rC\n>\nTT\n> x\nGG\n>a\nNEW\r\n>>z\nQ\n>last"
    want = {"a": ("NEW", ""), "b\ty": ("A\rC", ""), ">z": ("Q", ""), "last": ("", "")}
    assert rows(dedup_scan(scan_fasta(spark, put("q.fasta", data)))) == want
    twice = dedup_scan(scan_fasta(spark, [put("q.fasta", data), put("r.fasta", b">n\nA\n")]))
    assert rows(twice) == want | {"n": ("A", "")}
    same = b"s\nAC\n>s\nAC\n>s2\nG"
    assert rows(scan_fasta(spark, put("s.fasta", same))) == {"s": ("AC", ""), "s2": ("G", "")}


def test_fastq_quirks(spark, put):
    data = b"\nx\n@a\nAC\nnoplus\nII\n@b 1\nACG\n+b\n@+I\n\n@c\n\n+\n\n@t\nA\n+\n"
    strict = rows(scan_fastq(spark, put("q.fastq", data)))
    assert strict == {"b": ("ACG", "@+I"), "c": ("", "")}
    loose = rows(scan_fastq(spark, put("q.fastq", data), "lenient"))
    assert loose == strict | {"a": ("AC", "II")}
    assert rows(scan_fastq(spark, put("q.fastq", data)).where("id = 'c'")) == {"c": ("", "")}


def test_splits_agree_with_one_pass(spark, put):
    rng = random.Random(3)
    recs = [(f"r{rng.randrange(60)}", "".join(rng.choices("ACGT", k=rng.randrange(30))), "".join(rng.choices("@+I", k=rng.randrange(1, 30)))) for _ in range(300)]
    want = {i: (s, q) for i, s, q in recs}
    path = put("m.fastq", "".join(f"@{i} n\n{s}\n+\n{q}\n" for i, s, q in recs).encode())
    for split in (97, 1000):
        assert rows(dedup_scan(scan_fastq(spark, path, split_bytes=split))) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        fasta = put("m.fasta", "".join(f">{i} n\n{s[:9]}\n{s[9:]}\n" for i, s, q in recs).encode())
        assert rows(dedup_scan(scan_fasta(spark, fasta))) == {i: (s, "") for i, (s, _) in want.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_residues(spark):
    cases = {"ACGTN": "DNA", "ACGU": "RNA", "MKLVU": "RNA", "ACGTM": "PROTEIN", "AAAAAAAAAM": "DNA", "": "PROTEIN", "123": "PROTEIN", "acgtacgtac": "DNA"}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", fn.residue_kind(F.col("s")).alias("k"), fn.format_code(F.col("s"), F.lit("II")).alias("c"))
    assert {r["s"]: r["k"] for r in got.collect()} == cases
    assert {r["k"]: r["c"] for r in got.collect()} == {"DNA": 3, "RNA": 4, "PROTEIN": 5}


def test_set_all(spark):
    s = SequenceStore(spark)
    s.set("a", "1")
    s.set_all(spark.createDataFrame([("a", "2", 1), ("a", "3", 2), ("b", "4", 1)], "key string, value string, version int"))
    assert s.get("a") == "3" and s.get("b") == "4" and s.size() == 2


def test_stream(spark, tmp_path):
    from strandlake.streaming import fasta_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_bytes(FASTA)
    q = fasta_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("got").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("got").collect()} == {("seq1", "GATTACA"), ("seq2", "CG" * 14)}


def test_cut_off_gzip_raises(spark, put, tmp_path):
    rng = random.Random(1)
    data = "".join(f"@r{k}\n{''.join(rng.choices('ACGT', k=80))}\n+\n{'I' * 80}\n" for k in range(4000)).encode()
    whole = gzip.compress(data[:200_000]) + gzip.compress(data[200_000:])
    (tmp_path / "w.fastq.gz").write_bytes(whole)
    assert scan_fastq(spark, str(tmp_path / "w.fastq.gz")).count() == 4000
    for k, cut in enumerate((len(whole) // 2, len(whole) - 3)):
        (tmp_path / f"c{k}.fastq.gz").write_bytes(whole[:cut])
        with pytest.raises(Exception, match="ends inside a gzip member"):
            scan_fastq(spark, str(tmp_path / f"c{k}.fastq.gz")).count()
    (tmp_path / "c.fasta.gz").write_bytes(gzip.compress(b">a\n" + bytes(rng.choices(b"ACGT", k=90_000)))[:9000])
    with pytest.raises(Exception, match="(?i)eof|end of"):
        scan_fasta(spark, str(tmp_path / "c.fasta.gz")).count()


def test_batches_are_bounded_by_bytes(tmp_path):
    from strandlake.sources import fasta, fastq

    (tmp_path / "long.fastq").write_bytes(b"".join(b"@r%d\n%s\n+\n%s\n" % (k, b"A" * 3_000_000, b"I" * 3_000_000) for k in range(6)))
    reader = fastq.FastqReader({"path": str(tmp_path / "long.fastq")})
    sizes = [b.nbytes for p in reader.partitions() for b in reader.read(p)]
    assert len(sizes) == 3 and max(sizes) < 2 * fastq.BATCH_BYTES
    import pyarrow as pa

    pieces = pa.RecordBatch.from_arrays([pa.array([b"r%d\n%s" % (k, b"A" * 3_000_000) for k in range(6)]), pa.array(["f"] * 6), pa.array([1] * 6)], ["value", "file", "block"])
    out = list(fasta._parser(8192, 4 << 20)([pieces]))
    assert [b.num_rows for b in out] == [2, 2, 2]


def test_fasta_folder_needs_no_shuffle(spark, tmp_path):
    want = {}
    for k in range(7):
        (tmp_path / f"{k}.fasta").write_bytes((b"junk\n" if k % 2 else b"") + b"".join(b">%d.%d x\nAC\n%s\n" % (k, i, b"G" * i) for i in range(50)))
        want |= {f"{k}.{i}": ("AC" + "G" * i, "") for i in range(50)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        scan = scan_fasta(spark, str(tmp_path))
        assert rows(scan) == want
        assert "Exchange" not in scan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_last_wins_shuffles_ids_only(spark, put):
    data = b"".join(b">r%d\n%s\n" % (k % 40, b"ACGT" * k) for k in range(60))
    assert rows(dedup_scan(scan_fasta(spark, put("t.fasta", data)))) == {f"r{k}": ("ACGT" * (k + 40 if k < 20 else k), "") for k in range(40)}
    once = dedup_scan(scan_fasta(spark, put("o.fasta", data[: data.index(b">r0", 5)])))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert once.count() == 40 and "Exchange" not in plan and "FileScan parquet" in plan


@pytest.mark.parametrize("held", [1 << 20, 100])
def test_lookup_reads_the_loaded_table(spark, put, monkeypatch, held):
    from strandlake.operators import store

    monkeypatch.setattr(store, "HELD_BYTES", held)
    path = put("l.fasta", b"".join(b">r%d\nACGT\n" % k for k in range(1000)))
    s = SequenceStore(spark)
    s.load(path)
    assert s.summary["rows"] == 1000 and s.summary["action"] == "loaded"
    put("l.fasta", b">other\nT\n")  # the snapshot is not the file
    assert s.get("r77") == "ACGT" and s.get("other") == "" and (s._held is None) == (held == 100)
    assert tuple(s.get_fastq_record("r999")) == ("ACGT", "") and s.has_sequence("r0") and not s.has_sequence("r1000")
    plan = s.files.where("id = 'r77'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,r77)]" in plan and "Exchange" not in plan and "Arrow" not in plan


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from strandlake.sources import paths

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        paths.scratch(far, "x")


def test_scratch_goes_with_the_session(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from strandlake.sources.paths import scratch
at = scratch(s, "t")
s.range(3).write.parquet(at)
import os
assert os.path.exists(at[7:])
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=str(__import__("pathlib").Path(__file__).parent.parent))
    import time

    for _ in range(50):
        left = [p for p in (tmp_path / "shared").rglob("*.parquet")]
        if not left:
            break
        time.sleep(0.2)
    assert not left
