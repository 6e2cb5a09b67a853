"""The first record of an id in a file, however its splits are dealt."""

import gzip
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from strandlake.operators.lookup import first_in_file
from strandlake.plans.queries import QUERIES, SQL
from strandlake.sources.fasta import scan_fasta
from strandlake.sources.fastq import scan_fastq


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "300")
    yield
    for name in names:
        spark.conf.unset(name)


def found(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("end", ["", ".gz"])
def test_one_file(spark, tmp_path, small_splits, end):
    data = b"".join(b">k%d\n%d\n" % (n % 2, n) for n in range(200)) + b">late\nL\n"
    path = tmp_path / f"one.fasta{end}"
    path.write_bytes(gzip.compress(data) if end else data)
    scan = scan_fasta(spark, str(path))
    assert scan.rdd.getNumPartitions() == (1 if end else 5)
    lookups = [first_in_file(scan, key) for key in ("k1", "none", "late")]
    assert sorted(found(lookups[0].unionAll(lookups[1]).unionAll(lookups[2]))) == [("k1", "1"), ("late", "L")]


def test_several_files(spark, tmp_path, small_splits):
    """The larger file is dealt to tasks first, and is not the first."""
    (tmp_path / "a.fasta").write_bytes(b">x\nA\n>k\nfirst\n>k\nsecond\n")
    (tmp_path / "b.fasta").write_bytes(b"".join(b">k\n%d\n" % n for n in range(100)) + b">z\nZ\n")
    scan = scan_fasta(spark, str(tmp_path))
    assert found(first_in_file(scan, "k")) == [("k", "first")] and found(first_in_file(scan, "z")) == [("z", "Z")]


def test_fastq(spark, tmp_path):
    (tmp_path / "q.fastq").write_bytes(b"".join(b"@k%d\n%d\n+\nI\n" % (n % 5, n) for n in range(100)))
    assert found(first_in_file(scan_fastq(spark, str(tmp_path / "q.fastq"), split_bytes=300), "k3")) == [("k3", "3")]


def test_several_executors(tmp_path):
    """Rows of splits reach a shuffle in any order there; a union of lookups is still right."""
    (tmp_path / "one.fasta").write_bytes(b"".join(b">k%d\n%d\n" % (n % 5, n) for n in range(500)))
    code = f"""
from functools import reduce
from pyspark.sql import DataFrame, SparkSession
b = SparkSession.builder.master("local-cluster[3,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.scheduler.minRegisteredResourcesRatio", "1.0")
s = b.config("spark.sql.files.maxPartitionBytes", "1200").config("spark.sql.files.openCostInBytes", "1200").getOrCreate()
from strandlake.operators.lookup import first_in_file
from strandlake.sources.fasta import scan_fasta
scan = scan_fasta(s, "{tmp_path}/one.fasta")
got = {{tuple(r) for r in reduce(DataFrame.unionAll, [first_in_file(scan, f"k{{n}}") for n in range(5)]).collect()}}
assert got == {{(f"k{{n}}", str(n)) for n in range(5)}}, got
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=str(Path(__file__).parent.parent))


@pytest.mark.parametrize("users", [[7], [], [7, 8, 9]])
def test_few_users(spark, tmp_path, users):
    """One user is the least and the greatest at once, and comes once."""
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, user_id bigint, event_type varchar)")
    for n, user in enumerate(users * 3):
        con.execute("insert into events values (?, ?, ?)", [90 - n, user, f"t{n}"])
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = con.execute(f"select id, sequence from ({SQL['linear_lookup']})").fetchall()
    assert sorted(found(QUERIES["linear_lookup"](spark, str(tmp_path)).select("id", "sequence"))) == sorted(want)
