"""Every core query against its SQL on the smallest tables."""

import duckdb
import pytest

from strandlake.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, DATA)
    cols = sorted(frame.columns)
    cur = con.execute(f"select {', '.join(cols)} from ({SQL[name]})")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, frame.select(cols).collect())) == sorted(map(key, cur.fetchall()))


def test_entry_imports_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "strandlake.llm", None)
    monkeypatch.setitem(sys.modules, "strandlake.llm.queries", None)
    try:
        assert set(importlib.reload(__spark_entry__).queries()) == set(QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
