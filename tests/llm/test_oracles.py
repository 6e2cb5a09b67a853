"""Queries of this folder against their SQL, on a whole small scale."""

import duckdb
import pytest

from strandlake.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")


def rows(data):
    return sorted(tuple(f"{x:.12g}" if isinstance(x, float) else str(x) for x in r) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    frame = QUERIES[name](spark, DATA)
    cols = sorted(frame.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = con.execute(f"select {quoted} from ({SQL[name]})").fetchall()
    assert want and rows(frame.select(cols).collect()) == rows(want)
