"""Registered queries against their SQL twins."""
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from glucoframe.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    out = QUERIES[name](spark, str(SF))
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(out.columns)
    order = [rel.columns.index(c) for c in out.columns]
    assert Counter(map(tuple, out.collect())) == Counter(tuple(r[i] for i in order) for r in rel.fetchall())
