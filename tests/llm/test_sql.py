"""Queries with SQL against DuckDB over whole tables, and every query's name and columns."""

import duckdb
import pytest

from patentframe.llm.queries import ORACLE_SQL, QUERIES
from tests.test_parity import TABLES, canonical

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), names)


def test_one_query_an_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
