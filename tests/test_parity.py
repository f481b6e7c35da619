"""Each query with SQL against DuckDB, as the driver compares them; the others give rows."""

import os

import duckdb
import pytest

from patentframe.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(repr([cell(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    left, right = canonical([tuple(r) for r in got.collect()], got.columns), canonical(want.fetchall(), names)
    assert left and left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
