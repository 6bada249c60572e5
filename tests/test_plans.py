"""Every plan against its SQL."""

import duckdb
import pytest

from cairnspark.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLE_SQL:
        assert got
        return
    rel = db.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = [df.columns.index(c) for c in rel.columns]
    assert norm([tuple(r[i] for i in order) for r in got]) == norm(rel.fetchall())
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds.get(t, t) for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
