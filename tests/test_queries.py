"""Every registered query against its SQL in another engine."""

import os

import duckdb
import pytest

from tests.conftest import DATA
from twinsift import queries

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, tables, name):
    got = queries.queries()[name](spark, DATA)
    want = tables.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_scans_read_what_they_need(spark):
    plan = queries.skip_anti(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["group_members", "same_matches", "cross_matches"])
def test_lists_hold_every_path(spark, tmp_path, name):
    """A group of 14,000 copies: each list names all of them, as its SQL does without a bound."""
    spark.range(14000).selectExpr("id AS doc_id", "'same' AS text", "'en' AS lang", "concat('src', id % 20) AS source", "4 AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns) and "LIMIT" not in queries.oracle_sql()[name]
    columns = ", ".join(f'"{c}"' for c in got.columns)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want.project(columns).fetchall())
    # links collapse: of 11,200 with an inode two are left, and the 2,800 without all count; one is kept by same_matches
    named = sum(len(v.split("|")) for r in rows for k, v in zip(got.columns, r, strict=True) if k in ("paths", "extras", "a", "b"))
    assert named == 2802 - (name == "same_matches")
