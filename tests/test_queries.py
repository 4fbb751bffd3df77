"""Every query with SQL against DuckDB, on the smallest data; the llm queries have tests of their own."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from recscan.plans import activity_queries, curation_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = activity_queries.QUERIES | curation_queries.QUERIES
SQL = activity_queries.ORACLE_SQL | curation_queries.ORACLE_SQL


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def table(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), names)


def test_entry_and_registry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_split_spans_cover_what_they_split(spark, sf):
    got = [r for r in QUERIES["split_long_spans"](spark, sf).collect()]
    total = {}
    for r in got:
        assert r["end_s"] - r["start_s"] <= 20.0 + 1e-6
        total[r["source_key"]] = total.get(r["source_key"], 0) + r["end_s"] - r["start_s"]
    whole = {r["source_key"]: r["end_s"] for r in QUERIES["split_points"](spark, sf).collect()}
    assert {k: round(v, 3) for k, v in total.items()} == {k: round(v, 3) for k, v in whole.items()}


def test_merge_spans_sql_leaves_equal_spans_to_no_chance(spark, tmp_path):
    """Recordings with many spans that begin and end alike: the SQL's windows once ordered them each on its own."""
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT range AS s_suppkey FROM range(30000)")
    con.execute("CREATE TABLE part AS SELECT range % 20000 + range // 20000 * 20000 AS p_partkey, (range % 20000 * 7 % 50 + 1)::INTEGER AS p_size FROM range(600000)")
    for t in ("supplier", "part"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = sorted(tuple(r) for r in QUERIES["merge_spans"](spark, str(tmp_path)).select("source_key", "start_s", "end_s").collect())
    for _ in range(3):
        assert sorted(con.execute(f"SELECT source_key, start_s, end_s FROM ({SQL['merge_spans']})").fetchall()) == got
