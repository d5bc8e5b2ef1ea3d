"""Every query with an SQL twin gives the twin's rows on the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, got.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and n not in ("ablation", "router_model")))
def test_runs(spark, name):
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_same_rows_for_any_partitioning(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([_rows(df.columns, [tuple(r) for r in df.collect()]) for df in (QUERIES[q](spark, DATA) for q in ("sparsity_score", "p2_found", "p4_found", "split_assign"))])
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
