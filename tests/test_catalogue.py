"""Every query with SQL agrees with DuckDB on the smallest tables; the others run and keep their schema."""

import glob
import math
import os

import duckdb
import pytest

from posegrid.plans import QUERIES, SQL


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted("|".join(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_kernel_queries_do_not_depend_on_partitions(spark, data, name):
    a = QUERIES[name](spark, data)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        rows = sorted(map(str, a.collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(map(str, QUERIES[name](spark, data).collect())) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
