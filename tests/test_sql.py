"""Every query of the core with SQL gives the rows DuckDB gives."""

import math
import os

import duckdb
import pytest

from weft import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in os.listdir(sf):
        at = f"{sf}/{p}" + ("/*.parquet" if os.path.isdir(f"{sf}/{p}") else "")
        c.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{at}'")
    return c


def canon(df):
    def f(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(round(x, 8) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(f(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, sf, duck, name):
    ours = catalog.QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).limit(5).count() > 0


def test_partitioning_does_not_matter(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append([canon(catalog.QUERIES[q](spark, sf).toPandas()) for q in ("hotspots", "call_cascade", "cluster_rollups", "p6_found", "trace_paths")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
