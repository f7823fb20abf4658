"""Every query with SQL against DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from facetlake import registry
from facetlake.operators import stats

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return float(v) if isinstance(v, Decimal) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLES[name])
    columns = [x[0] for x in cur.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in got.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"tsne"}))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_without_training_data_package():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(SF)


def test_tsne_covers_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.QUERIES["tsne"](spark, sf).toPandas()
    assert sorted(got.s_suppkey) == sorted(r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect())
    assert got.notna().all().all()


def test_tsne_in_blocks():
    x = np.random.default_rng(0).normal(size=(70, 3))
    whole = stats.tsne(x, 10, 20)
    assert np.allclose(stats.tsne(x, 10, 20, block=500, held=0), whole)
