"""Ward's agglomeration along a line in parts against the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake import registry
from facetlake.operators import stats, ward


def shapes():
    r = np.random.default_rng(0)
    yield "uniform", r.random(300)
    yield "clusters", np.concatenate([r.normal(k * k, 0.1, 40) for k in range(6)])[r.permutation(240)]
    yield "growing", np.cumsum(np.arange(120.0) ** 1.5 + r.random(120))  # parts wait for each other
    yield "skewed", r.lognormal(0, 3, 300)
    yield "equal", r.integers(0, 40, 300) ** 2 + np.pi


@pytest.mark.parametrize("name, x", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_ward_by_the_whole_matrix(spark, name, x):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    for k, rows in ((1, 1 << 16), (4, 60), (9, 1 << 16)):
        got = {r["id"]: r["cluster"] for r in ward.ward_line(df, "v", "id", k, rows).collect()}
        assert [got[i] for i in range(len(x))] == stats.hierarchical(x[:, None], k, "ward").tolist()


def test_ward_merges_all_gaps_once():
    r = np.random.default_rng(1)
    x = np.sort(r.random(2000))
    points = [(v, v, 1, i) for i, v in enumerate(x)]
    whole = merges = ward.merged(points, False, False)[1]
    assert sorted(g[0] for g in merges) == x[1:].tolist()
    rest, some = ward.merged(points[500:700], True, True)
    assert set(some) <= set(whole) and len(some) + len(rest) == 198 and len(rest) < 40


def test_ward_odd_rows(spark):
    rows = [(1, 0.0), (2, 0.0), (3, None), (4, float("nan")), (5, 9.0), (6, 0.0), (7, 9.0), (8, float("inf"))]
    df = spark.createDataFrame(rows, "id long, v double")
    at = lambda k: {r["id"]: r["cluster"] for r in ward.ward_line(df, "v", "id", k).collect()}
    none = {3: None, 4: None, 8: None}
    assert at(2) == {1: 0, 2: 0, 6: 0, 5: 1, 7: 1} | none
    x = np.array([[v] for i, v in rows if i not in none])
    for k in (3, 4):  # fewer values than clusters
        assert {i: c for i, c in at(k).items() if i not in none} == dict(zip([1, 2, 5, 6, 7], stats.hierarchical(x, k, "ward").tolist()))
    assert at(9) == {1: 0, 2: 1, 5: 2, 6: 3, 7: 4} | none
    assert ward.ward_line(df.limit(0), "v", "id", 3).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_as_by_the_whole_matrix(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/supplier.parquet").orderBy("s_suppkey").toPandas()
    got = registry.QUERIES["hierarchical"](spark, path).orderBy("s_suppkey").toPandas()
    assert got.s_suppkey.tolist() == rows.s_suppkey.tolist()
    assert got.cluster.tolist() == stats.hierarchical(rows[["s_acctbal"]].to_numpy(float), 4, "ward").tolist()


def test_query_above_the_old_limit(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/supplier.parquet")
    more = rows.crossJoin(spark.range(6).withColumnRenamed("id", "copy")).withColumn("s_suppkey", F.col("s_suppkey") + 1000 * F.col("copy")).drop("copy")
    more.write.parquet(str(tmp_path / "supplier.parquet"))
    got = registry.QUERIES["hierarchical"](spark, str(tmp_path)).toPandas()
    one = registry.QUERIES["hierarchical"](spark, "/root/testdata/sf0.1").toPandas()
    assert len(got) == 6000  # copies weigh all values alike, so clusters are those of the table itself
    assert dict(zip(got.s_suppkey, got.cluster)) == {k + 1000 * c: v for k, v in zip(one.s_suppkey, one.cluster) for c in range(6)}
