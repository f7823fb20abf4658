"""t-SNE over leaves against the exact descent, nearest lists against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake import registry
from facetlake.operators import embedding as E
from facetlake.operators import space as S
from facetlake.operators.space import Space


def table(spark, x):
    names = [f"c{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names)), names


@pytest.mark.parametrize("kind", ["uniform", "grid", "clusters"])
def test_k_nearest_by_all_pairs(spark, kind):
    r = np.random.default_rng(1)
    x = {"uniform": r.random((400, 3)), "grid": np.array([[a, b] for a in range(20) for b in range(20)], float), "clusters": np.vstack([r.normal(0, 1e-3, (200, 2)), r.normal(9, 1, (150, 2)), [[1e6, 0]]])}[kind]
    df, names = table(spark, x)
    got = {}
    for row in Space.of(df, names, "id", rows=50).k_nearest(7).collect():
        got.setdefault(row["first"], {})[row["place"]] = row["near"]
    d2 = S.squared(np.repeat(x, len(x), 0), np.tile(x, (len(x), 1))).reshape(len(x), len(x))
    np.fill_diagonal(d2, np.inf)
    assert {i: [near[k] for k in range(1, 8)] for i, near in got.items()} == {i: [int(j) for j in np.lexsort((np.arange(len(x)), d))[:7]] for i, d in enumerate(d2)}


def test_perplexity():
    d2 = np.vstack([np.random.default_rng(2).random((50, 30)) * 10.0 ** np.arange(-10, 15)[:, None].repeat(2, 0), np.ones((1, 30)), np.zeros((1, 30))])
    p = E.calibrated(d2, 8)
    assert np.allclose(p.sum(1), 1)
    assert np.allclose(np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(1))[:50], 8, atol=1e-5)
    assert np.allclose(p[50:], 1 / 30)  # equal distances have no other perplexity than their number


def exact_descent(x, y, perplexity, iterations, rate=200.0):
    """All pairs of the embedding, affinities to the 3 x perplexity nearest."""
    n, k = len(x), int(3 * perplexity)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, 1, kind="stable")[:, :k]
    p = np.zeros((n, n))
    np.put_along_axis(p, near, E.calibrated(np.take_along_axis(d2, near, 1), perplexity), 1)
    p = (p + p.T) / (2 * n)
    u, g = np.zeros_like(y), np.ones_like(y)
    for it in range(iterations):
        early = it <= iterations // 4
        d = y[:, None] - y[None]
        q = 1 / (1 + (d * d).sum(2))
        np.fill_diagonal(q, 0)
        slope = 4 * (((12 if early else 1) * p - q / q.sum()) * q)[:, :, None] * d
        slope = slope.sum(1)
        g = np.maximum(np.where(np.sign(slope) != np.sign(u), g + 0.2, g * 0.8), 0.01)
        u = (0.5 if early else 0.8) * u - rate * g * slope
        y = y + u
    d = y[:, None] - y[None]
    q = 1 / (1 + (d * d).sum(2))
    np.fill_diagonal(q, 0)
    q /= q.sum()
    return y - y.mean(0), p, float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum())


def start(df, n):
    rows = df.select("id", E.normal(F.col("id"), 0, 0).alias("a"), E.normal(F.col("id"), 0, 1).alias("b")).collect()
    y = np.empty((n, 2))
    for r in rows:
        y[r["id"]] = 1e-4 * r["a"], 1e-4 * r["b"]
    return y


def placed(got, n):
    y = np.full((n, 2), np.nan)
    for r in got.collect():
        y[r["id"]] = (np.nan, np.nan) if r["x"] is None else (r["x"], r["y"])
    return y


def test_all_parts_opened_is_exact(spark):
    x = np.random.default_rng(3).normal(size=(160, 3))
    df, names = table(spark, x)
    want, _, _ = exact_descent(x, start(df, len(x)), 5, 4)
    got = placed(E.tsne(df, names, "id", 5, 4, theta=0, rows=50), len(x))
    assert np.allclose(got, want, rtol=1e-6, atol=1e-9 * np.abs(want).max())


def test_push_is_near_the_exact_one():
    r = np.random.default_rng(4)
    y = np.vstack([r.normal(0, 10, (1500, 2)), r.normal(60, 3, (500, 2)), [[1e4, 0]]])
    d = y[:, None] - y[None]
    q = 1 / (1 + (d * d).sum(2))
    np.fill_diagonal(q, 0)
    want = np.column_stack([(q[:, :, None] ** 2 * d).sum(1), q.sum(1)])
    plane = E.Plane(np.arange(len(y)), np.ones(len(y)), y)
    assert np.allclose(plane.push(y, np.arange(len(y)), 0), want)
    got = plane.push(y, np.arange(len(y)), 0.5)
    assert abs(got[:, 2].sum() / want[:, 2].sum() - 1) < 0.02
    assert np.linalg.norm(got[:, :2] - want[:, :2]) < 0.03 * np.linalg.norm(want[:, :2])
    # blocks of several places: their own place counts once less
    block = np.arange(len(y)) // 4
    centre = np.array([y[block == b].mean(0) for b in range(block[-1] + 1)])
    coarse = E.Plane(np.arange(len(centre)), np.bincount(block), centre).push(centre[:3], np.arange(3), 0)
    whole = np.array([[(np.bincount(block) * k)[j] for j in range(len(centre))] for k in (1 / (1 + ((centre[:3, None] - centre[None]) ** 2).sum(2)))]).sum(1) - 1
    assert np.allclose(coarse[:, 2], whole)


def test_clusters_part_and_the_loss_is_that_of_the_exact_form(spark):
    r = np.random.default_rng(5)
    x = np.vstack([r.normal(c * 8, 1, (50, 4)) for c in range(3)])
    df, names = table(spark, x)
    y, p, want = exact_descent(x, start(df, len(x)), 8, 40, 5.0)
    got = placed(E.tsne(df, names, "id", 8, 40, rate=5, rows=40), len(x))
    d = got[:, None] - got[None]
    q = 1 / (1 + (d * d).sum(2))
    np.fill_diagonal(q, 0)
    q /= q.sum()
    assert float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()) < 1.1 * want + 0.05
    near = np.argsort((d * d).sum(2) + np.diag(np.full(len(x), np.inf)), 1)[:, :5]
    assert (near // 50 == (np.arange(len(x)) // 50)[:, None]).mean() > 0.98


def test_odd_rows(spark):
    x = np.random.default_rng(6).normal(size=(60, 2))
    x[50:] = x[0]
    x[1, 0], x[2, 1] = np.nan, np.inf
    df, names = table(spark, x)
    df = df.withColumn("first", F.lit("clash")).withColumn("leaf", F.lit(1)).withColumn("c0", F.when(F.col("id") != 3, F.col("c0")))
    got = placed(E.tsne(df, names, "id", 5, 4), 60)
    assert np.isnan(got[1:4]).all() and np.isfinite(np.delete(got, [1, 2, 3], 0)).all()
    assert (got[50:] == got[0]).all()
    with pytest.raises(ValueError):
        E.tsne(df.limit(0), names, "id", 5, 4)


def test_query_above_the_exact_form(spark, tmp_path, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal").where("s_suppkey < 60")
    more = rows.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("s_suppkey", F.col("s_suppkey") + 1000 * F.col("copy")).drop("copy")
    more.unionAll(spark.sql("SELECT -1L, 3, CAST(NULL AS DOUBLE)")).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(registry.stats, "tsne", None)  # n x n pairs a round are for small tables only
    got = registry.QUERIES["tsne"](spark, str(tmp_path)).toPandas().set_index("s_suppkey")
    assert len(got) == 2401 and got.loc[-1].isna().all() and got.drop(-1).notna().all().all()
    assert got.drop(-1).groupby(lambda k: k % 1000).nunique().eq(1).all().all() and len(got.drop_duplicates()) == 61


def test_one_task_and_many_go_the_same_way(spark):
    x = np.random.default_rng(7).normal(size=(150, 2))
    df, names = table(spark, x)
    one, many = (placed(E.tsne(df, names, "id", 5, 4, theta=0, rows=r), 150) for r in (1 << 10, 40))
    assert np.allclose(one, many, rtol=1e-6, atol=1e-9 * np.abs(many).max())
