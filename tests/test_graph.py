"""Staged derivation graphs: values, stages, layouts and odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.plans.graph import Graph
from facetlake.registry_whole import TRADE, trade

SF = "/root/testdata/sf0.001"


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan parquet", plan))


def test_one_scan_per_stage_and_table(spark):
    aggregates = []
    layouts = trade(spark, SF)
    TRADE.run(layouts, ["scaled"], aggregates)
    numbers = [a for a in aggregates if "_of" not in a.columns]
    # found bounds of two layouts in stage 1, of the last sum in stage 3; both reductions by nation in stages 1 and 2
    assert len(numbers) == 3 and len(aggregates) == 5
    assert [scans(a) for a in numbers[:2]] == [1, 1]
    first = numbers[0]._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in first and "l_extendedprice" not in first  # columns are pruned at the scan


def test_numbers_of_a_stage_come_from_one_aggregate(spark):
    df = spark.range(100).select("id", *[(F.col("id") * k % 17).cast("double").alias(f"v{k}") for k in range(1, 6)])
    g = Graph()
    for k in range(1, 6):
        g.add(f"n{k}", "normalization", f"v{k}").add(f"m{k}", "square", f"n{k}")
    g.add("all", "sum", *[f"m{k}" for k in range(1, 6)]).add("p", "pca", "n1", "n2", "n3", k=2).add("out", "sum", "all", "p0", "p1")
    aggregates = []
    rows = g.run({("id",): df}, ["out"], aggregates).orderBy("id").collect()
    assert len(aggregates) == 2  # five pairs of bounds, then the moments of three columns
    v = np.array([[i * k % 17 for k in range(1, 6)] for i in range(100)], float)
    n = (v - v.min(0)) / (v.max(0) - v.min(0))
    x = n[:, :3] - n[:, :3].mean(0)
    w, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, np.argsort(-w)].T
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose([r["out"] for r in rows], (n**2).sum(1) + (x @ axes[:2].T).sum(1))


def test_layouts_repeat_and_keep_every_row(spark):
    a = spark.createDataFrame([(x, y, float(10 * x + y)) for x in range(3) for y in range(2)], "x long, y long, v double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "x long, w double")  # no coordinate 2
    k = spark.createDataFrame([(100.0,)], "k double")
    g = Graph().add("s", "plus", "v", "w").add("t", "plus", "s", "k").add("u", "plus", "w", "k")
    got = {(r["x"], r["y"]): (r["t"], r["u"]) for r in g.run({("x", "y"): a, ("x",): b, (): k}, ["t", "u"]).collect()}
    assert got == {(x, y): (10 * x + y + x + 101.0, x + 101.0) if x < 2 else (None, None) for x in range(3) for y in range(2)}
    # two layouts without a common dimension: the product, once
    d = spark.createDataFrame([(5, 1.0), (6, 2.0), (7, 3.0)], "z long, q double")
    got = Graph().add("m", "multiplication", "w", "q").run({("x",): b, ("z",): d}, ["m"]).collect()
    assert sorted((r["x"], r["z"], r["m"]) for r in got) == [(x, z, (x + 1.0) * (z - 4.0)) for x in range(2) for z in (5, 6, 7)]


def test_groups_with_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.5, 2.0), (2, 1.2, 4.0), (3, None, 8.0), (4, None, None), (5, 2.0, None)], "id long, g double, v double")
    g = Graph().add("s", "reduction", "v", "g", how="sum").add("n", "normalization", "v").add("r", "rank", "v")
    got = {r["id"]: (r["s"], r["n"], r["r"]) for r in g.run({("id",): df}, ["s", "n", "r"]).collect()}
    assert got == {1: (6.0, 0.0, 0), 2: (6.0, 1 / 3, 1), 3: (8.0, 1.0, 2), 4: (8.0, None, None), 5: (None, None, None)}
    assert g.run({("id",): df.limit(0)}, ["s", "n", "r"]).count() == 0


def test_clusters_and_derivative_within_a_graph(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 1.0, 2.0, 50.0, 51.0, 52.0, 100.0])], "id long, v double")
    g = Graph().add("n", "normalization", "v").add("c", "dbscan", "n", eps=0.021, min_points=3).add("k", "kmeans", "n", k=2, seed=1).add("d", "derivative", "n", dim="id", kind="forward").add("top", "reduction", "n", "c", how="max")
    got = g.run({("id",): df}, ["c", "k", "d", "top"]).orderBy("id").collect()
    assert [r["c"] for r in got] == [1, 1, 1, 2, 2, 2, -1]
    assert [round(r["top"], 2) for r in got] == [0.02] * 3 + [0.52] * 3 + [1.0]
    assert [round(r["d"], 2) for r in got] == [0.01, 0.01, 0.48, 0.01, 0.01, 0.48, 0.0]
    assert len({r["k"] for r in got[:3]}) == 1


def test_wrong_graphs_raise(spark):
    df = spark.range(3).select("id", F.col("id").cast("double").alias("v"))
    with pytest.raises(ValueError):
        Graph().add("n", "normalization", 3)
    with pytest.raises(ValueError):
        Graph().add("n", "normalization", "v").apply(df, ["n"])
    with pytest.raises(KeyError):
        Graph().add("n", "normalization", "w").run({("id",): df}, ["n"])
    with pytest.raises(ValueError):
        Graph().add("v", "square", "v").run({("id",): df}, ["v"])
    with pytest.raises(ValueError):
        Graph().add("a", "rank", "b").add("b", "negate", "a").run({("id",): df}, ["a"])
