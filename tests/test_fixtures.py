"""Small tables with answers by hand, round trips and invariants."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.functions import brush as B
from facetlake.functions import nodes as N
from facetlake.operators import codec, histogram as H, ranks, stats
from facetlake.plans.graph import Graph
from facetlake.sources import tables


def column(spark, values, name="v"):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"id long, {name} double")


def test_binning_folds_outliers(spark):
    got = {r["bin"]: r["n"] for r in H.hist(column(spark, [-1, 0, 2.5, 5, 9.99, 10, 12]), [("v", 0.0, 10.0, 4)]).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 3}


def test_splits(spark):
    df = column(spark, range(5))
    assert [r[0] for r in df.orderBy("id").select(B.uniform_bin(F.col("v"), 0, 4, 3)).collect()] == [0, 1, 1, 2, 2]
    assert [r[0] for r in column(spark, [0, 5, 10]).orderBy("id").select(B.value_bin(F.col("v"), [0, 5, 10])).collect()] == [1, 2, 2]
    sizes = {r["list"]: r["n"] for r in ranks.quantile_split(df, "v", "id", [0, 0.5, 1]).groupBy("list").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 2, 1: 3}


def test_rank_derivative_reduction(spark):
    assert {r["id"]: r["rank"] for r in ranks.dense_rank(column(spark, [3, 1, 3, 2]), "v").collect()} == {0: 2, 1: 0, 2: 2, 3: 1}
    d = column(spark, [0, 1, 4, 9]).select("id", N.derivative("v", "id", []).alias("d")).orderBy("id")
    assert [r["d"] for r in d.collect()] == [0.5, 2, 4, 2.5]
    g = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "g long, v double").select("g", N.reduction(F.col("v"), ["g"], "stddev").alias("s"), N.reduction(F.col("v"), ["g"], "avg").alias("a"))
    assert sorted(map(tuple, g.collect())) == [(0, 1.0, 2.0), (0, 1.0, 2.0), (1, 0.0, 5.0)]


def test_lasso_and_brush_modes(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "x double, y double")
    assert [r[0] for r in df.select(B.in_lasso("x", "y", [(0, 0), (4, 0), (0, 4)])).collect()] == [True, False]
    none = B.combine([B.Brush({"x": [(9, 10)]}), B.Brush({"y": [(9, 10)]})], "or")
    assert df.where(none).count() == 0 and df.where(B.combine([])).count() == 2


def test_kendall_chi_square_categories(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "x double, y double")
    assert stats.kendall(df, "x", "y").first()[0] == pytest.approx(1 / 3)
    hist = lambda v: spark.createDataFrame(list(enumerate(v)), "bin long, n long")
    assert H.chi_square(hist([2, 2]), hist([1, 3])).first()[0] == pytest.approx((1 / 3 + 1 / 5) / 4 / 2)
    s = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c"), (3, "a")], "id long, s string")
    assert {r["id"]: r["code"] for r in tables.category_codes(s, "s", "code").collect()} == {0: 1, 1: 0, 2: 2, 3: 0}


def test_codecs(spark):
    q = spark.createDataFrame([(-0.26,), (0.24,), (0.26,)], "v double").select(codec.quantize(F.col("v"), 0.5).alias("q")).withColumn("s", codec.zigzag(F.col("q"))).withColumn("back", codec.unzigzag(F.col("s")))
    assert [tuple(r) for r in q.collect()] == [(-1, 1, -1), (0, 0, 0), (1, 2, 1)]
    z = spark.createDataFrame([(0, i, s) for i, s in enumerate([0, 0, 5, 0, 7, 0])], "g long, i long, s long")
    assert [(r["s"], r["zeros"]) for r in codec.zero_runs(z, "i", "s", "g").orderBy("i").collect()] == [(5, 2), (7, 1)]
    for kind in codec.LIFTS:
        for n in (0, 1, 2, 3, 8, 33):
            x = np.random.default_rng(n).normal(size=n)
            assert np.allclose(codec.idwt(codec.dwt(x, kind), kind), x)


def test_graph(spark):
    df = column(spark, [1, 2])
    g = Graph().add("a", "square", "v").add("b", "plus", "a", 1)
    assert [r["b"] for r in g.apply(df, ["b"]).orderBy("id").collect()] == [2.0, 5.0]
    with pytest.raises(ValueError):
        Graph().add("a", "negate", "b").add("b", "negate", "a").apply(df, ["a"])
    with pytest.raises(KeyError):
        Graph().add("a", "no such", "v")


def test_clusters(spark):
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    for linkage in ("single", "complete", "average", "weighted", "ward", "centroid", "median"):
        assert list(stats.hierarchical(x, 3, linkage)) == [0, 0, 1, 1, 2]
    df = column(spark, [0, 0.1, 0.2, 5, 9, 9.1, 9.2])
    assert {r["id"]: r["cluster"] for r in stats.dbscan(df, ["v"], "id", 0.3, 2).collect()} == {0: 1, 1: 1, 2: 1, 3: -1, 4: 2, 5: 2, 6: 2}
    with pytest.raises(ValueError):
        stats.tsne(np.zeros((5, 2)), perplexity=30)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x, s\r\n1,b\r\n ,a\r\n3,\"7\"\r\n")
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "a.csv")).collect())) == [(0.0, 1), (1.0, 2), (3.0, 0)]


def test_columns_round_trip(spark, tmp_path):
    df = column(spark, [1, 2, 4]).select("v")
    tables.write_columns(df, str(tmp_path / "c"))
    assert sorted(r[0] for r in tables.read_columns(spark, str(tmp_path / "c")).collect()) == pytest.approx([1, 2, 4])


def test_netcdf(spark, tmp_path):
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">I", 0) + struct.pack(">II", 10, 2) + name("x") + struct.pack(">I", 2) + name("y") + struct.pack(">I", 3) + struct.pack(">II", 0, 0)
    attrs = struct.pack(">II", 12, 1) + name("_FillValue") + struct.pack(">II", 4, 1) + struct.pack(">i", -9)
    var = lambda begin: struct.pack(">II", 11, 1) + name("t") + struct.pack(">I", 2) + struct.pack(">II", 0, 1) + attrs + struct.pack(">III", 4, 24, begin)
    raw = head + var(len(head + var(0))) + np.array([0, 1, 2, 10, -9, 12], ">i4").tobytes()
    (tmp_path / "a.nc").write_bytes(raw)
    got = sorted((tuple(r["dims"]), r["value"]) for r in tables.read_netcdf(spark, str(tmp_path), "t").collect())
    assert got == [((0, 0), 0.0), ((0, 1), 1.0), ((0, 2), 2.0), ((1, 0), 10.0), ((1, 1), None), ((1, 2), 12.0)]
    assert tables.files(spark, str(tmp_path), ".*a.*").count() == 1
