"""Operators without SQL, and odd rows: nulls, empty tables, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.operators import histogram as H, lists, ranks, stats
from facetlake.sources import dataset


def brute_tau(x, y):
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
    return s / (n * (n - 1) / 2)


@pytest.mark.parametrize("rows", [1 << 20, 40])
def test_kendall_by_ranges(spark, rows):
    r = np.random.default_rng(1)
    x, y = r.integers(0, 25, 300), r.integers(0, 90, 300)
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1), (2, None)], "a int, b int")
    assert stats.kendall(df, "a", "b", rows).first()[0] == pytest.approx(brute_tau(x, y))


def test_kendall_of_few_rows(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert stats.kendall(df, "a", "b").first()[0] is None
    assert stats.kendall(df.where("false"), "a", "b").first()[0] is None


def test_nearest_flagged_is_exact(spark):
    r = np.random.default_rng(2)
    p = np.concatenate([r.normal(0, 1, (150, 2)), r.normal(500, 0.01, (50, 2))])
    flags = r.random(200) < 0.2
    flags[150:] = False  # far from every flagged row
    rows = [(i, float(a), float(b), bool(f)) for i, ((a, b), f) in enumerate(zip(p, flags))]
    df = spark.createDataFrame([*rows, (200, None, 1.0, True)], "k long, x double, y double, f boolean")
    got = {r.k: r.distance for r in stats.nearest_flagged(df, ["x", "y"], "k", F.col("f")).collect()}
    d = np.sqrt(((p[:, None] - p[None][:, flags]) ** 2).sum(2)).min(1)
    assert got.pop(200) is None
    assert [got[i] for i in range(200)] == pytest.approx(d.tolist())
    assert stats.nearest_flagged(df, ["x", "y"], "k", F.lit(False)).where("distance is not null").count() == 0


def test_dbscan_on_a_long_chain(spark):
    """A chain that needs many rounds, and rows apart from it."""
    xs = [float(i) for i in range(400)] + [1000.0, 1000.5, 1001.0, 2000.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k long, x double")
    got = {r.k: r.cluster for r in stats.dbscan(df, ["x"], "k", 1.0, 2).collect()}
    assert {got[i] for i in range(400)} == {1} and {got[400], got[401], got[402]} == {2} and got[403] == -1


def test_ranks_keep_null_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (1.0,)], "v double")
    assert sorted(map(tuple, ranks.dense_rank(df, "v").collect()), key=repr) == [(1.0, 0), (1.0, 0), (3.0, 1), (None, None)]
    assert ranks.linearize(df, "v").count() == 4
    assert ranks.dense_rank(df.where("false"), "v").count() == 0


def test_derivative_by_place(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(4)], "k int, v double")
    got = {r.k: r.d for r in stats.derivative(df, "v", "k").collect()}
    assert got == {0: 0.5, 1: 2.0, 2: 4.0, 3: 2.5}


def test_initial_centres(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(70)], "k long, x double, y double")
    for how in ("forgy", "plusplus"):
        found = stats.initial_centres(df, ["x", "y"], "k", 5, how, 3)
        assert len({tuple(c) for c in found}) == 5 and all(c[0] == c[1] % 7 for c in found)
    for how in ("uniform", "normal"):
        assert stats.initial_centres(df, ["x", "y"], "k", 5, how, 3) == stats.initial_centres(df, ["x", "y"], "k", 5, how, 3)
    assert stats.initial_centres(df.where("k < 2"), ["x", "y"], "k", 5, "plusplus") != []


def test_fracture_borders(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (0.9, 0.5), (1.0, 0.4), (None, 1.0)], "x double, y double")
    static = {r.box: r for r in lists.fractures(df, ["x", "y"], 1).collect()}
    assert (static["r0"].lo_x, static["r0"].hi_x) == (0.1, 0.55) and static["r1"].n == 2
    outer = {r.box: r for r in lists.fractures(df, ["x", "y"], 1, "outer").collect()}
    assert (outer["r1"].lo_x, outer["r1"].lo_y, outer["r1"].hi_y) == (0.55, 0.4, 0.5)
    both = {r.box: r for r in lists.fractures(df, ["x", "y"], 1, "both").collect()}
    assert both["r1"].lo_x == 0.9
    assert {r.box for r in lists.fractures(df, ["x", "y"], 3, least=5).collect()} == {"r"}


def test_tracker_makes_again_what_changed():
    t, made = lists.Tracker(), []
    for _ in range(2):
        t.get("bins", ["data"], lambda: made.append("bins"))
        t.get("smooth", ["bins"], lambda: made.append("smooth"))
    assert made == ["bins", "smooth"]
    t.changed("data")
    t.get("bins", ["data"], lambda: made.append("bins"))
    assert t.stale("smooth", ["bins"]) and made == ["bins", "smooth", "bins"]


def test_axis_order():
    assert lists.moved(["a", "b", "c"], "a", "c") == ["c", "b", "a"]
    assert lists.shifted(["a", "b", "c"], "a", 1) == ["b", "a", "c"] and lists.shifted(["a", "b", "c"], "c", -9) == ["c", "a", "b"]


def test_sides():
    assert H.sides({("a", "b"): 3, ("a", "c"): 9, ("b", "d"): 1, ("c", "d"): 8}) == [("a", "c"), ("b", "d")]


def test_netcdf_table_slices_and_names(spark, tmp_path):
    v = np.arange(12, dtype=np.int32).reshape(2, 3, 2)
    raw = dataset.netcdf_bytes({"t": 2, "y": 3, "x": 2}, {"v": (["t", "y", "x"], v, {"scale_factor": 2.0}), "y": (["y"], np.array([5.0, 6.0, 7.0]), {})})
    (tmp_path / "a.nc").write_bytes(raw)
    got = sorted((r.y_index, r.x, r.v, r.y) for r in dataset.read_netcdf_table(spark, str(tmp_path), {"t": 1}).collect())
    assert got == [(i, j, float(v[1, i, j] * 2), 5.0 + i) for i in range(3) for j in range(2)]


def test_open_by_path(spark, tmp_path):
    with pytest.raises(ValueError):
        dataset.read(spark, str(tmp_path / "a.xyz"))
    (tmp_path / "a.csv").write_text("longitude,b\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("longitude,c\n1,2\n")
    assert dataset.read(spark, str(tmp_path / "a.csv"), "lon").columns == ["lon"]
    with pytest.raises(ValueError):
        dataset.analyse(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])


@pytest.mark.parametrize("kind", ["5/3", "9/7"])
def test_lifted_equals_the_array_form(spark, kind):
    from facetlake.operators import codec

    r = np.random.default_rng(4)
    groups = {g: r.normal(0, 10, g) for g in range(1, 8)}
    df = spark.createDataFrame([(g, i, float(v)) for g, x in groups.items() for i, v in enumerate(x)], "g int, k int, v double")
    got = codec.lifted(df, "k", "v", "g", kind).toPandas().sort_values(["g", "pos"])
    for g, x in groups.items():
        own = got[got.g == g].w.to_numpy()
        assert np.allclose(own, codec.dwt(x, kind)) and np.allclose(codec.idwt(own, kind), x)


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "float", "double"])
def test_sorting_is_an_ordered_permutation(spark, kind):
    """Values ascend through the places, ids are a permutation, negative values and ties included."""
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(r.integers(-100, 100, 150))], "id long, v int").select("id", F.col("v").cast(kind).alias("v"))
    got = ranks.position(df, "v", "id").orderBy("pos").collect()
    assert [x.pos for x in got] == list(range(150))
    assert sorted(x.id for x in got) == list(range(150))
    assert [(x.v, x.id) for x in got] == sorted((x.v, x.id) for x in got)


def test_nearest_among_uniform_points(spark):
    """No row is closer than the one that the search names, whatever part of the rows is flagged."""
    r = np.random.default_rng(5)
    p = r.random((100, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "k long, x double, y double")
    for share in (1, 3, 50):
        got = {x.k: x.distance for x in stats.nearest_flagged(df, ["x", "y"], "k", F.col("k") % share == 0).collect()}
        d = np.sqrt(((p[:, None] - p[None, ::share]) ** 2).sum(2)).min(1)
        assert [got[i] for i in range(100)] == pytest.approx(d.tolist(), abs=1e-12)


def test_kendall_with_frequent_values(spark):
    """Values with most of the rows lie in ranges of their own, which no task has to go through."""
    r = np.random.default_rng(5)
    x = np.where(r.random(900) < 0.6, 3.0, r.integers(0, 9, 900))
    y = np.where(r.random(900) < 0.5, 1.0, r.normal(size=900).round(2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    want = (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / (900 * 899)
    for rows in (20, 100, 1 << 20):
        assert abs(stats.kendall(df, "x", "y", rows).first()[0] - want) < 1e-12
    assert stats.range_of.__doc__ and stats.kendall(df.limit(0), "x", "y").first()[0] is None
