"""kd-tree searches against all pairs: clusters, ties, equal points, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.operators import space as S
from facetlake.operators.space import Boxes, Local, Space, descend, kd_split


def table(spark, x, start=0):
    names = [f"c{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([(start + i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names)), names


def shapes():
    r = np.random.default_rng(0)
    yield "uniform", r.random((900, 2))
    yield "clustered", np.vstack([r.normal(0, 1e-6, (500, 2)), r.normal(5, 0.1, (300, 2)), [[1e6, 1e6]]])
    yield "equal", np.vstack([np.zeros((400, 2)), r.integers(0, 4, (300, 2)).astype(float)])
    yield "line", r.random((500, 1)) ** 8
    yield "three", r.normal(size=(500, 3))
    yield "one", np.array([[1.0, 2.0]])


@pytest.mark.parametrize("name, x", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_searches_by_all_pairs(spark, name, x):
    df, names = table(spark, x)
    asked = np.vstack([x[::3], x[:5] + 0.01])
    q, _ = table(spark, asked, 10_000)
    space = Space.of(df, names, "id", rows=40, second=True)
    d2 = S.squared(np.repeat(asked, len(x), 0), np.tile(x, (len(asked), 1))).reshape(len(asked), len(x))
    # nearest, ties to the least key
    got = {r["id"]: (r["near"], r["distance"]) for r in space.nearest(q, names, "id").collect()}
    assert got == {10_000 + i: (int(np.flatnonzero(d == d.min())[0]), float(np.sqrt(d.min()))) for i, d in enumerate(d2)}
    # nearest other row of the same table
    if len(x) > 1:
        own = S.squared(np.repeat(x, len(x), 0), np.tile(x, (len(x), 1))).reshape(len(x), len(x))
        np.fill_diagonal(own, np.inf)
        got = {r["id"]: (r["near"], r["distance"]) for r in space.nearest(df, names, "id", other=True).collect()}
        assert got == {i: (int(np.flatnonzero(d == d.min())[0]), float(np.sqrt(d.min()))) for i, d in enumerate(own)}
    # radius and box: number of rows and their least key
    r = float(np.sqrt(np.median(d2))) / 2
    got = space.in_radius(q, names, "id", r).groupBy("id").agg(F.sum("n"), F.min("first")).collect()
    assert sorted(map(tuple, got)) == [(10_000 + i, int((d <= r * r).sum()), int(np.flatnonzero(d <= r * r)[0])) for i, d in enumerate(d2) if (d <= r * r).any()]
    lo = q.select("id", *[(F.col(c) - r).alias(f"l{c}") for c in names], *[(F.col(c) + r).alias(f"h{c}") for c in names])
    got = space.in_boxes(lo, [f"l{c}" for c in names], [f"h{c}" for c in names], "id").groupBy("id").agg(F.sum("n")).collect()
    inside = ((x[None] >= (asked - r)[:, None]) & (x[None] <= (asked + r)[:, None])).all(2).sum(1)
    assert sorted(map(tuple, got)) == [(10_000 + i, int(n)) for i, n in enumerate(inside) if n]
    kept = {tuple(v) for v in x}
    assert {r["id"]: r["contained"] for r in space.contains(q, names).collect()} == {10_000 + i: tuple(v) in kept for i, v in enumerate(asked)}


def test_leaves_hold_bounded_numbers_of_distinct_points(spark):
    r = np.random.default_rng(1)
    x = np.vstack([np.zeros((3000, 2)), r.normal(0, 1e-9, (3000, 2)), r.random((500, 2)) * 1e9])
    df, names = table(spark, x)
    space = Space.of(df, names, "id", rows=200)
    sizes = [n["count"] for n in space.points.groupBy("leaf").count().collect()]
    assert sum(sizes) == len(np.unique(x, axis=0)) and max(sizes) <= 600 and len(sizes) > 12


def test_hot_leaf_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERIES", 50)
    x = np.random.default_rng(2).random((300, 2))
    df, names = table(spark, x)
    q, _ = table(spark, np.full((400, 2), 0.5), 1000)
    got = Space.of(df, names, "id", rows=50).nearest(q, names, "id").collect()
    d = ((x - 0.5) ** 2).sum(1)
    assert len(got) == 400 and {r["near"] for r in got} == {int(d.argmin())}


def test_few_boxes_are_looked_into():
    """Four times the clustered points: about four times the pairs of queries and blocks, not sixteen."""
    looked = []
    for n in (5_000, 20_000):
        r = np.random.default_rng(3)
        x = np.vstack([r.normal(k, 1e-3, (n // 5, 2)) for k in range(5)])
        local = Local(x)
        near = np.full(n, np.inf)
        i, p = local.rows(np.arange(n), descend(local.planes, x))
        v = S.squared(x[i], local.x[p])
        v[local.order[p] == i] = np.inf
        np.minimum.at(near, i, v)
        looked.append(len(local.tree.balls(x, near)[0]))
    assert looked[1] < 5 * looked[0] and looked[1] < 20_000 * 20


def test_blocks_cover_all_rows():
    r = np.random.default_rng(0)
    for x in (r.random((1, 2)), r.random((33, 2)), r.random((1000, 3)), np.array([[0.0, k] for k in range(90)] + [[1.0, 0]]), np.array([[min(k, 3.0), float(k > 3) * k] for k in range(100)])):
        x = np.unique(x, axis=0)
        order, starts, planes = kd_split(x, 32)
        assert sorted(order) == list(range(len(x))) and np.diff(np.append(starts, len(x))).max() <= 32
        block = descend(planes, x[order])
        assert (block == np.searchsorted(starts, np.arange(len(x)), "right") - 1).all()
        q, b = Local(x).tree.balls(x, np.full(len(x), np.inf))
        assert len(q) == len(x) * len(starts)
    assert Boxes(np.zeros((3, 1)), np.ones((3, 1))).boxes(np.array([[0.5]]), np.array([[0.6]]))[1].tolist() == [0, 1, 2]


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (None, 5.0, 5.0)], "id long, a double, b double")
    space = Space.of(df, ["a", "b"], "id")
    got = {r["id"]: r["near"] for r in space.nearest(df, ["a", "b"], "id").collect()}
    assert got == {1: 1, None: 1}
    assert space.in_radius(df.limit(0), ["a", "b"], "id", 1.0).count() == 0
    empty = Space.of(df.limit(0), ["a", "b"], "id")
    assert [(r["near"], r["distance"]) for r in empty.nearest(df.where("id = 1"), ["a", "b"], "id").collect()] == [(None, None)]
    assert empty.in_boxes(df, ["a", "b"], ["a", "b"], "id").count() == 0
