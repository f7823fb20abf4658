"""Spanning trees, single linkage and density clusters against sequential forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.operators import linkage as L
from facetlake.operators import space as S
from facetlake.operators.linkage import Local, components, core_points, dbscan, inside, single_linkage, spanning_tree
from facetlake.operators.space import Space


def table(spark, x):
    names = [f"c{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names)), names


def distances(x):
    return S.squared(np.repeat(x, len(x), 0), np.tile(x, (len(x), 1))).reshape(len(x), len(x))


def kruskal(x):
    """Tree edges among the first rows of distinct points, by length and then by both numbers."""
    first = sorted(np.unique(x, axis=0, return_index=True)[1])
    d = distances(x)
    root = {i: i for i in first}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    edges = []
    for v, a, b in sorted((d[a, b], a, b) for k, a in enumerate(first) for b in first[k + 1 :]):
        if find(a) != find(b):
            root[find(b)] = find(a)
            edges.append((int(a), int(b), float(np.sqrt(v))))
    return edges


def slow_dbscan(x, eps, least):
    near = distances(x) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        hit = np.flatnonzero(near[i] & core)
        label[i] = label[hit].min() if len(hit) else -1
    names = {v: k + 1 for k, v in enumerate(sorted(set(label[core])))} | {-1: -1}
    return [names[v] for v in label]


def shapes():
    r = np.random.default_rng(0)
    yield "uniform", r.random((300, 2))
    yield "clusters", np.vstack([r.normal(k, 0.02, (80, 2)) for k in range(4)])
    yield "grid", np.array([[i % 15, i // 15] for i in range(225)], float)  # ties everywhere
    yield "equal", np.vstack([np.zeros((60, 2)), r.integers(0, 5, (150, 2)).astype(float)])
    yield "line", np.sort(r.random((200, 1)), 0)


def small(monkeypatch, rows):
    make = Space.of.__func__
    monkeypatch.setattr(Space, "of", classmethod(lambda cls, df, columns, key, **k: make(cls, df, columns, key, rows=rows)))


@pytest.mark.parametrize("rows", [25, 1 << 14])
@pytest.mark.parametrize("name, x", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_spanning_tree(spark, monkeypatch, name, x, rows):
    small(monkeypatch, rows)
    df, names = table(spark, x)
    assert sorted(map(tuple, spanning_tree(df, names, "id").collect())) == sorted(kruskal(x))


def test_single_linkage(spark, monkeypatch):
    small(monkeypatch, 30)
    x = np.vstack([np.random.default_rng(1).normal(k * 3, 0.1, (40, 2)) for k in range(3)] + [[[50.0, 50.0], [50.0, 50.0]]])
    df, names = table(spark, x)
    want = [k for k in range(3) for _ in range(40)] + [3, 3]
    for how in ({"k": 4}, {"cut": 2.0}):
        got = {r["id"]: r["cluster"] for r in single_linkage(df, names, "id", **how).collect()}
        assert [got[i] for i in range(len(x))] == want
    assert {r["cluster"] for r in single_linkage(df, names, "id", k=1).collect()} == {0}
    odd = spark.createDataFrame([(1, 0.0), (2, None), (3, 5.0)], "id long, v double")
    assert {r["id"]: r["cluster"] for r in single_linkage(odd, ["v"], "id", cut=1.0).collect()} == {1: 0, 2: None, 3: 1}
    assert single_linkage(odd.limit(0), ["v"], "id", k=2).count() == 0
    with pytest.raises(ValueError):
        single_linkage(odd, ["v"], "id")


@pytest.mark.parametrize("rows", [25, 1 << 14])
@pytest.mark.parametrize("name, x", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_dbscan(spark, monkeypatch, name, x, rows):
    small(monkeypatch, rows)
    df, names = table(spark, x)
    eps, least = {"uniform": (0.05, 4), "clusters": (0.01, 5), "grid": (1.0, 5), "equal": (0.5, 7), "line": (0.006, 4)}[name]
    got = {r["id"]: r["cluster"] for r in dbscan(df, names, "id", eps, least).collect()}
    want = slow_dbscan(x, eps, least)
    assert [got[i] for i in range(len(x))] == want and len(set(want)) > 1


def test_dbscan_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.1), (3, None), (4, float("nan")), (5, 9.0)], "id long, v double")
    assert {r["id"]: r["cluster"] for r in dbscan(df, ["v"], "id", 0.5, 2).collect()} == {1: 1, 2: 1, 3: -1, 4: -1, 5: -1}
    assert {r["cluster"] for r in dbscan(df, ["v"], "id", 0.5, 9).collect()} == {-1}
    assert dbscan(df.limit(0), ["v"], "id", 0.5, 2).count() == 0


def test_core_points_stop_early(spark, monkeypatch):
    """A crowd within eps is not counted through: each point looks into few blocks."""
    seen = []
    rows = Local.rows
    monkeypatch.setattr(Local, "rows", lambda self, q, b: seen.append(len(q)) or rows(self, q, b))
    x = np.random.default_rng(2).random((3000, 2))
    local = Local(x)
    df, names = table(spark, x)
    assert core_points(Space.of(df, names, "id"), 5.0, 10).count() == 3000
    comp, edges = inside(local, np.arange(3000), np.full(3000, np.inf), np.arange(3000), S.FAR)
    assert len(set(comp)) == 1 and sum(len(e[0]) for e in edges) == 2999
    assert sum(seen) < 3000 * 200  # of 3000 x 160 blocks a round


@pytest.mark.parametrize("few", [0, 5, 1 << 16])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW", few)
    r = np.random.default_rng(3)
    path = r.permutation(200)
    pairs = [(int(a), int(b)) for a, b in zip(path[:-1], path[1:])] + [(1000 + int(a), 1000 + int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(5000, 5000)] + [(7000, 7001 + k) for k in range(50)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r["node"]: r["label"] for r in components(edges).collect()} == {v: find(v) for v in root}
