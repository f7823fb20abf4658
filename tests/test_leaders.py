"""Leader clustering in rounds against the sequential form."""

import numpy as np
import pytest

from facetlake.operators import leaders
from facetlake.operators.leaders import leader, leader_levels
from facetlake.operators.space import Space


def one_by_one(x, reach):
    heads, out = [], []
    for row in x:
        hit = [n for n, h in enumerate(heads) if ((row >= h - reach) & (row <= h + reach)).all()]
        out.append(hit[0] if hit else len(heads))
        if not hit:
            heads.append(row)
    return out


def shapes():
    r = np.random.default_rng(0)
    yield "uniform", r.random((600, 2)) * 10, [1.0, 1.5]
    yield "sorted", np.sort(r.random((300, 1)) * 30, 0), [1.0]  # each row waits for the one before
    yield "equal", r.integers(0, 6, (400, 2)).astype(float), [2.0, 2.0]  # rows on the edges of boxes
    yield "three", r.normal(size=(300, 3)), [0.8, 0.8, 0.8]
    yield "clusters", np.vstack([r.normal(k, 0.01, (100, 2)) for k in range(4)])[r.permutation(400)], [0.01, 0.01]


@pytest.mark.parametrize("rows", [40, 1 << 14])
@pytest.mark.parametrize("name, x, eps", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_leader(spark, monkeypatch, name, x, eps, rows):
    make = Space.of.__func__
    monkeypatch.setattr(Space, "of", classmethod(lambda cls, df, columns, key, **k: make(cls, df, columns, key, rows=rows)))
    names = [f"c{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["leader"] for r in leader(df, names, "id", eps).collect()}
    assert [got[i] for i in range(len(x))] == one_by_one(x, np.array(eps) / 2)


def test_leader_groups_and_odd_rows(spark):
    rows = [(1, "a", 0.0), (2, "a", 0.4), (3, "b", 0.4), (4, None, 0.4), (5, None, 5.0), (6, "a", None), (7, "b", 9.0), (8, "a", 9.0), (9, "a", float("inf"))]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    assert {r["id"]: r["leader"] for r in leader(df, ["v"], "id", 1.0, "g").collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: None, 7: 1, 8: 1, 9: None}
    assert leader(df.limit(0), ["v"], "id", 1.0).count() == 0


@pytest.mark.parametrize("held", [0, 1 << 17])
@pytest.mark.parametrize("name, x, eps", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_leader_by_first_rows_and_leaves(spark, monkeypatch, name, x, eps, held):
    if held and name == "sorted":
        pytest.skip("as many rounds as below")
    make = Space.of.__func__
    monkeypatch.setattr(Space, "of", classmethod(lambda cls, df, columns, key, **k: make(cls, df, columns, key, rows=100)))
    monkeypatch.setattr(leaders, "FIRST", 30)
    monkeypatch.setattr(leaders, "HELD", held)
    names = [f"c{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["leader"] for r in leader(df, names, "id", eps).collect()}
    assert [got[i] for i in range(len(x))] == one_by_one(x, np.array(eps) / 2)


def test_few_leaders_need_no_tree(spark, monkeypatch):
    x = np.random.default_rng(1).random((3000, 2)) * 4
    monkeypatch.setattr(leaders, "FIRST", 200)
    monkeypatch.setattr(Space, "of", None)  # no row is moved to find its leader
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: (r["level0"], r["level1"]) for r in leader_levels(df, ["a", "b"], "id", 2.0, 0.5, 2).collect()}
    top = np.array(one_by_one(x, 1.0))
    want = {}
    for n in range(top.max() + 1):
        at = np.flatnonzero(top == n)
        want |= {int(i): (n, k) for i, k in zip(at, one_by_one(x[at], 0.5))}
    assert got == want
