"""Correlation, covariance, projections and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import difference
from .leaders import leader, leader_levels  # noqa: F401
from .lineage import checkpointed
from .linkage import dbscan, single_linkage, spanning_tree  # noqa: F401
from .ranks import neighbours, position
from .space import Space


def pearson(df: DataFrame, base: str, others: list[str]) -> DataFrame:
    """attribute, r: one pass for all attributes."""
    row = df.agg(*[F.corr(base, o).alias(o) for o in others])
    return row.select(F.expr(f"stack({len(others)}, " + ", ".join(f"'{o}', `{o}`" for o in others) + ") as (attribute, r)"))


def spearman(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Pearson of ordinal ranks, ties by key."""
    ra = position(df.select(key, a), a, key, name="ra").select(key, "ra")
    rb = position(df.select(key, b), b, key, name="rb").select(key, "rb")
    return ra.join(rb, key).agg(F.corr("ra", "rb").alias("r"))


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs of sign(dx) sign(dy) times both weights, in n log n: ties count zero."""
    if len(x) < 2:
        return 0.0
    y = np.unique(y, return_inverse=True)[1]
    total = 0.0
    for turned in (1, -1):  # rows of one x ascend in y, then descend: their pairs cancel
        order = np.lexsort((turned * y, x))
        ys, ws = y[order], w[order].astype(float)
        for bit in range(int(ys.max()).bit_length()):  # two values differ first at one bit
            group = ys >> (bit + 1)
            at = np.argsort(group, kind="stable")
            one, g, v = (ys[at] >> bit) & 1, group[at], ws[at]
            first = np.flatnonzero(np.append(True, np.diff(g) != 0))
            zeros, ones = np.cumsum(v * (1 - one)), np.cumsum(v * one)
            size = np.diff(np.append(first, len(g)))
            base0, base1 = np.repeat(zeros[first] - (v * (1 - one))[first], size), np.repeat(ones[first] - (v * one)[first], size)
            total += (v * one * (zeros - base0)).sum() - (v * (1 - one) * (ones - base1)).sum()
    return total / 2


def range_of(column: str, cuts: list[float]) -> Column:
    """Order-preserving number of a value's range: even between cuts, odd at a cut, so that a frequent value lies alone."""
    at = np.array(cuts, float)

    @F.pandas_udf("long")
    def number(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, v.to_numpy(), "left") + np.searchsorted(at, v.to_numpy(), "right"))

    return number(column)


def kendall(df: DataFrame, a: str, b: str, rows: int = 1 << 20) -> DataFrame:
    """Tau-a, ties counting zero, without a join of pairs.

    Both attributes are cut into ranges of about ``rows`` distinct pairs (at most 1024 ranges).  Pairs in one range of a are
    counted there; pairs of different ranges of a in one range of b are counted there, by range of a; all others by the
    grid of ranges.  A range of a single value has no pair to count and is passed by, however many rows it holds.
    Rows with a null in either attribute are left out.
    """
    g = checkpointed(df.groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n")).where("x is not null and y is not null"))
    total = g.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    parts = min(1024, max(1, -(-total["cells"] // rows)))
    cuts = [sorted(set(c)) for c in g.approxQuantile(["x", "y"], [k / parts for k in range(1, parts)], 0.2 / parts)] if parts > 1 else [[], []]
    g = g.withColumn("i", range_of("x", cuts[0])).withColumn("j", range_of("y", cuts[1]))
    g = checkpointed(g) if parts > 1 else g

    def sums(part: DataFrame, by: str, x: str, y: str) -> DataFrame:
        run = lambda p: pd.DataFrame({"s": [concordance(p["u"].to_numpy(), p["v"].to_numpy(), p["n"].to_numpy())]})
        return part.select(F.col(by).alias("k"), F.col(x).cast("double").alias("u"), F.col(y).cast("double").alias("v"), "n").groupBy("k").applyInPandas(run, "s double")

    grid = g.groupBy("i", "j").agg(F.sum("n").alias("n")).withColumn("one", F.lit(0))
    if parts > 1:
        s = sums(g.where("i % 2 = 0"), "i", "x", "y").unionAll(sums(g.where("j % 2 = 0"), "j", "i", "y")).unionAll(sums(grid, "one", "i", "j"))
    else:
        s = sums(g, "i", "x", "y")
    pairs = total["n"] * (total["n"] - 1) / 2
    return s.agg((F.coalesce(F.sum("s"), F.lit(0.0)) / F.lit(float(pairs) if pairs else None).cast("double")).alias("tau"))


def derivative(df: DataFrame, value: str, dim: str, kind: str = "central", h: float = 1.0, name: str = "d") -> DataFrame:
    """Adds the derivative along a whole table's unique ``dim``: neighbours meet by place, not in one task's window."""
    near = neighbours(df, value, dim)
    return near.withColumn(name, difference(F.col(value), F.col("_before"), F.col("_after"), kind, h)).drop("_pos", "_before", "_after")


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, cov for all pairs, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.expr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs) + ") as (a, b, cov)"))


def principal_axes(m: np.ndarray) -> tuple[list[list[float]], list[float]]:
    """(axes, variances) of a covariance matrix, largest first, the largest loading of each positive."""
    values, axes = np.linalg.eigh(m)
    order = np.argsort(-values)
    axes = axes[:, order].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return axes.tolist(), [float(v) for v in values[order]]


def gaussian(df: DataFrame, columns: list[str]) -> tuple[list[float], list[list[float]], list[float]]:
    """(mean, principal axes, variances): a k x k matrix on the driver."""
    mean = list(df.agg(*[F.avg(c) for c in columns]).first())
    m = np.zeros((len(columns), len(columns)))
    for r in covariance(df, columns).collect():
        i, j = columns.index(r["a"]), columns.index(r["b"])
        m[i, j] = m[j, i] = r["cov"]
    axes, values = principal_axes(m)
    return [float(x) for x in mean], axes, values


def correlation_matrix(df: DataFrame, columns: list[str], lists: str | None = None) -> DataFrame:
    """(list,) a, b, r of all pairs of attributes, for one or several lists at once."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = (df.groupBy(lists) if lists else df.groupBy()).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(*([lists] if lists else []), F.expr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs) + ") as (a, b, r)"))


def inverse_covariance(df: DataFrame, columns: list[str]) -> tuple[DataFrame, float]:
    """(a, b, value of the inverse for all ordered pairs), determinant: a k x k matrix on the driver; a singular one raises."""
    m = np.zeros((len(columns), len(columns)))
    for r in covariance(df, columns).collect():
        i, j = columns.index(r["a"]), columns.index(r["b"])
        m[i, j] = m[j, i] = r["cov"]
    inv = np.linalg.inv(m)
    rows = [(a, b, float(inv[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, value double"), float(np.linalg.det(m))


def geometric_median(df: DataFrame, columns: list[str], rounds: int = 20) -> list[float]:
    """Weiszfeld rounds from the mean; rows at the present point are left out of a round."""
    at = list(df.agg(*[F.avg(c) for c in columns]).first())
    for _ in range(rounds):
        d = F.sqrt(sum(((F.col(c) - x) * (F.col(c) - x) for c, x in zip(columns, at)), F.lit(0.0)))
        r = df.withColumn("_d", d).where("_d > 0").agg(F.sum(1 / F.col("_d")).alias("w"), *[F.sum(F.col(c) / F.col("_d")).alias(f"s{n}") for n, c in enumerate(columns)]).first()
        if not r["w"]:
            break
        at = [r[f"s{n}"] / r["w"] for n in range(len(columns))]
    return at


def initial_centres(df: DataFrame, columns: list[str], key: str, k: int, how: str = "forgy", seed: int = 0) -> list[list[float]]:
    """Starting centres: k rows (``forgy``), draws in the bounds (``uniform``) or from the normal distribution of each
    column (``normal``), or rows drawn with odds as their squared distance to the centres so far (``plusplus``).

    Rows are drawn by the least exponential draw of an MD5 of their key, so a seed gives the same rows in any engine.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).dropna().withColumn("_e", -F.log(u))
    if how == "forgy":
        return [[r[c] for c in columns] for r in rows.orderBy("_e", key).limit(k).collect()]
    if how in ("uniform", "normal"):
        draw = np.random.default_rng(seed)
        b = rows.agg(*[x for c in columns for x in (F.min(c), F.max(c), F.avg(c), F.stddev_pop(c))]).first()
        cell = lambda n: draw.uniform(b[4 * n], b[4 * n + 1]) if how == "uniform" else draw.normal(b[4 * n + 2], b[4 * n + 3])
        return [[float(cell(n)) for n in range(len(columns))] for _ in range(k)]
    if how != "plusplus":
        raise ValueError(how)
    centres: list[list[float]] = []
    while len(centres) < k:
        d = [sum(((F.col(c) - x) * (F.col(c) - x) for c, x in zip(columns, centre)), F.lit(0.0)) for centre in centres]
        odds = F.lit(1.0) if not d else d[0] if len(d) == 1 else F.least(*d)
        r = rows.withColumn("_o", odds).where("_o > 0").orderBy(F.col("_e") / F.col("_o"), key).limit(1).collect()
        if not r:
            break  # fewer distinct rows than centres
        centres.append([r[0][c] for c in columns])
    return centres


def pca(df: DataFrame, columns: list[str], k: int, scaled: bool = False) -> DataFrame:
    """Adds pc0..pc(k-1): centred scores, the largest loading of each axis positive.

    ``scaled`` divides the centred columns by the largest absolute value among all of them.
    """
    mean, axes, _ = gaussian(df, columns)
    by = 1.0
    if scaled:
        by = df.agg(F.greatest(F.lit(0.0), *[F.max(F.abs(F.col(c) - m)) for c, m in zip(columns, mean)])).first()[0] or 1.0
    scores = {f"pc{n}": sum((F.lit(float(w) / by) * (F.col(c) - F.lit(m)) for w, c, m in zip(axis, columns, mean)), F.lit(0.0)) for n, axis in enumerate(axes[:k])}
    return df.withColumns(scores)


def pca_unit(df: DataFrame, columns: list[str], k: int, eps: float = 1e-6) -> DataFrame:
    """Adds pc0..pc(k-1) in [0, 1]: columns centred and divided by their extent plus ``eps``, scores scaled by their bounds.

    Two aggregates of a few numbers: the columns' means and extents with their covariances, then the scores' bounds.
    """
    b = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m|{c}"), (F.max(c) - F.min(c)).cast("double").alias(f"e|{c}"))]).first()
    unit = {c: (F.col(c) - F.lit(b[f"m|{c}"])) / F.lit((b[f"e|{c}"] or 0.0) + eps) for c in columns}
    names = [f"_u{n}" for n in range(len(columns))]
    centred = df.withColumns(dict(zip(names, unit.values())))
    out = pca(centred, names, k)
    ends = out.agg(*[x for n in range(k) for x in (F.min(f"pc{n}").alias(f"lo{n}"), F.max(f"pc{n}").alias(f"hi{n}"))]).first()
    scale = lambda n: (F.col(f"pc{n}") - F.lit(ends[f"lo{n}"])) / F.lit(ends[f"hi{n}"] - ends[f"lo{n}"]) if ends[f"lo{n}"] is not None and ends[f"hi{n}"] > ends[f"lo{n}"] else F.lit(0.0)
    return out.withColumns({f"pc{n}": scale(n) for n in range(k)}).drop(*names)


def kmeans(df: DataFrame, columns: list[str], centres: list[list[float]], iterations: int, metric: str = "squared") -> tuple[DataFrame, list[list[float]]]:
    """At most ``iterations`` Lloyd rounds from given centres, until none moves; an empty cluster keeps its centre.  Ties: the lower cluster."""

    def assign(cs: list[list[float]]):
        d = [sum((F.abs(F.col(c) - x) if metric == "l1" else (F.col(c) - x) * (F.col(c) - x) for c, x in zip(columns, centre)), F.lit(0.0)) for centre in cs]
        return F.expr("0") if len(cs) == 1 else (F.array_position(F.array(*d), F.least(*d)) - 1).cast("long")

    for _ in range(iterations):
        rows = df.groupBy(assign(centres).alias("c")).agg(*[F.avg(c).alias(f"m{n}") for n, c in enumerate(columns)]).collect()  # a row per cluster
        new = [list(c) for c in centres]
        for r in rows:
            new[r["c"]] = [r[f"m{n}"] for n in range(len(columns))]
        if new == centres:
            break
        centres = new
    return df.withColumn("cluster", assign(centres)), centres


def within(df: DataFrame, columns: list[str], key: str, eps: float) -> DataFrame:
    """a, b, d2 of all rows at most eps apart, self included: an equi-join of grid cells, not a cross join."""
    cell = lambda c: F.floor(F.col(c) / eps)
    cells = [f"_c{n}" for n in range(len(columns))]
    left = df.select(F.col(key).alias("a"), *[F.col(c).alias(f"_x{n}") for n, c in enumerate(columns)], *[cell(c).alias(cells[n]) for n, c in enumerate(columns)])
    right = df.select(F.col(key).alias("b"), *[F.col(c).alias(f"_y{n}") for n, c in enumerate(columns)], *[cell(c).alias(f"_d{n}") for n, c in enumerate(columns)])
    for n in range(len(columns)):  # three neighbouring cells per dimension
        right = right.withColumn(cells[n], F.explode(F.array(*[F.col(f"_d{n}") + k for k in (-1, 0, 1)]))).drop(f"_d{n}")
    d2 = sum(((F.col(f"_x{n}") - F.col(f"_y{n}")) * (F.col(f"_x{n}") - F.col(f"_y{n}")) for n in range(len(columns))), F.lit(0.0))
    return left.join(right, cells).withColumn("d2", d2).where(F.col("d2") <= eps * eps).select("a", "b", "d2")


def nearest_flagged(df: DataFrame, columns: list[str], key: str, flag) -> DataFrame:
    """key, distance to the nearest flagged row, exact for any number of flagged rows; null if there is none or for rows with
    a null coordinate."""
    space = Space.of(df.where(flag).withColumn("_flagged", F.lit(1)), columns, "_flagged")
    return df.select(key).join(space.nearest(df, columns, key).select(key, "distance"), key, "left")


def hierarchical(x: np.ndarray, k: int, linkage: str = "average") -> np.ndarray:
    """Lance-Williams agglomeration of up to some thousand rows into k clusters, numbered by first row."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    if linkage not in {"ward", "centroid", "median"}:
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, of, live = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - k):
        i, j = sorted(divmod(int(d.argmin()), n))
        a, b = size[i], size[j]
        c = size
        ai, aj, beta, gamma = {
            "single": (0.5, 0.5, 0, -0.5), "complete": (0.5, 0.5, 0, 0.5), "average": (a / (a + b), b / (a + b), 0, 0), "weighted": (0.5, 0.5, 0, 0),
            "centroid": (a / (a + b), b / (a + b), -a * b / (a + b) ** 2, 0), "median": (0.5, 0.5, -0.25, 0),
            "ward": ((a + c) / (a + b + c), (b + c) / (a + b + c), -c / (a + b + c), 0),
        }[linkage]
        with np.errstate(invalid="ignore"):
            new = ai * d[i] + aj * d[j] + beta * d[i, j] + gamma * np.abs(d[i] - d[j])
        new[~live] = new[i] = new[j] = np.inf
        d[i], d[:, i] = new, new
        d[j] = d[:, j] = np.inf
        live[j], size[i] = False, a + b
        of[of == j] = i
    return np.unique(of, return_inverse=True)[1]


def tsne(x: np.ndarray, perplexity: float = 30, iterations: int = 250, seed: int = 0, rate: float = 200, block: int = 1 << 22, held: int = 1 << 25) -> np.ndarray:
    """Exact t-SNE: early exaggeration 12, momentum .5 then .8.

    Pairs are taken in blocks of about ``block``, so memory does not grow with their number; affinities of more than
    ``held`` pairs are computed again in every iteration.
    """
    n = len(x)
    if n - 1 < 3 * perplexity:
        raise ValueError("too few rows for this perplexity")
    used, least, total = np.empty(n), np.empty(n), np.empty(n)
    for i in range(n):
        row, lo, hi, beta = np.delete(((x[i] - x) ** 2).sum(1), i), 0.0, np.inf, 1.0
        least[i] = row.min()
        for _ in range(50):
            e = np.exp(-(row - least[i]) * beta)
            used[i], total[i] = beta, e.sum()
            h = np.log(total[i]) + beta * ((row - least[i]) * e).sum() / total[i]
            if abs(h - np.log(perplexity)) < 1e-5:
                break
            lo, hi = (beta, hi) if h > np.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2

    def square(a: np.ndarray, at: slice) -> np.ndarray:
        """Squared distances of some rows to all, infinite to themselves."""
        d = sum((a[at, k, None] - a[None, :, k]) ** 2 for k in range(a.shape[1]))
        d[np.arange(len(d)), np.arange(n)[at]] = np.inf
        return d

    def affinity(at: slice) -> np.ndarray:
        d = square(x, at)
        there = np.exp(-(d - least[at, None]) * used[at, None]) / total[at, None]
        back = np.exp(-(d - least) * used) / total
        return np.maximum((there + back) / (2 * n), 1e-12)

    step = max(1, block // n)
    parts = [slice(a, a + step) for a in range(0, n, step)]
    kept = [affinity(at) for at in parts] if n * n <= held else None
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    v = np.zeros_like(y)
    for it in range(iterations):
        pull, push, z = np.empty_like(y), np.empty_like(y), 0.0
        for k, at in enumerate(parts):
            q = 1 / (1 + square(y, at))
            z += q.sum()
            for out, w in ((pull, (kept[k] if kept else affinity(at)) * q), (push, q * q)):
                out[at] = w.sum(1)[:, None] * y[at] - w @ y
        v = (0.5 if it < iterations // 4 else 0.8) * v - rate * 4 * (pull * (12 if it < iterations // 4 else 1) - push / z)
        y = y + v
        y -= y.mean(0)
    return y


def on_all(df: DataFrame, columns: list[str], key: str, f, schema: str, limit: int | None = 5000) -> DataFrame:
    """Run a whole-table NumPy method in one task; the table's size is checked first, unless any is allowed."""
    if limit is not None and df.count() > limit:
        raise ValueError(f"more than {limit} rows")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return f(pdf[key].to_numpy(), pdf[columns].to_numpy(float))

    return df.select(key, *columns, F.lit(0).alias("_g")).groupBy("_g").applyInPandas(run, schema)


