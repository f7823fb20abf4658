"""Index lists and draw lists: naming, appearance, set operations, lists from clusters, change tracking."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import position


def hash_subsample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """About one row in k by the first 28 bits of an MD5: the same rows in any engine.  A null key counts as empty."""
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}"))), 1, 7), 16, 10).cast("long")
    return df.where(h % k == 0)


def draws(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """ceil(n / k) draws with replacement: draw, row number by unique ``key``, and the row; the ids drawn follow an MD5."""
    n = df.count()
    h = F.conv(F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("long")
    drawn = df.sparkSession.range(-(-n // k)).select(F.col("id").alias("draw")).withColumn("pos", h % max(n, 1))
    return drawn.join(position(df, key), "pos")


def named(df: DataFrame, lists: str, pattern: str, name: str = "name") -> DataFrame:
    """List names by a printf pattern; lists without rows do not appear."""
    return df.withColumn(name, F.format_string(pattern, F.col(lists)))


def drawlists(df: DataFrame, lists: str, factor: float = 1.0) -> DataFrame:
    """One row per list: size and opacity clamp(1 / (n factor), 1e-6, 1)."""
    n = F.count(F.lit(1))
    return df.groupBy(lists).agg(n.alias("n"), F.least(F.greatest(1.0 / (n * factor), F.lit(1e-6)), F.lit(1.0)).alias("alpha"))


def shared_attributes(tables: list[DataFrame]) -> list[str]:
    """Attributes that all tables have, in the first one's order."""
    return [c for c in tables[0].columns if all(c in t.columns for t in tables)]


def joint(tables: list[DataFrame]) -> DataFrame:
    """All rows over the shared attributes."""
    names = shared_attributes(tables)
    return reduce(lambda a, b: a.unionAll(b), [t.select(*names) for t in tables])


def cluster_lists(df: DataFrame, cluster: str, key: str) -> DataFrame:
    """cluster, pos, key: each cluster's rows numbered from 0, as one list per cluster."""
    placed = position(df.select(cluster, key), cluster, key, name="_place")
    first = placed.groupBy(cluster).agg(F.min("_place").alias("_f"))
    return placed.join(first, cluster).select(cluster, (F.col("_place") - F.col("_f")).alias("pos"), key)


def without(df: DataFrame, columns: list[str], dims_of: dict[str, list[str]]) -> DataFrame:
    """Remove columns and the dimensions that no other column varies along; repeated rows fold into one."""
    kept = [c for c in dims_of if c not in columns]
    dims = list(dict.fromkeys(d for c in kept for d in dims_of[c]))
    return df.select(*dims, *kept).distinct()


def moved(order: list[str], a: str, b: str) -> list[str]:
    """Axis order with a and b swapped."""
    return [{a: b, b: a}.get(x, x) for x in order]


def shifted(order: list[str], a: str, by: int) -> list[str]:
    """Axis order with a moved by some places, kept inside."""
    rest, at = [x for x in order if x != a], order.index(a)
    at = min(max(at + by, 0), len(rest))
    return [*rest[:at], a, *rest[at:]]


class Tracker:
    """Version stamps: a derived value is made again only if a source it read has changed since."""

    def __init__(self):
        self.versions: dict[str, int] = {}
        self.made: dict[str, tuple[dict[str, int], object]] = {}

    def changed(self, source: str) -> None:
        self.versions[source] = self.versions.get(source, 0) + 1

    def stale(self, name: str, sources: list[str]) -> bool:
        return name not in self.made or self.made[name][0] != {s: self.versions.get(s, 0) for s in sources}

    def get(self, name: str, sources: list[str], make: Callable[[], object]) -> object:
        if self.stale(name, sources):
            self.made[name] = ({s: self.versions.get(s, 0) for s in sources}, make())
            self.changed(name)
        return self.made[name][1]


def on_load(df: DataFrame, attributes: str = ".*", trim: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """What opening a table does by setting: attributes by pattern, trimmed and subsampled dimensions."""
    from .dims import subsample

    picked = df.select(*[c for c in df.columns if re.search(attributes, c) or c in (trim or {})])
    return subsample(picked, trim or {})


def area_cuts(rows: DataFrame, axis: str, boxes: dict[str, tuple[float, float]], bins: int) -> dict[str, float]:
    """For all boxes of a level at once, the value of an axis whose cut has the least extents times rows on both sides.

    Candidates are the largest values of ``bins`` bins of a box (all of its values if each has a bin of its own); rows up to
    a candidate count for its front.  Of equal costs the smallest value is taken.
    """
    bounds = F.create_map(*[x for b, (lo, hi) in boxes.items() for x in (F.lit(b), F.array(F.lit(lo), F.lit(hi)))])[F.col("box")]
    v, lo, hi = F.col(axis), bounds[0], bounds[1]
    place = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = rows.where(bounds.isNotNull() & (v >= lo) & (v <= hi)).groupBy("box", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max(axis).alias("v"))
    by = Window.partitionBy("box")  # ``bins`` rows a box at most
    counted = counted.withColumns({"front": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    cost = (v := F.col("v") - lo) * F.col("front") + (hi - lo - v) * (F.col("all") - F.col("front"))
    best = counted.groupBy("box").agg(F.min(F.struct(cost.alias("cost"), F.col("v"))).alias("c"))
    return {r["box"]: float(r["c"]["v"]) for r in best.collect()}  # 2 ** depth at most


def fractures(
    df: DataFrame, columns: list[str], depth: int, borders: str = "static", least: int = 1, rule: str = "half", bins: int = 1024, smallest: float = 0.0
) -> DataFrame:
    """Boxes of a recursive split of the bounds, one axis a level: box, n, and lo_ and hi_ of each column.

    A box is cut in the middle (``half``) or where the surface-area cost is least (``area``, see ``area_cuts``).  On a level
    whose axis has at most the share ``smallest`` of its whole extent left, a box stays whole and goes on to the next axis.

    ``static`` keeps the halves' bounds, ``both`` pulls them to the rows inside, ``outer`` only where no other half
    adjoins.  A box with fewer than ``least`` rows is not split further.  Rows with a null coordinate are left out.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna().withColumn("box", F.lit("r"))
    ends = lambda c: [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    total = rows.agg(*[x for c in columns for x in ends(c)]).first()
    if any(v is None for v in total):  # no row
        return rows.groupBy("box").agg(F.count(F.lit(1)).alias("n"), *[x for c in columns for x in ends(c)])
    boxes = {"r": {c: (total[f"lo_{c}"], total[f"hi_{c}"]) for c in columns}}
    outer, whole = dict(boxes), boxes["r"]
    for level in range(depth):
        axis = columns[level % len(columns)]
        size = {r["box"]: r["n"] for r in rows.groupBy("box").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 ** depth at most
        split = {b: x for b, x in outer.items() if size.get(b, 0) >= max(least, 2) and len(b) == level + 1}
        if not split:
            break
        extent = whole[axis][1] - whole[axis][0]
        thin = {b for b, x in split.items() if smallest > 0 and extent > 0 and (x[axis][1] - x[axis][0]) / extent <= smallest}
        cut = {b: x[axis] for b, x in split.items() if b not in thin}
        mid = {b: (lo + hi) / 2 for b, (lo, hi) in cut.items()} if rule == "half" or not cut else area_cuts(rows, axis, cut, bins)
        mid |= {b: float("inf") for b in thin}  # all rows stay on the front side
        at = F.create_map(*[F.lit(v) for b, m in mid.items() for v in (b, m)])[F.col("box")]
        rows = rows.withColumn("box", F.when(at.isNull(), F.col("box")).when(F.col(axis) < at, F.concat("box", F.lit("0"))).otherwise(F.concat("box", F.lit("1"))))
        for b, x in split.items():
            del outer[b]
            if b in thin:
                outer[b + "0"] = x
                continue
            outer[b + "0"], outer[b + "1"] = {**x, axis: (x[axis][0], mid[b])}, {**x, axis: (mid[b], x[axis][1])}
    found = rows.groupBy("box").agg(F.count(F.lit(1)).alias("n"), *[x for c in columns for x in ends(c)])
    if borders == "both":
        return found
    bound = {b: [float(v) for c in columns for v in x[c]] for b, x in outer.items()}
    limits = F.create_map(*[x for b, v in bound.items() for x in (F.lit(b), F.array(*map(F.lit, v)))])[F.col("box")]

    def end(n: int, c: str, side: str) -> Column:
        own = limits[2 * n + (side == "hi")]
        edge = F.lit(float(whole[c][side == "hi"]))
        return F.when(F.lit(borders == "outer") & (own == edge), F.col(f"{side}_{c}")).otherwise(own).alias(f"{side}_{c}")

    return found.select("box", "n", *[end(n, c, s) for n, c in enumerate(columns) for s in ("lo", "hi")])


def cluster_bundles(df: DataFrame, by: str, columns: list[str], widen: float = 2e-2) -> DataFrame:
    """list, attribute, lo, mid, hi and alpha (100 times the list's share of all rows); equal bounds are widened both ways."""
    ends = [x for c in columns for x in (F.min(c).cast("double").alias(f"lo|{c}"), F.max(c).cast("double").alias(f"hi|{c}"))]
    found = df.groupBy(F.col(by).alias("list")).agg(F.count(F.lit(1)).alias("_n"), *ends)
    rows = found.select("list", "_n", F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', `lo|{c}`, `hi|{c}`" for c in columns) + ") as (attribute, l, h)"))
    more = F.when(F.col("l") == F.col("h"), widen).otherwise(0.0)
    total = found.agg(F.sum("_n").alias("_all"))
    return rows.crossJoin(F.broadcast(total)).select("list", "attribute", (F.col("l") - more).alias("lo"), ((F.col("l") + F.col("h")) / 2).alias("mid"), (F.col("h") + more).alias("hi"), (F.col("_n") * 100.0 / F.col("_all")).alias("alpha"))
