"""Leader clustering of one large table.

In key order, a row is a leader unless an earlier leader's box holds it: the lexicographically first independent set of the
graph of rows in reach.  Leaders among the first rows depend on no others, so a bounded number of first rows is settled in a
task, and all rows in their leaders' boxes fall away where they lie; then the first of those left, as long as most fall away.

If more than half stays (many leaders), the rest lies in the leaves of a kd-tree and is settled in rounds.  A leaf goes through its undecided
rows in key order and settles each that waits for no undecided earlier row in reach; rows of other leaves in reach come
along as they stood after the round before.  Only waiting rows and new leaders travel.  The earliest undecided row is
settled in each round, so the rounds end; their number is the longest chain of leaves in which rows wait for each other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .ranks import position
from .space import Local, Space, matrix

#: First rows that are settled in one task, keys drawn to find about so many, and most leaders that go to every task.
FIRST, DRAWN, HELD = 1 << 15, 1 << 14, 1 << 17


class Grid:
    """Points by cells as wide as the reach in their first columns."""

    def __init__(self, reach: np.ndarray):
        self.reach, self.k = reach, min(len(reach), 2)
        self.cells: dict[tuple[int, ...], list[tuple[int, tuple[float, ...]]]] = defaultdict(list)
        self.around = list(product((-1, 0, 1), repeat=self.k))
        self.wide = [float(r) * 1.000001 if r > 0 else 1.0 for r in reach[: self.k]]

    def cell(self, x: tuple[float, ...]) -> tuple[int, ...]:
        return tuple(int(v // w) for v, w in zip(x, self.wide))

    def put(self, name: int, x: tuple[float, ...]) -> None:
        self.cells[self.cell(x)].append((name, x))

    def before(self, name: int, x: tuple[float, ...]) -> bool:
        """Does the box of an earlier point hold this one?"""
        at = self.cell(x)
        for step in self.around:
            for other, y in self.cells.get(tuple(a + s for a, s in zip(at, step)), ()):
                if other < name and all(b - r <= a <= b + r for a, b, r in zip(x, y, self.reach)):
                    return True
        return False


def settle(names: np.ndarray, x: np.ndarray, waiting: tuple[np.ndarray, np.ndarray], leaders: tuple[np.ndarray, np.ndarray], reach: np.ndarray) -> np.ndarray:
    """State of each undecided row: 0 waits, 1 leads, 2 follows; names are numbers in key order, ``waiting`` are rows of
    other leaves."""
    held, heads = Grid(reach), Grid(reach)
    for grid, (n, y) in ((held, waiting), (heads, leaders)):
        for name, row in zip(n.tolist(), y.tolist()):
            grid.put(name, tuple(row))
    state = np.zeros(len(names), np.int8)
    for i in np.argsort(names, kind="stable"):
        name, row = int(names[i]), tuple(x[i].tolist())
        if heads.before(name, row):
            state[i] = 2
        elif held.before(name, row):
            held.put(name, row)
        else:
            state[i] = 1
            heads.put(name, row)
    return state


def leaders(space: Space, reach: list[float]) -> DataFrame:
    """x, first of the leaders among the distinct points, by the order of their least keys."""
    kind, width = space.points.schema["first"].dataType.simpleString(), np.array(reach, float)

    def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        leaf = None

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            names = np.unique(np.asarray(t["first"].to_pandas()), return_inverse=True)[1]
            x = matrix(t["x"].combine_chunks())
            kinds = np.asarray(t["kind"])
            own, wait, head = (np.flatnonzero(kinds == k) for k in range(3))
            state = settle(names[own], x[own], (names[wait], x[wait]), (names[head], x[head]), width)
            t = t.take(pa.array(own)).append_column("state", pa.array(state, pa.int32())).drop_columns(["kind"]).filter(pa.array(state < 2))
            return t.combine_chunks().to_batches()[0] if t.num_rows else None

        for batch in batches:
            at = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.diff(at)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if leaf is not None and at[a] != leaf and rows:
                    made = out()
                    rows.clear()
                    if made is not None:
                        yield made
                leaf = at[a]
                rows.append(batch.slice(a, b - a))
        if rows and (made := out()) is not None:
            yield made

    undecided = space.points.select("leaf", "x", "first")
    news, found = None, []
    while True:
        visitors = undecided.withColumn("kind", F.lit(1))
        if news is not None:
            visitors = visitors.unionAll(news.withColumn("kind", F.lit(2)))
        if len(space.lo) > 1:
            near = space.sent(visitors.withColumnRenamed("leaf", "was"), lambda tree, x: tree.boxes(x - width, x + width), "x").where("leaf <> was").select("leaf", "x", "first", "kind")
            all_rows = undecided.withColumn("kind", F.lit(0)).unionAll(near)
        else:
            all_rows = undecided.withColumn("kind", F.lit(0))
        by = all_rows.repartition("leaf").sortWithinPartitions("leaf")
        done = checkpointed(by.mapInArrow(by_leaf, f"leaf int, x array<double>, first {kind}, state int"))
        news = done.where("state = 1").drop("state")
        found.append(news)
        undecided = done.where("state = 0").drop("state")
        if undecided.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.select("x", "first")


class Heads:
    """Leaders in a tree, for many rows at once."""

    def __init__(self, x: np.ndarray, numbers: np.ndarray, reach: np.ndarray):
        self.local, self.reach = Local(x), reach
        self.numbers = numbers[self.local.order]

    def least(self, x: np.ndarray) -> np.ndarray:
        """The least number of a leader whose box holds each row, or -1."""
        none = np.iinfo(np.int64).max
        best = np.full(len(x), none)
        for at in range(0, len(x), 1024):
            a = x[at : at + 1024]
            wide = self.reach + 1e-9 * (np.abs(a) + self.reach)  # the tree may let too many through, never too few
            for i, p in self.local.pieces(*self.local.tree.boxes(a - wide, a + wide)):
                y = self.local.x[p]
                ok = ((y - self.reach <= a[i]) & (a[i] <= y + self.reach)).all(1)
                np.minimum.at(best, i[ok] + at, self.numbers[p[ok]])
        return np.where(best == none, -1, best)


def first_leaders(rows: DataFrame, names: list[str], key: str, reach: np.ndarray) -> tuple[list[DataFrame], DataFrame | None]:
    """Leaders (names, head) found among first rows, and the rows that none of these holds, if these are still many."""
    kind, shape = rows.schema[key].dataType.simpleString(), ", ".join(f"{n} double" for n in names)
    left, found = rows.where(Space.there(names) & F.col(key).isNotNull()).select(*names, F.col(key).alias("head")), []
    n = left.count()

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            pdf = pd.concat(parts).sort_values("head", ignore_index=True)
            none = (np.empty(0, np.int64), np.empty((0, len(names))))
            yield pdf[settle(np.arange(len(pdf)), pdf[names].to_numpy(float), none, none, reach) == 1]

    while n:
        part = left
        if n > FIRST:
            drawn = sorted(r[0] for r in left.select("head").sample(min(1.0, DRAWN / n), 7).collect())
            if not drawn:
                return found, left
            cut = F.lit(drawn[int(len(drawn) * FIRST / n)])
            part, left = left.where(F.col("head") <= cut), left.where(F.col("head") > cut)
        heads = checkpointed(part.repartition(1).mapInPandas(lead, f"{shape}, head {kind}"))
        found.append(heads)
        if n <= FIRST:
            break
        x = heads.select(*names).toPandas().to_numpy(float)  # of at most about FIRST rows

        def outside(batches: Iterator[pd.DataFrame], x: np.ndarray = x) -> Iterator[pd.DataFrame]:
            held = Heads(x, np.zeros(len(x), np.int64), reach)
            for pdf in batches:
                yield pdf[held.least(pdf[names].to_numpy(float)) < 0]

        left, before = checkpointed(left.mapInPandas(outside, f"{shape}, head {kind}")), n
        n = left.count()
        if 2 * n > before:
            return found, left
    return found, None


def led(df: DataFrame, columns: list[str], key: str, eps: float | list[float], group: str | None, name: str) -> DataFrame:
    """``df`` with the number of each row's leader."""
    reach = np.array([float(e) / 2 for e in (eps if isinstance(eps, (list, tuple)) else [eps] * len(columns))])
    names = [f"_c{n}" for n in range(len(columns))]
    rows = df.withColumns({n: F.col(c).cast("double") for n, c in zip(names, columns)})
    if group is not None:  # groups lie one apart in a column of their own, in which reach is a half
        groups = position(df.select(F.col(group).alias("_name")).distinct(), "_name", name="_g").withColumn("_g", F.col("_g").cast("double"))
        rows = rows.join(groups, F.col(group).eqNullSafe(F.col("_name"))).drop("_name")
        names, reach = ["_g", *names], np.append(0.5, reach)
    rows = checkpointed(rows)
    found, rest = first_leaders(rows, names, key, reach)
    if rest is not None:
        found.append(leaders(Space.of(rest, names, "head"), reach.tolist()).select(*[F.col("x")[n].alias(c) for n, c in enumerate(names)], F.col("first").alias("head")))
    if not found:
        return rows.withColumn(name, F.lit(None).cast("long")).drop(*names)
    heads = found[0]
    for more in found[1:]:
        heads = heads.unionAll(more)
    heads = checkpointed(position(heads, *(["_g"] if group is not None else []), "head", name="at"))
    count = heads.count()
    if group is not None:
        heads = heads.join(heads.groupBy("_g").agg(F.min("at").alias("from")), "_g").withColumn("at", F.col("at") - F.col("from")).drop("from")
    if count <= HELD:
        t = heads.select(*names, "at").toPandas()
        x, at = t[names].to_numpy(float), t["at"].to_numpy(np.int64)

        @F.pandas_udf("long")
        def number(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            held = Heads(x, at, reach)
            for parts in batches:
                rows = np.column_stack([p.to_numpy(float) for p in (parts if isinstance(parts, tuple) else (parts,))])
                ok = np.isfinite(rows).all(1)
                out = np.full(len(rows), -1)
                out[ok] = held.least(rows[ok])
                yield pd.Series(out)

        return rows.withColumn(name, number(*names)).withColumn(name, F.when(F.col(name) >= 0, F.col(name))).drop(*names)
    space = Space.of(rows, names, key)
    boxes = heads.select("at", *[(F.col(c) + s * r).alias(f"{c}{s}") for c, r in zip(names, reach.tolist()) for s in (-1, 1)])
    holds = space.in_boxes(boxes, [f"{c}-1" for c in names], [f"{c}1" for c in names], "at").groupBy("first").agg(F.min("at").cast("long").alias(name))
    point = space.points.join(holds, "first").select(name, *[F.col("x")[n].alias(f"_x{n}") for n in range(len(names))])
    return rows.join(point, [F.col(c) == F.col(f"_x{n}") for n, c in enumerate(names)], "left").drop(*names, *[f"_x{n}" for n in range(len(names))])


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all tasks: few bytes of a file that is read by one are much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def leader(df: DataFrame, columns: list[str], key: str, eps: float | list[float], group: str | None = None) -> DataFrame:
    """Row per row: key, leader: the number (0.. in key order, per group) of the first leader whose box of half-width eps / 2
    holds the row; null with a null coordinate.  Keys are unique; ``eps`` may be given per column."""
    own = [F.col(key).alias("_key"), *[F.col(c).alias(f"_v{n}") for n, c in enumerate(columns)], *([F.col(group).alias("_of")] if group is not None else [])]
    found = led(spread(df.select(*own)), [f"_v{n}" for n in range(len(columns))], "_key", eps, "_of" if group is not None else None, "leader")
    return found.select(F.col("_key").alias(key), "leader")


def leader_levels(df: DataFrame, columns: list[str], key: str, eps: float | list[float], factor: float, levels: int) -> DataFrame:
    """key and level0, level1, ...: leaders, then leaders among the followers of each, with boxes ``factor`` as wide, and so on."""
    wide = [float(e) for e in (eps if isinstance(eps, (list, tuple)) else [eps] * len(columns))]
    values = [f"_v{n}" for n in range(len(columns))]
    out = spread(df.select(F.col(key).alias("_key"), *[F.col(c).alias(v) for c, v in zip(columns, values)]))
    for n in range(levels):
        here = out.withColumn("_above", F.concat_ws(".", *[f"level{k}" for k in range(n)])) if n else out
        out = checkpointed(led(here, values, "_key", [e * factor**n for e in wide], "_above" if n else None, f"level{n}").drop("_above"))
    return out.select(F.col("_key").alias(key), *[f"level{n}" for n in range(levels)])
