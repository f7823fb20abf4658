"""Space-partitioned kd-trees: contains, box, radius and nearest searches over tables of any size.

A sample of the points gives split planes (half of the sample on each side, across the widest column); the tree of planes
goes to every task, points are dealt by leaf and written once.  A search sends each query to the leaves whose box it meets;
in a leaf, points lie in blocks of a local tree, and a batch of queries goes down its boxes together.  Nearest searches look
in their own leaf first and go on only to leaves nearer than what they found.

Points of equal coordinates are one row with their number and least key, so no leaf holds a point that cannot be split.  A
leaf that very many queries meet is repeated for parts of them.  Rows with a null, NaN or infinite coordinate are in no tree and
find nothing; rows without a key find points but are none.  The tree has at most ``LEAVES`` leaves: a fixed bound of what goes to driver and tasks; above ``LEAVES * rows``
distinct points leaves grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

LEAVES = 1 << 16
#: Rows of a local block, and most (query, block) pairs taken at once.
BLOCK, AT_ONCE = 32, 1 << 15
#: Queries of a leaf in one group.
QUERIES = 1 << 17
FAR = np.finfo(float).max


class Boxes:
    """Bounding boxes of consecutive blocks and a binary hierarchy above them."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.levels = [(lo, hi)]
        while len(lo) > 1:
            if len(lo) % 2:
                lo, hi = np.vstack([lo, np.full((1, lo.shape[1]), np.inf)]), np.vstack([hi, np.full((1, hi.shape[1]), -np.inf)])
            lo, hi = np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])
            self.levels.append((lo, hi))
        self.levels.reverse()

    def labels(self, of: np.ndarray) -> list[np.ndarray]:
        """Per level, the label that all blocks below a box share, or -1, from the blocks' own labels."""
        out = [of]
        while len(out[-1]) > 1:
            v = out[-1] if len(out[-1]) % 2 == 0 else np.append(out[-1], out[-1][-1])
            out.append(np.where(v[::2] == v[1::2], v[::2], -1))
        return out[::-1]

    def meet(self, count: int, near: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], labels: list[np.ndarray] | None = None, mine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) pairs that ``near`` lets through on every level; boxes of one label pass queries of the same by."""
        q, b = np.arange(count), np.zeros(count, np.int64)
        for depth, (lo, hi) in enumerate(self.levels):
            if depth:
                q, b = np.repeat(q, 2), np.repeat(2 * b, 2)
                b[1::2] += 1
                there = b < len(lo)
                q, b = q[there], b[there]
            ok = near(q, lo[b], hi[b])
            if labels is not None:
                ok &= labels[depth][b] != mine[q]
            q, b = q[ok], b[ok]
        return q, b

    def balls(self, x: np.ndarray, r2: np.ndarray, labels: list[np.ndarray] | None = None, mine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.meet(len(x), lambda q, lo, hi: box_distance(x[q], lo, hi) <= np.minimum(r2, FAR)[q], labels, mine)

    def boxes(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.meet(len(lo), lambda q, a, b: ((a <= hi[q]) & (b >= lo[q])).all(1))


def box_distance(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of points to boxes."""
    d = np.maximum(np.maximum(lo - x, x - hi), 0)
    return np.einsum("ij,ij->i", d, d)


Planes = tuple[np.ndarray, ...]


def kd_split(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, Planes]:
    """(order of the rows, first places of blocks of at most ``size``, split planes) of distinct points.

    A part is split across its widest column at the widest gap of its middle half, so that clusters stay together.  Planes
    are (column, value, left, right); a child below zero is block -1 - child, from left to right.
    """
    order, starts, planes = np.arange(len(x)), [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        part = order[a:b]
        spread = np.ptp(x[part], 0) if b - a > size else np.zeros(1)
        if spread.max() > 0:
            dim = int(spread.argmax())
            order[a:b] = part = part[np.argsort(x[part, dim], kind="stable")]
            v = x[part, dim]
            step = np.diff(v)
            low = max(1, (b - a) // 4)
            mid = low + int(step[low - 1 : b - a - low].argmax())
            if not step[mid - 1] > 0:  # one value fills the middle
                mid = 1 + int(np.abs(np.flatnonzero(step > 0) + 1 - (b - a) / 2).argmin())
                mid = int(np.flatnonzero(step > 0)[mid - 1]) + 1
            node = len(planes)
            planes.append([dim, v[mid], 0, 0])
            todo += [(a + mid, b, node, 3), (a, a + mid, node, 2)]
        else:
            node = -1 - len(starts)
            starts.append(a)
        if parent >= 0:
            planes[parent][side] = node
    p = np.array(planes, float).reshape(-1, 4)
    return order, np.array(starts), (p[:, 0].astype(int), p[:, 1], p[:, 2].astype(int), p[:, 3].astype(int))


def descend(planes: Planes, x: np.ndarray) -> np.ndarray:
    """The block on whose side of all planes each point lies."""
    dim, cut, left, right = planes
    node = np.zeros(len(x), np.int64) if len(dim) else np.full(len(x), -1)
    while (node >= 0).any():
        at = np.flatnonzero(node >= 0)
        here = node[at]
        node[at] = np.where(x[at, dim[here]] < cut[here], left[here], right[here])
    return -1 - node


class Local:
    """The points of a leaf in blocks."""

    def __init__(self, x: np.ndarray, size: int = BLOCK):
        self.order, starts, self.planes = kd_split(x, size)
        self.x, self.size = x[self.order], size
        self.starts, self.ends = starts, np.append(starts[1:], len(x))
        self.tree = Boxes(np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts))

    def rows(self, q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place of a point) of (query, block) pairs."""
        p = self.starts[b][:, None] + np.arange(self.size)
        there = p < self.ends[b][:, None]
        return np.broadcast_to(q[:, None], p.shape)[there], p[there]

    def by_distance(self, x: np.ndarray, r2: np.ndarray) -> Iterator[Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
        """Blocks in reach in two goes, the two nearest of each query first; each takes the bounds known by then."""
        q, b = self.tree.balls(x, r2)
        d = box_distance(x[q], self.tree.levels[-1][0][b], self.tree.levels[-1][1][b])
        order = np.lexsort((d, q))
        q, b, d = q[order], b[order], d[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < 2
        for go in (first, ~first):
            yield lambda bound, go=go: (lambda ok: (q[ok], b[ok]))(np.flatnonzero(go & (d <= np.minimum(bound, FAR)[q])))

    def pieces(self, q: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(q), AT_ONCE):
            yield self.rows(q[at : at + AT_ONCE], b[at : at + AT_ONCE])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Column by column, so that all engines add in one order."""
    d = np.zeros(len(a))
    for k in range(a.shape[1]):
        d += (a[:, k] - b[:, k]) * (a[:, k] - b[:, k])
    return d


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


@dataclass
class Space:
    """Points dealt by the leaves of a tree of split planes."""

    columns: list[str]
    key: str
    rows: int = 1 << 14
    planes: Planes = field(default=(), repr=False)
    #: leaf, x, first (least key), second (next key), n of each distinct point
    points: DataFrame = None
    lo: np.ndarray = None
    hi: np.ndarray = None

    @classmethod
    def of(cls, df: DataFrame, columns: list[str], key: str, rows: int = 1 << 14, second: bool = False) -> Space:
        space = cls(columns, key, rows)
        placed = df.select(F.col(key), *[F.col(c).cast("double").alias(f"_x{n}") for n, c in enumerate(columns)]).where(space.there([f"_x{n}" for n in range(len(columns))]) & F.col(key).isNotNull())
        x = [f"_x{n}" for n in range(len(columns))]
        one = placed.groupBy(*x).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
        if second:
            of = [F.col(f"_p.{c}") == F.col(f"_o.{c}") for c in x]
            then = placed.alias("_p").join(one.where("n > 1").alias("_o"), of).where(F.col(f"_p.{key}") > F.col("first")).groupBy(*[F.col(f"_o.{c}").alias(c) for c in x]).agg(F.min(f"_p.{key}").alias("second"))
            one = one.join(then, x, "left")
        else:
            one = one.withColumn("second", F.lit(None).cast(df.schema[key].dataType))
        one = checkpointed(one.select(F.array(*x).alias("x"), "first", "second", "n"))
        space.split(one)
        dealt = one.withColumn("leaf", space.leaf(F.col("x")))
        space.points = checkpointed(dealt)
        bounds = space.points.groupBy("leaf").agg(*[f(F.col("x")[n]).alias(f"{name}{n}") for n in range(len(columns)) for name, f in (("lo", F.min), ("hi", F.max))]).collect()  # a row per leaf
        leaves = max(1, len(space.planes[0]) + 1)
        space.lo, space.hi = np.full((leaves, len(columns)), np.inf), np.full((leaves, len(columns)), -np.inf)
        for r in bounds:
            space.lo[r["leaf"]], space.hi[r["leaf"]] = ([r[f"{name}{n}"] for n in range(len(columns))] for name in ("lo", "hi"))
        return space

    @staticmethod
    def there(columns: list[str]) -> Column:
        ok = F.lit(True)
        for c in columns:
            ok = ok & (F.abs(F.col(c).cast("double")) < float("inf"))  # NaN is above infinity
        return ok

    def split(self, one: DataFrame) -> None:
        """Planes from a sample of about 16 points a leaf."""
        n = one.count()
        leaves = min(LEAVES, -(-n // self.rows))
        self.planes = kd_split(np.zeros((0, 1)), 1)[2]
        if leaves > 1:
            wanted = 16 * leaves
            drawn = one.select("x").sample(min(1.0, wanted / n), 7) if wanted < n else one.select("x")
            x = matrix(drawn.toArrow()["x"].combine_chunks())
            self.planes = kd_split(x, max(1, 2 * len(x) // leaves))[2] if len(x) else self.planes

    def leaf(self, x: Column) -> Column:
        planes = self.planes

        @F.pandas_udf("int")
        def leaf(v: pd.Series) -> pd.Series:
            return pd.Series(descend(planes, np.stack(np.asarray(v))) if len(v) else [], dtype="int32")

        return leaf(x)

    def queries(self, df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
        """Rows with a place, a number of their own and ``x``: written, so that numbers stay."""
        x = F.array(*[F.col(c).cast("double") for c in columns])
        return checkpointed(df.where(self.there(columns)).select(x.alias("x"), *more).withColumn("q", F.monotonically_increasing_id()))

    def sent(self, queries: DataFrame, find, *inputs: str) -> DataFrame:
        """A row per query and leaf that it meets; ``find(boxes, arrays)`` gives the pairs."""
        lo, hi = self.lo, self.hi

        @F.pandas_udf("array<int>")
        def leaves(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            tree = Boxes(lo, hi)
            for parts in batches:
                parts = parts if isinstance(parts, tuple) else (parts,)
                n = len(parts[0])
                out: list = [[]] * n
                for at in range(0, n, 2048):
                    arrays = [np.stack(np.asarray(p[at : at + 2048])) if p.dtype == object else np.asarray(p[at : at + 2048]) for p in parts]
                    q, b = find(tree, *arrays)
                    order = np.argsort(q, kind="stable")
                    q, b = q[order], b[order]
                    m = len(arrays[0])
                    out[at : at + m] = np.split(b, np.searchsorted(q, np.arange(1, m)))
                yield pd.Series(out)

        return queries.withColumn("leaf", F.explode(leaves(*inputs)))

    def search(self, sent: DataFrame, extra: list[str], run, schema: str, points: DataFrame | None = None, carry: list[str] = [], few: bool = False) -> DataFrame:
        """``run(local, points, queries)`` over the queries of each leaf, batch by batch; it yields record batches.

        ``points`` may give the leaves' points anew with columns ``carry`` more.  ``few`` says that a leaf has no more queries
        than points, so that no leaf needs to be dealt to parts.
        """
        sent = sent if few else checkpointed(sent)
        much = {} if few else {r["leaf"]: -(-r["n"] // QUERIES) for r in sent.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > QUERIES).collect()}  # at most a row per leaf
        parts = F.coalesce(F.create_map(*[F.lit(v) for kv in much.items() for v in kv])[F.col("leaf")], F.lit(1)) if much else F.lit(1)
        points = self.points if points is None else points
        mine = ["first", "second", "n", *carry]
        none = {c: F.lit(None).cast(t) for df, names in ((points, mine), (sent, ["q", *extra])) for c, t in ((f.name, f.dataType) for f in df.schema) if c in names}
        p = points.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("kind", F.lit(0))
        s = sent.withColumn("part", F.pmod(F.hash("q"), parts)).withColumn("kind", F.lit(1))
        both = [
            df.select("leaf", "part", "kind", "x", *[F.col(c) if (c in mine) == (df is p) else none[c].alias(c) for c in (*mine, "q", *extra)]) for df in (p, s)
        ]
        rows = both[0].unionAll(both[1]).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind")

        def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, local, table = None, [], None, None
            for batch in batches:
                marks = np.stack([np.asarray(batch.column(k)) for k in range(3)], 1)
                cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                    if b == a:
                        continue
                    leaf, part, kind = marks[a]
                    if (leaf, part) != at:
                        at, held, local = (leaf, part), [], None
                    if kind == 0:
                        held.append(batch.slice(a, b - a))
                        continue
                    if local is None and held:
                        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        local, held = Local(matrix(table.column("x"))), []
                    if local is not None:
                        yield from run(local, table, batch.slice(a, b - a))

        return rows.mapInArrow(by_leaf, schema)

    def contains(self, df: DataFrame, columns: list[str], name: str = "contained") -> DataFrame:
        """``df`` with a flag: there is a point at its coordinates.  A lookup by value; no tree is needed for that."""
        found = self.points.select(*[F.col("x")[n].alias(f"_y{n}") for n in range(len(columns))], F.lit(True).alias("_in"))
        on = [F.col(c).cast("double") == F.col(f"_y{n}") for n, c in enumerate(columns)]
        return df.join(found, on, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in", *[f"_y{n}" for n in range(len(columns))])

    def in_boxes(self, df: DataFrame, lows: list[str], highs: list[str], key: str) -> DataFrame:
        """key, first, n of all points in each row's box, bounds included; rows find nothing if a bound is null."""
        top = F.array(*[F.col(c).cast("double") for c in highs])
        q = self.queries(df.where(self.there(highs)), lows, top.alias("top"), F.col(key).alias("k"))
        types = {f.name: f.dataType for f in q.schema} | {f.name: f.dataType for f in self.points.schema}

        def run(local: Local, table: pa.RecordBatch, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lo, hi, keys = matrix(batch.column("x")), matrix(batch.column("top")), batch.column("k")
            for at in range(0, len(lo), 1024):
                a, b = lo[at : at + 1024], hi[at : at + 1024]
                for i, p in local.pieces(*local.tree.boxes(a, b)):
                    ok = ((local.x[p] >= a[i]) & (local.x[p] <= b[i])).all(1)
                    rows = pa.array(local.order[p[ok]])
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i[ok] + at)), table.column("first").take(rows), table.column("n").take(rows)], [key, "first", "n"])

        return self.search(self.sent(q, lambda tree, lo, hi: tree.boxes(lo, hi), "x", "top"), ["top", "k"], run, f"`{key}` {types['k'].simpleString()}, first {types['first'].simpleString()}, n long")

    def in_radius(self, df: DataFrame, columns: list[str], key: str, radius: float) -> DataFrame:
        """key, first, n, d2 of all points at most ``radius`` away from each row."""
        q = self.queries(df, columns, F.col(key).alias("k"))
        types = {f.name: f.dataType for f in q.schema} | {f.name: f.dataType for f in self.points.schema}
        r2 = float(radius) ** 2

        def run(local: Local, table: pa.RecordBatch, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, keys = matrix(batch.column("x")), batch.column("k")
            for at in range(0, len(x), 1024):
                a = x[at : at + 1024]
                for i, p in local.pieces(*local.tree.balls(a, np.full(len(a), r2))):
                    d2 = squared(a[i], local.x[p])
                    ok = d2 <= r2
                    rows = pa.array(local.order[p[ok]])
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i[ok] + at)), table.column("first").take(rows), table.column("n").take(rows), pa.array(d2[ok])], [key, "first", "n", "d2"])

        sent = self.sent(q, lambda tree, x: tree.balls(x, np.full(len(x), r2)), "x")
        return self.search(sent, ["k"], run, f"`{key}` {types['k'].simpleString()}, first {types['first'].simpleString()}, n long, d2 double")

    def nearest(self, df: DataFrame, columns: list[str], key: str, other: bool = False) -> DataFrame:
        """Row per row with a place: key, the nearest point's least key (ties: the least) and its distance.

        ``other`` asks for points other than the row itself, by key; the tree must have been made with ``second``.
        """
        q = self.queries(df, columns, F.col(key).alias("k")).withColumn("r2", F.lit(FAR))
        types = {f.name: f.dataType.simpleString() for f in self.points.schema}

        def run(local: Local, table: pa.RecordBatch, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, bound = matrix(batch.column("x")), np.asarray(batch.column("r2"), float)
            first, second = (table.column(c).take(pa.array(local.order)) for c in ("first", "second"))
            names, places = np.unique(np.concatenate([np.asarray(first.to_pandas()), np.asarray(second.drop_null().to_pandas())]), return_inverse=True)
            one, two = places[: len(first)], np.full(len(first), len(names))
            two[np.flatnonzero(np.asarray(second.is_valid()))] = places[len(first) :]
            mine = np.searchsorted(names, np.asarray(batch.column("k").to_pandas())) if other else None
            if other:  # the query's own name, if this leaf has it
                keys = np.asarray(batch.column("k").to_pandas())
                mine = np.where(names[np.minimum(mine, len(names) - 1)] == keys, mine, -1)

            def best(i: np.ndarray, p: np.ndarray, d2: np.ndarray, name: np.ndarray, at: int) -> None:
                v = squared(x[at:][i], local.x[p])
                who = one[p]
                if other:
                    same = (v == 0) & (who == mine[at:][i])
                    who = np.where(same, two[p], who)
                    v = np.where(who < len(names), v, np.inf)
                order = np.lexsort((who, v, i))
                head = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
                i, v, who = i[head], v[head], who[head]
                better = (v < d2[i]) | ((v == d2[i]) & (who < name[i]))
                d2[i[better]], name[i[better]] = v[better], who[better]

            for at in range(0, len(x), 1024):
                a = x[at : at + 1024]
                d2, name = np.full(len(a), np.inf), np.full(len(a), len(names))
                best(*local.rows(np.arange(len(a)), descend(local.planes, a)), d2, name, at)
                limit = bound[at : at + len(a)]
                for part in local.by_distance(a, np.minimum(limit, d2)):
                    for i, p in local.pieces(*part(np.minimum(limit, d2))):
                        best(i, p, d2, name, at)
                ok = np.flatnonzero(name < len(names))
                found = pa.array(names[name[ok]], table.schema.field("first").type)
                yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(ok + at)), found, pa.array(d2[ok])], ["q", "near", "d2"])

        made = f"q long, near {types['first']}, d2 double"
        if self.lo is None or not np.isfinite(self.lo).any():
            return q.select(F.col("k").alias(key), F.lit(None).cast(types["first"]).alias("near"), F.lit(None).cast("double").alias("distance"))
        own = q.withColumn("leaf", self.leaf(F.col("x")))
        found = checkpointed(own.join(self.search(own, ["k", "r2"], run, made), "q", "left").withColumn("r2", F.coalesce("d2", F.lit(FAR))))
        # a second look, only in other leaves that are no farther away than what was found
        further = self.sent(found.withColumnRenamed("leaf", "was"), lambda tree, x, r2: tree.balls(x, r2), "x", "r2").where("leaf <> was").select("x", "k", "q", "r2", "leaf")
        second = self.search(further, ["k", "r2"], run, made).groupBy("q").agg(F.min(F.struct("d2", "near")).alias("s"))
        both = found.join(second, "q", "left").withColumn("f", F.when(F.col("d2").isNotNull(), F.struct("d2", "near")))
        got = F.when(F.col("f").isNull() | (F.col("s") < F.col("f")), F.coalesce("s", "f")).otherwise(F.col("f"))
        return both.select(F.col("k").alias(key), got.alias("g")).select(key, F.col("g.near").alias("near"), F.sqrt("g.d2").alias("distance"))

    def k_nearest(self, k: int) -> DataFrame:
        """first, leaf, near, near_leaf, d2, place (from 1): the ``k`` nearest other points of each point, ties by key.

        The own leaf is searched first; its k-th distance bounds the look into other leaves.  A point whose leaf holds fewer
        than ``k`` others looks everywhere, so leaves should be well above ``k``.
        """
        kind = self.points.schema["first"].dataType.simpleString()

        def run(local: Local, table: pa.RecordBatch, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, bound, keys = matrix(batch.column("x")), np.asarray(batch.column("r2"), float), batch.column("k")
            names = table.column("first").take(pa.array(local.order))
            theirs, mine = np.asarray(names.to_pandas()), np.asarray(keys.to_pandas())
            here = batch.column("leaf")[0].as_py()
            step = max(1, (1 << 21) // len(local.x))
            for at in range(0, len(x), step):
                a = x[at : at + step]
                d2 = np.zeros((len(a), len(local.x)))
                for c in range(a.shape[1]):
                    d2 += (a[:, c, None] - local.x[None, :, c]) ** 2
                d2[(theirs[None, :] == mine[at : at + step, None]) | (d2 > bound[at : at + step, None])] = np.inf
                kth = np.partition(d2, k - 1, 1)[:, k - 1] if d2.shape[1] > k else np.full(len(a), FAR)
                q, p = np.nonzero(d2 <= np.minimum(kth, FAR)[:, None])
                own = pa.array(q + at)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(own), batch.column("was").take(own), names.take(pa.array(p)), pa.array(np.full(len(p), here, np.int32)), pa.array(d2[q, p])], ["first", "leaf", "near", "near_leaf", "d2"]
                )

        made, extra = f"first {kind}, leaf int, near {kind}, near_leaf int, d2 double", ["k", "was", "r2"]
        own = self.points.select("leaf", "x", F.col("first").alias("k"), F.col("leaf").alias("was"), F.lit(FAR).alias("r2"), F.xxhash64("first").alias("q"))
        found = checkpointed(self.search(own, extra, run, made, few=True))
        if len(self.planes[0]):
            reach = found.groupBy(F.col("first").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.max("d2").alias("m"))
            asked = own.drop("r2", "leaf").join(reach, "k", "left").withColumn("r2", F.when(F.col("c") >= k, F.col("m")).otherwise(FAR)).drop("c", "m")
            further = self.sent(asked, lambda tree, x, r2: tree.balls(x, r2), "x", "r2").where("leaf <> was")
            found = found.unionAll(self.search(further, extra, run, made))
        order = Window.partitionBy("first").orderBy("d2", "near")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
