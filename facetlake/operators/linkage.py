"""Minimum spanning trees, single linkage and density clusters of tables of any size.

Boruvka's rounds: every component takes its shortest edge to another one, all at once; components at least halve.  Points
lie in the leaves of a kd-tree.  Where a component is sure to have its shortest edge inside its leaf (it is shorter than the
way to any other leaf), a leaf merges it by itself, round after round, so that few components are left for the rounds over
all leaves.  In these, a component's shortest edge within leaves bounds the search of its points in other leaves, and blocks
and leaves that lie in a query's own component are passed by.

Edges are ordered by length and then by both names, so no round closes a circle.  Points of equal coordinates are one point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .ranks import position
from .space import FAR, Local, Space, box_distance, descend, matrix, squared

#: Edges between components that are finished in one task.
FEW = 1 << 16


def rooted(parent: np.ndarray) -> np.ndarray:
    """The root of each number; of two that point to each other the smaller is one."""
    at = np.arange(len(parent))
    parent = np.where((parent[parent] == at) & (at < parent), at, parent)
    while ((up := parent[parent]) != parent).any():
        parent = up
    return parent


def foreign(local: Local, x: np.ndarray, mine: np.ndarray, theirs: np.ndarray, bound: np.ndarray, own: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
    """(component, d2, query, place) of the shortest edge of each component of queries to points of others, if within ``bound``.

    ``bound`` and ``own`` are per query: most squared length, and number of its name among ``names`` of the places.
    """
    starts = local.starts
    one = np.minimum.reduceat(theirs, starts)
    labels = local.tree.labels(np.where(one == np.maximum.reduceat(theirs, starts), one, -1))
    best = np.full(mine.max() + 1, np.inf)
    np.minimum.at(best, mine, bound)
    found: list[tuple[np.ndarray, ...]] = []

    def keep(q: np.ndarray, p: np.ndarray) -> None:
        other = theirs[p] != mine[q]
        q, p = q[other], p[other]
        d2 = squared(x[q], local.x[p])
        ok = d2 <= best[mine[q]]
        q, p, d2 = q[ok], p[ok], d2[ok]
        if len(q):
            found.append(first(mine[q], d2, q, p))
            np.minimum.at(best, found[-1][0], found[-1][1])

    def first(c: np.ndarray, d2: np.ndarray, q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = own[q], names[p]
        order = np.lexsort((np.maximum(a, b), np.minimum(a, b), d2, c))
        head = order[np.flatnonzero(np.diff(c[order], prepend=-1))]
        return c[head], d2[head], q[head], p[head]

    near = descend(local.planes, x)
    for at in range(0, len(x), 4096):
        keep(*local.rows(np.arange(at, min(at + 4096, len(x))), near[at : at + 4096]))
    for at in range(0, len(x), 1024):
        part = slice(at, at + 1024)
        q, b = local.tree.balls(x[part], best[mine[part]], labels, mine[part])
        for i, p in local.pieces(q, b):
            keep(i + at, p)
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, float, np.int64, np.int64))
    return first(*map(np.concatenate, zip(*found)))


def inside(local: Local, comp: np.ndarray, out2: np.ndarray, names: np.ndarray, limit: float) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """(components, edges (d2, place, place)) of a leaf, merged as long as an edge is shorter than the way out of the leaf."""
    edges = []
    open_ = np.ones(len(comp), bool)
    while True:
        comp = np.unique(comp, return_inverse=True)[1]
        way = np.full(comp.max() + 1, np.inf)
        np.minimum.at(way, comp, out2)
        ask = np.flatnonzero(open_)
        if not len(ask):
            return comp, edges
        c, d2, q, p = foreign(local, local.x[ask], comp[ask], comp, np.full(len(ask), limit), names[ask], names)
        safe = d2 < way[c]
        if not safe.any():
            return comp, edges
        closed = ~np.isin(comp, c[safe])  # such a component never gets a safe edge, nor does one that it joins
        c, d2, a, b = c[safe], d2[safe], ask[q[safe]], p[safe]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        one = np.unique(lo * len(comp) + hi, return_index=True)[1]
        edges.append((d2[one], lo[one], hi[one]))
        parent = np.arange(len(way))
        parent[c] = comp[b]
        comp = rooted(parent)[comp]
        open_ = ~np.isin(comp, comp[closed])


def boruvka(space: Space, limit: float = FAR) -> tuple[DataFrame, DataFrame]:
    """(first, comp), (a, b, d2): components of the space's points under edges of a squared length of at most ``limit``, each
    named by its least point, and the edges of their minimum spanning trees."""
    points = space.points
    kind, lo, hi = points.schema["first"].dataType.simpleString(), space.lo, space.hi

    def merge(local: Local, table: pa.RecordBatch, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        leaf = batch.column("at")[0].as_py()
        first = np.asarray(table.column("first").to_pandas())[local.order]
        by_name, names = np.unique(first, return_inverse=True)
        out2 = np.full(len(first), np.inf)  # squared way out of the leaf, as far as the leaf's edges can reach
        for k in np.flatnonzero((gap(lo, hi, leaf) <= squared(lo[leaf : leaf + 1], hi[leaf : leaf + 1])[0]) & (np.arange(len(lo)) != leaf)):
            out2 = np.minimum(out2, box_distance(local.x, lo[k : k + 1], hi[k : k + 1]))
        comp, edges = inside(local, np.arange(len(first)), out2, names, limit)
        least = np.full(comp.max() + 1, len(first))
        np.minimum.at(least, comp, names)
        type_ = table.schema.field("first").type
        columns = ["first", "comp", "a", "b", "d2"]
        none = pa.nulls(len(first), type_)
        yield pa.RecordBatch.from_arrays([pa.array(first, type_), pa.array(by_name[least[comp]], type_), none, none, pa.nulls(len(first), pa.float64())], columns)
        for d2, a, b in edges:
            none = pa.nulls(len(a), type_)
            yield pa.RecordBatch.from_arrays([none, none, pa.array(first[a], type_), pa.array(first[b], type_), pa.array(d2)], columns)

    leaves = points.select("leaf").distinct().withColumn("q", F.lit(0).cast("long")).withColumn("at", F.col("leaf")).withColumn("x", F.lit(None).cast("array<double>"))
    made = checkpointed(space.search(leaves, ["at"], merge, f"first {kind}, comp {kind}, a {kind}, b {kind}, d2 double", few=True))
    comps, edges = made.where("first is not null").select("first", "comp"), [made.where("a is not null").select("a", "b", "d2")]
    if len(lo) == 1:
        return comps, edges[0]
    held = [("comp", kind), ("other", kind), ("a", kind), ("b", kind)]

    def cross(local: Local, table: pa.RecordBatch, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        theirs, names = (np.asarray(table.column(c).to_pandas())[local.order] for c in ("comp", "first"))
        mine, own = (np.asarray(batch.column(c).to_pandas()) for c in ("mine", "a"))
        codes, all_names = (np.unique(np.concatenate(v), return_inverse=True) for v in ((theirs, mine), (names, own)))
        t, m = codes[1][: len(theirs)], codes[1][len(theirs) :]
        n, o = all_names[1][: len(names)], all_names[1][len(names) :]
        x = matrix(batch.column("x"))
        c, d2, q, p = foreign(local, x, m, t, np.asarray(batch.column("r2"), float), o, n)
        type_ = table.schema.field("first").type
        a, b = own[q], names[p]
        yield pa.RecordBatch.from_arrays([pa.array(v, type_) for v in (codes[0][c], theirs[p], np.where(a < b, a, b), np.where(a < b, b, a))] + [pa.array(d2)], [*[h for h, _ in held], "d2"])

    schema = ", ".join(f"{h} {k}" for h, k in held) + ", d2 double"
    least = F.min(F.struct("d2", "a", "b", "other")).alias("e")
    while True:
        here = checkpointed(points.join(comps, "first"))
        # leaves that lie in one component
        alone = here.groupBy("leaf").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c = d").collect()  # at most a row per leaf
        if len({r["c"] for r in alone}) <= 1 and here.select("comp").distinct().limit(2).count() < 2:
            break
        asked = here.select("leaf", "x", F.col("first").alias("a"), F.col("comp").alias("mine")).withColumn("q", F.monotonically_increasing_id()).withColumn("r2", F.lit(limit))
        extra = ["a", "mine", "r2"]
        found = checkpointed(space.search(asked, extra, cross, schema, here, ["comp"], few=True).groupBy("comp").agg(least))
        bound = asked.drop("r2").join(found.select(F.col("comp").alias("mine"), F.col("e.d2").alias("r2")), "mine", "left")
        pure = {r["leaf"]: r["c"] for r in alone}
        bound = bound.withColumn("r2", F.coalesce("r2", reach(space, pure, F.col("mine"), limit), F.lit(limit)))
        code = {c: k for k, c in enumerate(sorted(set(pure.values())))}
        of = np.array([code.get(pure.get(k), -1) for k in range(len(lo))])
        number = F.coalesce(F.create_map(*[F.lit(v) for kv in code.items() for v in kv])[F.col("mine")], F.lit(-2)) if code else F.lit(-2)
        bound = bound.withColumn("code", number).withColumnRenamed("leaf", "was")
        sent = space.sent(bound, lambda tree, x, r2, mine: tree.balls(x, r2, tree.labels(of), mine), "x", "r2", "code").where("leaf <> was").drop("was", "code")
        further = space.search(sent, extra, cross, schema, here, ["comp"]).groupBy("comp").agg(least)
        found = checkpointed(found.unionAll(further).groupBy("comp").agg(F.min("e").alias("e")))
        if found.isEmpty():
            break
        edges.append(checkpointed(found.select("e.a", "e.b", "e.d2").distinct()))
        joined = components(found.select(F.col("comp").alias("a"), F.col("e.other").alias("b")))
        comps = comps.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("first", F.coalesce("label", "comp").alias("comp"))
    taken = edges[0]
    for e in edges[1:]:
        taken = taken.unionAll(e)
    return here.select("first", "comp"), taken


def gap(lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """Squared distances of all boxes to the k-th."""
    d = np.maximum(np.maximum(lo - hi[k], lo[k] - hi), 0)
    d = np.where(np.isfinite(d), d, FAR ** 0.5 / lo.shape[1])
    return (d * d).sum(1)


def reach(space: Space, pure: dict, comp, limit: float):
    """A length within which a component that fills its leaves is sure to meet another one: to the far corner of a leaf."""
    bounds = {}
    for c in set(pure.values()):
        k = next(leaf for leaf, name in pure.items() if name == c)
        others = np.array([pure.get(m) != c and np.isfinite(space.lo[m]).all() for m in range(len(space.lo))])
        if others.any():
            d = np.maximum(np.abs(space.hi[others] - space.lo[k]), np.abs(space.hi[k] - space.lo[others]))
            bounds[c] = float(min(limit, (d * d).sum(1).min()))
    return F.create_map(*[F.lit(v) for kv in bounds.items() for v in kv])[comp] if bounds else F.lit(None).cast("double")


def components(edges: DataFrame) -> DataFrame:
    """node, label (its component's least node) of all nodes of edges (a, b).

    Each round hooks every node to its least neighbour if that is smaller, and goes on with edges between hooked nodes; what
    is left at ``FEW`` edges is finished in one task.
    """
    kind = edges.schema["a"].dataType.simpleString()
    sorted_ends = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = start = checkpointed(edges.select("a", "b"))
    left = checkpointed(sorted_ends(left))
    steps = []
    while left.count() > FEW:
        hook = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
        for _ in range(2):
            up = hook.select(F.col("node").alias("label"), F.col("label").alias("up"))
            hook = hook.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        steps.append(checkpointed(hook))
        for end in ("a", "b"):
            left = left.join(steps[-1].select(F.col("node").alias(end), F.col("label")), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
        left = checkpointed(sorted_ends(left))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        a, b = (np.asarray(table[c].to_pandas()) for c in ("a", "b"))
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j, label = ends[: len(a)], ends[len(a) :], np.arange(len(names))
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            for end in (i, j):
                np.minimum.at(new, end, low)
                np.minimum.at(new, label[end], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        type_ = table.schema.field("a").type
        yield pa.RecordBatch.from_arrays([pa.array(names, type_), pa.array(names[label], type_)], ["node", "label"])

    steps.append(checkpointed(left.repartition(1).mapInArrow(finish, f"node {kind}, label {kind}")))
    out = start.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    for step in steps:
        out = out.join(step.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return out


def spanning_tree(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """a, b (least keys of distinct points, a before b), length: a minimum spanning tree; ties by keys."""
    space = Space.of(df, columns, key)
    _, edges = boruvka(space)
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.sqrt("d2").alias("length"))


def single_linkage(df: DataFrame, columns: list[str], key: str, k: int | None = None, cut: float | None = None) -> DataFrame:
    """Row per row: key, cluster (0.. by least key): cut into ``k`` clusters, or where a link is longer than ``cut``.

    Null coordinates belong to no cluster (null).  Of equally long links the one of larger names is cut first.
    """
    if (k is None) == (cut is None):
        raise ValueError("give k or cut")
    space = Space.of(df, columns, key)
    comps, edges = boruvka(space, FAR if cut is None else float(cut) ** 2)
    if cut is None:
        ends = edges.select("d2", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        long = ends.orderBy(F.col("d2").desc(), F.col("a").desc(), F.col("b").desc()).limit(k - 1).select("a", "b")
        rest = components(ends.join(F.broadcast(long), ["a", "b"], "left_anti").select("a", "b"))
        comps = comps.select("first").join(rest.withColumnRenamed("node", "first"), "first", "left").select("first", F.coalesce("label", "first").alias("comp"))
    return labelled(df, space, columns, key, comps, 0)


def core_points(space: Space, eps: float, min_points: int) -> DataFrame:
    """first of all points with at least ``min_points`` rows within ``eps``, themselves included.

    Blocks are looked into nearest first, in twice as many at each go, and only until enough rows are found: first in the
    point's own leaf, then, if it has too few there, in the others.
    """
    r2 = float(eps) ** 2

    def count(local: Local, table: pa.RecordBatch, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, weight = matrix(batch.column("x")), np.asarray(table.column("n"))[local.order]
        box_lo, box_hi = local.tree.levels[-1]
        for at in range(0, len(x), 1024):
            a = x[at : at + 1024]
            n = np.zeros(len(a), np.int64)
            q, b = local.tree.balls(a, np.full(len(a), r2))
            order = np.lexsort((box_distance(a[q], box_lo[b], box_hi[b]), q))
            q, b = q[order], b[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            begin, end = 0, 2
            while (go := np.flatnonzero((place >= begin) & (n[q] < min_points))).size:
                go = go[place[go] < end]
                for i, p in local.pieces(q[go], b[go]):
                    ok = squared(a[i], local.x[p]) <= r2
                    n += np.bincount(i[ok], weight[p[ok]], len(a)).astype(np.int64)
                begin, end = end, 2 * end
            yield pa.RecordBatch.from_arrays([batch.column("a").slice(at, len(a)), pa.array(n)], ["first", "m"])

    schema = f"first {space.points.schema['first'].dataType.simpleString()}, m long"
    asked = space.points.select("leaf", "x", F.col("first").alias("a")).withColumn("q", F.monotonically_increasing_id())
    own = checkpointed(space.search(asked, ["a"], count, schema, few=True))
    core = own.where(F.col("m") >= min_points)
    if len(space.lo) > 1:
        few = own.where(F.col("m") < min_points).withColumnRenamed("first", "a")
        rest = asked.join(few, "a").withColumnRenamed("leaf", "was")
        sent = space.sent(rest, lambda tree, x: tree.balls(x, np.full(len(x), r2)), "x").where("leaf <> was")
        more = space.search(sent.select("leaf", "x", "a", "q"), ["a"], count, schema)
        core = core.unionAll(own.where(F.col("m") < min_points).unionAll(more).groupBy("first").agg(F.sum("m").alias("m")).where(F.col("m") >= min_points))
    return core.select("first")


def dbscan(df: DataFrame, columns: list[str], key: str, eps: float, min_points: int) -> DataFrame:
    """Row per row: key, cluster: -1 for noise (also rows with a null coordinate), else 1.. by smallest core key; a border
    row joins its smallest core cluster.

    Clusters are the components of core points under edges of at most ``eps``; no pair of rows is written.
    """
    space = Space.of(df, columns, key)
    flagged = checkpointed(space.points.join(core_points(space, eps, min_points).withColumn("core", F.lit(True)), "first", "left"))
    core = Space(columns, key, space.rows, space.planes, flagged.where("core").drop("core"), space.lo, space.hi)
    comps = checkpointed(boruvka(core, float(eps) ** 2)[0])
    kind, r2 = space.points.schema["first"].dataType.simpleString(), float(eps) ** 2

    def least(local: Local, table: pa.RecordBatch, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = matrix(batch.column("x"))
        names, label = np.unique(np.asarray(table.column("comp").to_pandas())[local.order], return_inverse=True)
        one = np.minimum.reduceat(label, local.starts)
        shared = local.tree.labels(np.where(one == np.maximum.reduceat(label, local.starts), one, -1))
        for at in range(0, len(x), 1024):
            a = x[at : at + 1024]
            best = np.full(len(a), len(names))
            near = descend(local.planes, a)
            rounds = [(np.arange(len(a)), near)]
            while rounds:
                for i, p in local.pieces(*rounds.pop()):
                    ok = squared(a[i], local.x[p]) <= r2
                    np.minimum.at(best, i[ok], label[p[ok]])
                if near is not None:  # then all blocks but those of the cluster that the nearest one gave
                    near = None
                    rounds.append(local.tree.balls(a, np.full(len(a), r2), shared, best.copy()))
            ok = np.flatnonzero(best < len(names))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok + at)), pa.array(names[best[ok]], table.schema.field("first").type)], ["first", "comp"])

    asked = flagged.where("core is null").select("x", F.col("first").alias("a")).withColumn("q", F.monotonically_increasing_id())
    sent = space.sent(asked, lambda tree, x: tree.balls(x, np.full(len(x), r2)), "x")
    border = space.search(sent, ["a"], least, f"first {kind}, comp {kind}", core.points.join(comps, "first"), ["comp"]).groupBy("first").agg(F.min("comp").alias("comp"))
    found = labelled(df, space, columns, key, comps, 1, border)
    return found.withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))


def labelled(df: DataFrame, space: Space, columns: list[str], key: str, comps: DataFrame, base: int, more: DataFrame | None = None) -> DataFrame:
    """key, cluster of all rows from (first, comp) of distinct points, numbered from ``base`` by name; ``more`` points have a
    component of these as well."""
    comps = checkpointed(comps)
    named = position(comps.select("comp").distinct(), "comp", name="_c").select("comp", (F.col("_c") + base).cast("long").alias("cluster"))
    points = (comps if more is None else comps.unionAll(more.select("first", "comp"))).join(named, "comp")
    point = space.points.join(points, "first").select("cluster", *[F.col("x")[n].alias(f"_x{n}") for n in range(len(columns))])
    return df.join(point, [F.col(c).cast("double") == F.col(f"_x{n}") for n, c in enumerate(columns)], "left").select(F.col(key), "cluster")
