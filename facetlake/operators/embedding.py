"""t-SNE of tables of any size: sparse affinities, a bounded summary of the plane, forces leaf by leaf.

The rows' distinct places are dealt to the leaves of a kd-tree.  A place's affinities are those to its 3 x perplexity nearest
others, as edges that lie with the leaves of both ends.  In a round, every leaf sends the positions of its border places to the
leaves that hold an edge to them; a leaf's task sums up attraction along its edges.  Repulsion is summed up in tiles of the plane, to
which places are dealt anew in each round, from a tree over blocks of places (mass, centre, width): parts of it that look small from
a few places that lie together stand for all they hold.  Blocks are made in the input's leaves; up to ``BLOCKS`` places each is a block of its own,
beyond that a block holds as many as keep their number within four times ``BLOCKS``, which bounds what driver and tasks hold.

A leaf is one row: its places, speeds and edges are packed numbers.  A round moves positions, never edges, and writes one table; the one
before it is deleted.  A single leaf goes through all rounds in its task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed, remove, written
from .space import Space, kd_split

BLOCKS = 1 << 16
#: (place, part of the tree) pairs looked at in one go, if all parts are opened.
AT_ONCE = 1 << 22
#: Places that lie together and go down the tree as one.
TOGETHER = 16
#: Places of a task that sums up repulsion.
TILE = 1 << 10


def calibrated(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Gaussian affinities of each row's neighbours, of the perplexity asked for, by bisection."""
    d = d2 - d2.min(1, keepdims=True)
    beta, lo, hi, target = np.ones((len(d), 1)), np.zeros((len(d), 1)), np.full((len(d), 1), np.inf), math.log(perplexity)
    for _ in range(200):
        e = np.exp(-d * beta)
        s = e.sum(1, keepdims=True)
        off = np.log(s) + beta * (d * e).sum(1, keepdims=True) / s - target
        if (np.abs(off) < 1e-9).all():
            break
        lo, hi = np.where(off > 0, beta, lo), np.where(off > 0, hi, beta)
        beta = np.where(np.isinf(hi), np.minimum(beta * 2, 1e200), (lo + np.minimum(hi, 1e300)) / 2)
    return e / s


class Plane:
    """A tree over blocks in the order of a space-filling curve, four children a part."""

    def __init__(self, block: np.ndarray, n: np.ndarray, y: np.ndarray):
        order = np.argsort(block)
        self.block, self.own = block[order], y[order]
        self.low, self.span = y.min(0), np.maximum(np.ptp(y, 0), 1e-300)
        code = self.code(y)
        order = np.argsort(code, kind="stable")
        n, y = n[order].astype(float), y[order]
        self.cuts = np.unique(code[order][np.flatnonzero(np.diff(np.cumsum(n) // TILE)) + 1])
        lo = hi = y
        self.levels = [(n, y, np.zeros(len(n)))]
        while len(n) > 1:
            pad = -len(n) % 4
            n, y = np.append(n, np.zeros(pad)), np.vstack([y, np.zeros((pad, 2))])
            lo, hi = np.vstack([lo, np.full((pad, 2), np.inf)]), np.vstack([hi, np.full((pad, 2), -np.inf)])
            m = n.reshape(-1, 4)
            y = (m[:, :, None] * y.reshape(-1, 4, 2)).sum(1) / m.sum(1)[:, None]
            lo, hi, n = lo.reshape(-1, 4, 2).min(1), hi.reshape(-1, 4, 2).max(1), m.sum(1)
            self.levels.append((n, y, ((hi - lo) ** 2).max(1)))
        self.levels.reverse()

    def code(self, y: np.ndarray) -> np.ndarray:
        """The interleaved bits of both coordinates."""
        at = (np.clip((y - self.low) / self.span, 0, 1) * ((1 << 20) - 1)).astype(np.int64)
        code = np.zeros(len(y), np.int64)
        for bit in range(20):
            code |= ((at[:, 0] >> bit) & 1) << (2 * bit) | ((at[:, 1] >> bit) & 1) << (2 * bit + 1)
        return code

    def tile(self, y: np.ndarray) -> np.ndarray:
        """The stretch of the curve, of about ``TILE`` places, in which each position lies."""
        return np.searchsorted(self.cuts, self.code(y), "right")

    def push(self, y: np.ndarray, block: np.ndarray, theta: float) -> np.ndarray:
        """Repulsion (two columns) and the sum of kernels of each place; a place does not act on itself."""
        order = np.argsort(self.code(y), kind="stable")
        order = np.append(order, np.repeat(order[-1:], -len(y) % TOGETHER))
        groups, out = y[order].reshape(-1, TOGETHER, 2), np.empty((len(y), 3))
        step = 16 if theta >= 0.2 else max(1, AT_ONCE // (TOGETHER * len(self.block)))
        for at in range(0, len(groups), step):
            out[order[at * TOGETHER : (at + step) * TOGETHER]] = self.some(groups[at : at + step], theta).reshape(-1, 3)
        centre = self.own[np.searchsorted(self.block, block)]
        d = y - centre
        k = 1 / (1 + (d * d).sum(1))
        return out - np.column_stack([(k * k)[:, None] * d, k])

    def some(self, y: np.ndarray, theta: float) -> np.ndarray:
        """Sums for groups of places; a part is taken as one if it is small from the whole box of a group."""
        out, lo, hi = np.zeros((*y.shape[:2], 3)), y.min(1), y.max(1)
        q, b = np.arange(len(y)), np.zeros(len(y), np.int64)
        for depth, (n, centre, width) in enumerate(self.levels):
            if depth:
                q, b = np.repeat(q, 4), (4 * b[:, None] + np.arange(4)).ravel()
                there = b < len(n)
                q, b = q[there], b[there]
            take = np.ones(len(q), bool)
            if depth < len(self.levels) - 1:
                away = np.maximum(np.maximum(lo[q] - centre[b], centre[b] - hi[q]), 0)
                take = width[b] < theta * theta * (away * away).sum(1)
            i, j = q[take], b[take]
            if len(i):
                d0, d1 = y[i, :, 0] - centre[j, 0, None], y[i, :, 1] - centre[j, 1, None]
                k = 1 / (1 + d0 * d0 + d1 * d1)
                m = n[j, None] * k
                at = np.flatnonzero(np.diff(i, prepend=-1))
                for c, w in enumerate((m * k * d0, m * k * d1, m)):
                    out[i[at], :, c] += np.add.reduceat(w, at)
            q, b = q[~take], b[~take]
        return out


def affinities(space: Space, perplexity: float) -> DataFrame:
    """leaf, a, to, b, p: an edge per place and neighbour and the leaves of both, halved for both directions; all p add up to a half."""
    k, kind = max(1, int(3 * perplexity)), space.points.schema["first"].dataType.simpleString()
    near = space.k_nearest(k).groupBy("leaf", "first").agg(F.sort_array(F.collect_list(F.struct("d2", "near", "near_leaf"))).alias("s"))
    listed = near.select("leaf", F.col("first").alias("a"), F.col("s.near_leaf").alias("to"), F.col("s.near").alias("b"), F.col("s.d2").alias("d2"))

    def weigh(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(p=list(calibrated(np.stack(pdf.d2), perplexity))).drop(columns="d2")

    wide = listed.mapInPandas(weigh, f"leaf int, a {kind}, to array<int>, b array<{kind}>, p array<double>")
    return wide.select("leaf", "a", F.explode(F.arrays_zip("to", "b", "p")).alias("e")).select("leaf", "a", "e.to", "e.b", "e.p")


def blocks(space: Space, size: int) -> DataFrame:
    """first, leaf, block of all places; a block's name is its leaf and its number there."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        order, starts, _ = kd_split(np.stack(pdf.x), size)
        number = np.empty(len(pdf), np.int64)
        number[order] = np.searchsorted(starts, np.arange(len(pdf)), "right") - 1
        return pd.DataFrame({"first": pdf["first"], "leaf": pdf.leaf, "block": pdf.leaf.to_numpy(np.int64) * (1 << 32) + number})

    kind = space.points.schema["first"].dataType.simpleString()
    return space.points.select("first", "leaf", "x").groupBy("leaf").applyInPandas(cut, f"first {kind}, leaf int, block long")


def normal(key: Column, seed: int, column: int) -> Column:
    """A standard normal number by hash of a key."""
    one, two = (((F.pmod(F.xxhash64(key, F.lit(seed), F.lit(column), F.lit(part)), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)) for part in (0, 1))
    return F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * two)


def packed(v: np.ndarray, kind: type = float) -> bytes:
    return np.ascontiguousarray(v, kind).tobytes()


def unpacked(v: bytes, width: int = 2) -> np.ndarray:
    return np.frombuffer(v).reshape(-1, width)


def edges_by_leaf(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """leaf, own (names of its places in order), a, b, p, asked: all edges at the leaf's places.  ``a`` numbers its places; ``b``
    these and then those of other leaves, in the order of ``asked``: each leaf with the names that are wanted of it."""
    kind = placed.schema["first"].dataType.simpleString()
    both = lines.select("leaf", "a", "to", "b", "p").unionAll(lines.select(F.col("to").alias("leaf"), F.col("b").alias("a"), F.col("leaf").alias("to"), F.col("a").alias("b"), "p"))

    def pack(key: tuple, edges: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        leaf, own = key[0], places["first"].sort_values()
        at, out = pd.Index(own), edges.to.to_numpy() != key[0]
        far = edges.loc[out, ["to", "b"]].drop_duplicates().sort_values(["to", "b"])
        b = np.empty(len(edges), np.int32)
        b[~out], b[out] = at.get_indexer(edges.b[~out]), len(own) + pd.MultiIndex.from_frame(far).get_indexer(pd.MultiIndex.from_frame(edges.loc[out, ["to", "b"]]))
        asked = [(int(to), list(names.b)) for to, names in far.groupby("to")]
        return pd.DataFrame({"leaf": [leaf], "own": [list(own)], "a": [packed(at.get_indexer(edges.a), np.int32)], "b": [packed(b, np.int32)], "p": [packed(edges.p)], "asked": [asked]})

    schema = f"leaf int, own array<{kind}>, a binary, b binary, p binary, asked array<struct<leaf: int, names: array<{kind}>>>"
    return both.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInPandas(pack, schema)


def first_state(places: DataFrame, held: DataFrame) -> DataFrame:
    """leaf, y, u, g, block, to, picks: a leaf's positions, speeds, gains, block names, and the leaves to which it sends which places."""
    wanted = held.select(F.col("leaf").alias("dest"), F.explode("asked").alias("w")).select(F.col("w.leaf").alias("leaf"), "dest", F.col("w.names").alias("names"))

    def pack(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        rows, asks = rows.sort_values("first"), asks.sort_values("dest")
        at, y = pd.Index(rows["first"]), rows[["y0", "y1"]].to_numpy(float)
        picks = [packed(at.get_indexer(list(n)), np.int32) for n in asks.names]
        return pd.DataFrame({"leaf": [key[0]], "y": [packed(y)], "u": [packed(0 * y)], "g": [packed(0 * y + 1)], "block": [packed(rows.block, np.int64)], "to": [asks.dest.tolist()], "picks": [picks]})

    return places.groupBy("leaf").cogroup(wanted.groupBy("leaf")).applyInPandas(pack, "leaf int, y binary, u binary, g binary, block binary, to array<int>, picks array<binary>")


def centres(y: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, sizes and centres of blocks."""
    names, at, n = np.unique(block, return_inverse=True, return_counts=True)
    return names, n, np.column_stack([np.bincount(at, y[:, c]) / n for c in (0, 1)])


def pulls(y: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Attraction of the first ``n`` positions along edges."""
    d = y[a] - y[b]
    w = (p / (1 + (d * d).sum(1)))[:, None] * d
    return np.column_stack([np.bincount(a, w[:, c], n) for c in (0, 1)])


def step(y: np.ndarray, u: np.ndarray, g: np.ndarray, pull: np.ndarray, push: np.ndarray, z: float, it: int, iterations: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, speeds and gains after round ``it``."""
    early = it <= iterations // 4
    slope = 4 * ((12.0 if early else 1.0) * pull - push / (z or 1.0))
    g = np.maximum(np.where(np.sign(slope) != np.sign(u), g + 0.2, g * 0.8), 0.01)
    u = (0.5 if early else 0.8) * u - rate * g * slope
    return y + u, u, g


def edges_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.a, np.int32), np.frombuffer(row.b, np.int32), np.frombuffer(row.p)


STATE = "leaf int, y binary, u binary, g binary, block binary, to array<int>, picks array<binary>"


def alone(state: DataFrame, held: DataFrame, iterations: int, theta: float, rate: float) -> DataFrame:
    """All rounds of a single leaf in its task."""

    def run(rows: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        row, edges = rows.iloc[0], edges_of(lines.iloc[0])
        y, u, g, block = *(unpacked(row[c]) for c in "yug"), np.frombuffer(row.block, np.int64)
        for it in range(iterations):
            f = Plane(*centres(y, block)).push(y, block, theta)
            y, u, g = step(y, u, g, pulls(y, len(y), *edges), f[:, :2], f[:, 2].sum(), it, iterations, rate)
        return rows.assign(y=[packed(y)])

    return state.groupBy("leaf").cogroup(held.groupBy("leaf")).applyInPandas(run, STATE)


def forces(state: DataFrame, held: DataFrame, plane: Plane, theta: float) -> tuple[DataFrame, str]:
    """``state`` with f (pull and push of each place) and z, written."""
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast(plane)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: by number, not by size

    def send(batches):
        for pdf in batches:
            out = [pdf.assign(source=-1)]
            for row in pdf.itertuples():
                y = unpacked(row.y)
                for to, p in zip(row.to, row.picks):
                    out.append(pd.DataFrame([(to, packed(y[np.frombuffer(p, np.int32)]), None, None, None, [], [], row.leaf)], columns=out[0].columns))
            yield pd.concat(out)

    def deal(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                y, block = unpacked(row.y), np.frombuffer(row.block, np.int64)
                tile = shared.value.tile(y)
                order = np.argsort(tile, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
                    out.append((tile[at[0]], row.leaf, packed(at, np.int64), packed(y[at]), packed(block[at], np.int64)))
            yield pd.DataFrame(out, columns=["tile", "leaf", "at", "y", "block"])

    def repel(rows: pd.DataFrame) -> pd.DataFrame:
        push = shared.value.push(unpacked(b"".join(rows.y)), np.frombuffer(b"".join(rows.block), np.int64), theta)
        ends = np.cumsum([len(v) // 8 for v in rows["at"]])
        return pd.DataFrame({"leaf": rows.leaf, "y": [packed(v) for v in np.split(push, ends[:-1])], "block": rows["at"]})

    def run(lines: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows, pushed = rows[rows.source > -2].sort_values("source"), rows[rows.source == -2]
        y = np.vstack([unpacked(v) for v in rows.y])  # its own places come first, then those of other leaves in their order
        row, push = rows.iloc[:1], np.empty((len(rows.block.iloc[0]) // 8, 3))
        push[np.frombuffer(b"".join(pushed.block), np.int64)] = unpacked(b"".join(pushed.y), 3)
        pull = pulls(y, len(push), *edges_of(lines.iloc[0]))
        return row.drop(columns="source").assign(f=[packed(np.hstack([pull, push[:, :2]]))], z=[push[:, 2].sum()])

    tiles = state.mapInPandas(deal, "tile int, leaf int, at binary, y binary, block binary").repartition(tasks, "tile")
    tiles = tiles.groupBy("tile").applyInPandas(repel, "leaf int, y binary, block binary").withColumn("source", F.lit(-2))
    sent = state.mapInPandas(send, f"{STATE}, source int").unionByName(tiles, allowMissingColumns=True).repartition(tasks, "leaf")
    f, path = written(held.groupBy("leaf").cogroup(sent.groupBy("leaf")).applyInPandas(run, f"{STATE}, f binary, z double"))
    shared.destroy()
    return f, path


def moved(f: DataFrame, z: float, it: int, iterations: int, rate: float) -> DataFrame:
    """The state after a round."""

    def run(batches):
        for pdf in batches:
            new = []
            for row in pdf.itertuples():
                w = unpacked(row.f, 4)
                new.append([packed(v) for v in step(unpacked(row.y), unpacked(row.u), unpacked(row.g), w[:, :2], w[:, 2:], z, it, iterations, rate)])
            yield pdf.drop(columns=["f", "z"]).assign(**{c: [v[k] for v in new] for k, c in enumerate("yug")})

    return f.mapInPandas(run, STATE)


def plane_of(state: DataFrame) -> Plane:
    """The summary of all positions: blocks, whose number is bounded."""

    def run(batches):
        for pdf in batches:
            made = [centres(unpacked(row.y), np.frombuffer(row.block, np.int64)) for row in pdf.itertuples()]
            yield pd.DataFrame({"block": [packed(b, np.int64) for b, _, _ in made], "n": [packed(n, np.int64) for _, n, _ in made], "y": [packed(y) for _, _, y in made]})

    t = state.mapInPandas(run, "block binary, n binary, y binary").toArrow().to_pydict()
    return Plane(*(np.frombuffer(b"".join(t[c]), np.int64) for c in ("block", "n")), unpacked(b"".join(t["y"])))


def tsne(df: DataFrame, columns: list[str], key: str, perplexity: float = 30, iterations: int = 250, theta: float = 0.5, seed: int = 0, rate: float = 200, rows: int = 1 << 10) -> DataFrame:
    """key, x, y of all rows.  Early exaggeration 12 and momentum 0.5 in the first quarter, then 1 and 0.8.

    Rows of equal coordinates share a place, which counts once; rows with a null, NaN or infinite coordinate have null x and y.
    Fewer than 3 x perplexity + 1 places raise ``ValueError``; a null key finds its place by its coordinates.  ``theta`` is
    the largest width by distance of a part that is taken as one; 0 opens all.
    """
    space = Space.of(df, columns, key, rows)
    n = space.points.count()
    if n - 1 < 3 * perplexity or not n:
        raise ValueError("too few rows for this perplexity")
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    lines = affinities(space, perplexity).withColumn("p", F.col("p") / (2 * n))
    placed = checkpointed(blocks(space, -(-n // BLOCKS)))
    held = checkpointed(edges_by_leaf(checkpointed(lines), placed))
    start = placed.withColumns({f"y{c}": 1e-4 * normal(F.col("first"), seed, c) for c in (0, 1)})
    state, path = written(first_state(start, held))
    if len(space.lo) == 1:
        state = checkpointed(alone(state, held, iterations, theta, rate))
    else:
        # kept by leaf for all rounds; a part that is lost with its executor is read again from the written table
        edges = held.select("leaf", "a", "b", "p").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "leaf").persist()
        try:
            for it in range(iterations):
                f, new = forces(state, edges, plane_of(state), theta)
                remove(spark, path)
                path = new
                state = moved(f, f.agg(F.sum("z")).first()[0], it, iterations, rate)
        finally:
            edges.unpersist()

    def listed(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                y = unpacked(row.y)
                yield pd.DataFrame({"first": list(row.own), "y0": y[:, 0], "y1": y[:, 1]})

    ends = checkpointed(state.select("leaf", "y").join(held.select("leaf", "own"), "leaf").mapInPandas(listed, f"first {kind}, y0 double, y1 double"))
    middle = ends.agg(F.avg("y0"), F.avg("y1")).first()
    point = space.points.join(ends, "first").select(
        (F.col("y0") - middle[0]).alias("_y0"), (F.col("y1") - middle[1]).alias("_y1"), *[F.col("x")[c].alias(f"_x{c}") for c in range(len(columns))]
    )
    own = df.select(F.col(key), *[F.col(c).cast("double").alias(f"_c{c_}") for c_, c in enumerate(columns)])
    return own.join(point, [F.col(f"_c{c}") == F.col(f"_x{c}") for c in range(len(columns))], "left").select(F.col(key), F.col("_y0").alias("x"), F.col("_y1").alias("y"))
