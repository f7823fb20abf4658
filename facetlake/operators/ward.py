"""Ward's agglomeration along one column, for tables of any size.

On a line only neighbours merge, and what a cluster takes in on its far side makes it no nearer to the one on its near side.
So two neighbours that are nearer to each other than to those beyond them merge in any case, whatever else merges before, and
parts of the line can be gone through at once: each knows the clusters on both sides of it as they stood before the round, which
are at least as far away later.  A gap between two values closes at the cost of one merge; costs rise towards the root, so
``k`` clusters are what the ``k`` - 1 costliest gaps leave apart.

What is left of a part waits for a cheaper merge across its border; borders lie elsewhere in the next round.  Rounds are few unless gaps
grow steadily along the line, where parts wait for each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .ranks import position
from .space import Space


def merged(part: list[tuple], left: bool, right: bool) -> tuple[list[tuple], list[tuple]]:
    """(clusters left, gaps closed) of a stretch of clusters (lo, centre, n, name) in order; ``left`` and ``right`` say that the
    first and the last belong to other parts.  Gaps are (lo of the upper cluster, cost, lesser name, greater name)."""
    far = (np.inf,)

    def cost(a: tuple, b: tuple) -> tuple:
        d = b[1] - a[1]
        return 2.0 * a[2] * b[2] / (a[2] + b[2]) * d * d, min(a[3], b[3]), max(a[3], b[3])

    stack, below, gaps = [], [], []  # below: each cluster's cost to the one under it
    for cluster in part if right else [*part, None]:
        todo = [cluster]
        while todo:
            here = todo.pop()
            above = cost(stack[-1], here) if stack and here is not None else far
            if len(stack) > 1 + left and below[-1] < above and below[-1] < below[-2]:
                b, a, price = stack.pop(), stack.pop(), below.pop()
                below.pop()
                gaps.append((b[0], *price))
                n = a[2] + b[2]
                todo += [here, (a[0], (a[2] * a[1] + b[2] * b[1]) / n, n, price[1])]
            else:
                stack.append(here)
                below.append(above)
    return stack[left : len(stack) - 1], gaps


def gaps(points: DataFrame, rows: int) -> DataFrame:
    """lo, cost, a, b of every gap between distinct values (lo, centre, n, name): its upper end and the merge that closes it."""
    kind = points.schema["name"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        own = pdf.side.to_numpy() == 0
        rest, closed = merged(list(zip(*(pdf[c].tolist() for c in ("lo", "centre", "n", "name")))), not own[0], not own[-1]) if own.any() else ([], [])
        names = ["lo", "centre", "n", "name", "cost", "other"]
        return pd.DataFrame([(*r, None, None) for r in rest] + [(lo, None, None, a, c, b) for lo, c, a, b in closed], columns=names).astype({"n": "Int64"})

    half, found, turn, left = rows // 2, [], 0, points.count()
    while left > 1:
        placed = position(points, "lo", name="at").withColumn("at", F.col("at") + half * (turn % 2)) if left > rows else points.withColumn("at", F.lit(half))
        part, place = F.floor(F.col("at") / rows), F.col("at") % rows
        to = lambda p, side: F.struct(p.alias("part"), F.lit(side).alias("side"))
        sent = F.array(to(part, 0), F.when(place == 0, to(part - 1, 1)), F.when(place == rows - 1, to(part + 1, -1)))
        dealt = placed.withColumn("to", F.explode(sent)).where("to is not null").select("lo", "centre", "n", "name", "to.*")
        made = checkpointed(dealt.groupBy("part").applyInPandas(run, f"lo double, centre double, n long, name {kind}, cost double, other {kind}"))
        found.append(made.where("cost is not null").select("lo", "cost", F.col("name").alias("a"), F.col("other").alias("b")))
        points, turn = made.where("cost is null").drop("cost", "other"), turn + 1
        left = points.count()
    out = found[0] if found else points.select("lo", F.lit(0.0).alias("cost"), F.col("name").alias("a"), F.col("name").alias("b")).limit(0)
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def ward_line(df: DataFrame, column: str, key: str, k: int, rows: int = 1 << 16) -> DataFrame:
    """Row per row: key, cluster (0.. by least key): Ward's agglomeration of a column into ``k`` clusters, ties by the least keys.

    Rows without a finite value belong to no cluster (null).  Equal values merge first, those of the least key before others;
    so they are apart only if there are fewer values than ``k``.  Keys are unique.
    """
    own = df.select(F.col(key).alias("key"), F.col(column).cast("double").alias("x"))
    there = own.where(Space.there(["x"]) & F.col("key").isNotNull())
    points = checkpointed(there.groupBy("x").agg(F.min("key").alias("name"), F.count(F.lit(1)).alias("n")))
    cuts = [r["lo"] for r in gaps(points.select(F.col("x").alias("lo"), F.col("x").alias("centre"), "n", "name"), rows).orderBy(F.desc("cost"), F.desc("a"), F.desc("b")).limit(k - 1).collect()]  # k - 1 numbers
    at = np.sort(np.array(cuts, float))

    @F.pandas_udf("long")
    def piece(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, x.to_numpy(float), "right"))

    rows_ = own.withColumn("piece", F.when(Space.there(["x"]), piece("x"))).withColumn("alone", F.lit(None).cast(df.schema[key].dataType))
    spare = k - 1 - len(cuts)
    if spare:  # the last rows of equal values stay alone
        last = there.join(points.where("n > 1").select("x", "name"), "x").where("key > name").orderBy(F.desc("name"), F.desc("key")).limit(spare)
        rows_ = rows_.join(last.select("key", F.lit(True).alias("_last")), "key", "left").withColumn("alone", F.when(F.col("_last"), F.col("key"))).drop("_last")
    least = rows_.where("piece is not null and key is not null").groupBy("piece", "alone").agg(F.min("key").alias("least"))
    named = position(least, "least", name="cluster").select(F.col("piece").alias("_p"), F.col("alone").alias("_a"), F.col("cluster").cast("long").alias("cluster"))
    joined = rows_.join(named, (F.col("piece") == F.col("_p")) & F.col("alone").eqNullSafe(F.col("_a")), "left")
    return joined.select(F.col("key").alias(key), "cluster")
