"""Storage transforms: wavelet, quantiser, run lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantize(v: Column, step: float, dead_zone: bool = False) -> Column:
    """Signed quantum; the dead zone truncates toward zero."""
    q = F.floor(F.abs(v) / step + (0.0 if dead_zone else 0.5))
    return (F.signum(v) * q).cast("long")


def zigzag(q: Column) -> Column:
    return F.when(q < 0, -2 * q - 1).otherwise(2 * q)


def unzigzag(s: Column) -> Column:
    return F.when(s % 2 == 1, -F.floor((s + 1) / 2)).otherwise(F.floor(s / 2)).cast("long")


def unquantize(q: Column, step: float, dead_zone: bool = False) -> Column:
    """Value of a quantum; with a dead zone the middle of its interval."""
    return F.signum(q) * (F.abs(q) + (0.5 if dead_zone else 0.0)) * step


def zero_runs(df: DataFrame, key: str, symbol: str, group: str) -> DataFrame:
    """Non-zero symbols with the zeros before each; trailing zeros go.  Sequences are per group."""
    w = Window.partitionBy(group).orderBy(key)
    d = df.withColumn("_i", F.row_number().over(w)).where(F.col(symbol) != 0)
    w = Window.partitionBy(group).orderBy("_i")
    return d.select(group, key, symbol, (F.col("_i") - F.coalesce(F.lag("_i").over(w), F.lit(0)) - 1).cast("long").alias("zeros"))


def runs(df: DataFrame, key: str, symbol: str, group: str) -> DataFrame:
    """group, start key, symbol, repeats - 1."""
    w = Window.partitionBy(group).orderBy(key)
    d = df.withColumn("_new", F.when(F.lag(symbol).over(w).eqNullSafe(F.col(symbol)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return d.groupBy(group, "_run").agg(F.min(key).alias("start"), F.first(symbol).alias("symbol"), (F.count(F.lit(1)) - 1).cast("long").alias("repeats")).drop("_run")


def split_runs(found: DataFrame, most: int) -> DataFrame:
    """``runs`` cut so that none repeats more than ``most`` times: part numbers the pieces from 0."""
    parts = F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("repeats") / (most + 1))), lambda k: F.least(F.lit(most).cast("long"), F.col("repeats") - k * (most + 1))))
    return found.select(*[c for c in found.columns if c != "repeats"], parts.alias("part", "repeats")).where("repeats >= 0")


#: Lifting steps of the 5/3 and 9/7 wavelets and the latter's scale (fixed values).
LIFTS = {"5/3": ((-0.5, 0.25), 1.0), "9/7": ((-1.586134342, -0.05298011854, 0.8829110762, 0.4435068522), 1.149604398)}


def lifted(df: DataFrame, key: str, value: str, group: str, kind: str = "9/7") -> DataFrame:
    """group, pos, w: one wavelet level of each group's values by unique ``key``, mirrored at the ends, low band first.

    Every lifting step looks at both neighbours, so all steps share one sort of the group.
    """
    steps, scale = LIFTS[kind]
    w = Window.partitionBy(group).orderBy("_i")
    d = df.select(group, (F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1).alias("_i"), F.col(value).cast("double").alias("_x"))
    for n, by in enumerate(steps):
        left, right = F.lag("_x").over(w), F.lead("_x").over(w)
        both = F.coalesce(left, right) + F.coalesce(right, left)
        d = d.withColumn("_x", F.when((F.col("_i") % 2 == 1 - n % 2) & both.isNotNull(), F.col("_x") + by * both).otherwise(F.col("_x")))
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    even = F.col("_i") % 2 == 0
    place = F.when(even, F.floor(F.col("_i") / 2)).otherwise(F.floor((size + 1) / 2) + F.floor(F.col("_i") / 2))
    return d.select(group, place.cast("long").alias("pos"), F.when(size < 2, F.col("_x")).when(even, F.col("_x") * scale).otherwise(F.col("_x") / scale).alias("w"))


def unlifted(coded: DataFrame, group: str, kind: str = "9/7") -> DataFrame:
    """group, i, x: the values in their order that ``lifted`` made (group, pos, w) of: its steps backwards."""
    steps, scale = LIFTS[kind]
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    half = F.floor((size + 1) / 2)
    low = F.col("pos") < half
    place = F.when(low, F.col("pos") * 2).otherwise((F.col("pos") - half) * 2 + 1).cast("long")
    d = coded.select(group, place.alias("_i"), F.when(size < 2, F.col("w")).when(low, F.col("w") / scale).otherwise(F.col("w") * scale).alias("_x"))
    w = Window.partitionBy(group).orderBy("_i")
    for n, by in reversed(list(enumerate(steps))):
        left, right = F.lag("_x").over(w), F.lead("_x").over(w)
        both = F.coalesce(left, right) + F.coalesce(right, left)
        d = d.withColumn("_x", F.when((F.col("_i") % 2 == 1 - n % 2) & both.isNotNull(), F.col("_x") - by * both).otherwise(F.col("_x")))
    return d.select(group, F.col("_i").alias("i"), F.col("_x").alias("x"))


def _lift(x: np.ndarray, odd: bool, w: float) -> None:
    ext = np.pad(x, 1, mode="reflect") if len(x) > 1 else np.pad(x, 1, mode="edge")
    at = np.arange(int(odd), len(x), 2)
    x[at] += w * (ext[at] + ext[at + 2])


def dwt(x: np.ndarray, kind: str = "9/7") -> np.ndarray:
    """One level with mirrored edges; the low band comes first."""
    x, (steps, scale) = np.array(x, float), LIFTS[kind]
    if len(x) < 2:
        return x
    for n, w in enumerate(steps):
        _lift(x, n % 2 == 0, w)
    return np.concatenate([x[::2] * scale, x[1::2] / scale])


def idwt(y: np.ndarray, kind: str = "9/7") -> np.ndarray:
    y, (steps, scale) = np.array(y, float), LIFTS[kind]
    if len(y) < 2:
        return y
    x = np.empty_like(y)
    half = (len(y) + 1) // 2
    x[::2], x[1::2] = y[:half] / scale, y[half:] * scale
    for n, w in reversed(list(enumerate(steps))):
        _lift(x, n % 2 == 0, -w)
    return x
