"""Hierarchies of cells: centres of every axis on every level, counts of attribute combinations, densities of voxels.

One scan finds the finest cells of all axes; coarser levels are sums of these, as a level has a whole multiple of the cells
of the one above.  Values are scaled to [0, 1] by bounds that are given or found in one aggregate; the upper bound lies in the
last cell; rows with a null value are in no cell of that axis.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bounds = dict[str, tuple[float, float]]


def bounds_of(df: DataFrame, axes: list[str]) -> Bounds:
    row = df.agg(*[x for a in axes for x in (F.min(a).cast("double").alias(f"lo|{a}"), F.max(a).cast("double").alias(f"hi|{a}"))]).first()
    return {a: (row[f"lo|{a}"] or 0.0, row[f"hi|{a}"] or 0.0) for a in axes}


def scaled(axis: str, bounds: Bounds) -> Column:
    lo, hi = bounds[axis]
    v = F.col(axis).cast("double")
    return (v - lo) / (hi - lo) if hi > lo else F.when(v.isNotNull(), 0.0)


def cell(v: Column, cells: int) -> Column:
    return F.when(v.isNotNull(), F.least(F.greatest(F.floor(v * cells), F.lit(0)), F.lit(cells - 1))).cast("long")


def level_centres(df: DataFrame, axes: list[str], start: int, factor: int, levels: int, bounds: Bounds | None = None) -> DataFrame:
    """axis, level, cell, n, centre, lo, hi (scaled): level l has start * factor ** l cells; the centre is the mean."""
    bounds = bounds or bounds_of(df, axes)
    finest = start * factor ** (levels - 1)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), scaled(a, bounds).alias("v")) for a in axes]))
    fine = df.select(each.alias("x")).select("x.axis", "x.v", cell(F.col("x.v"), finest).alias("k")).where("k is not null")
    fine = fine.groupBy("axis", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    up = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("k") / factor ** (levels - 1 - n)).cast("long").alias("cell")) for n in range(levels)]))
    all_levels = fine.select("axis", "n", "s", "lo", "hi", up.alias("x")).groupBy("axis", "x.level", "x.cell")
    return all_levels.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("centre"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def combination_counts(df: DataFrame, axes: list[str], k: int, cells: int, bounds: Bounds | None = None) -> DataFrame:
    """axes (their names), cells (one per axis), n: rows in each cell of every combination of ``k`` axes, from one scan."""
    bounds = bounds or bounds_of(df, axes)
    at = {a: cell(scaled(a, bounds), cells) for a in axes}
    each = F.explode(F.array(*[F.struct(F.lit(",".join(c)).alias("axes"), F.array(*[at[a] for a in c]).alias("cells")) for c in combinations(axes, k)]))
    rows = df.select(each.alias("x")).select("x.axes", "x.cells").where(~F.exists("cells", lambda v: v.isNull()))
    return rows.groupBy("axes", "cells").agg(F.count(F.lit(1)).alias("n"))


def density_volume(df: DataFrame, axes: list[str], cells: int, value: str, order: list[str], bounds: Bounds | None = None) -> DataFrame:
    """x, y, z, ... (a cell per axis) and v: the scaled value of each voxel's last row by ``order`` (then by value)."""
    bounds = bounds or bounds_of(df, [*axes, value])
    names = ["x", "y", "z", "w"][: len(axes)]
    rows = df.select(*[cell(scaled(a, bounds), cells).alias(n) for a, n in zip(axes, names)], F.struct(*[F.col(o) for o in order], scaled(value, bounds).alias("_v")).alias("last"))
    rows = rows.where(" and ".join(f"{n} is not null" for n in names) + " and last._v is not null")
    return rows.groupBy(*names).agg(F.max("last").alias("last")).select(*names, F.col("last._v").alias("v"))


def density_histogram(volume: DataFrame, bins: int) -> DataFrame:
    """bin, n of the voxels' values, to the nearest of ``bins`` steps."""
    return volume.groupBy(F.floor(F.col("v") * (bins - 1) + 0.5).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
