"""Bin indexes as sparse bitmaps: a row per axis, bin and word of 64 ids with the ids' bits set.

Counts between axes and under brushes come from the index alone: words of equal ids meet in a join, the set bits of their
AND are summed in one aggregate.  A word meets at most 64 bins of another axis, whatever the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .histogram import Axis, bins


def bin_index(df: DataFrame, axes: list[Axis], key: str) -> DataFrame:
    """axis, bin, word, bits.  One pass for all axes; ids are whole numbers, a repeated id counts once, null ids and null
    values are in no bin."""
    each = F.explode(F.array(*[F.struct(F.lit(a[0]).alias("axis"), F.when(F.col(a[0]).isNotNull(), bins([a])).cast("long").alias("bin")) for a in axes]))
    k = F.col(key).cast("long")
    rows = df.where(k.isNotNull()).select(F.floor(k / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(cast(`{key}` as long), 64) as int))").alias("bit"), each.alias("x"))
    return rows.select("x.axis", "x.bin", "word", "bit").where("bin is not null").groupBy("axis", "bin", "word").agg(F.bit_or("bit").alias("bits"))


def pair_counts(index: DataFrame, a: str, b: str) -> DataFrame:
    """bin_a, bin_b, n: rows in both bins of two axes."""
    left = index.where(F.col("axis") == a).select(F.col("bin").alias("bin_a"), "word", F.col("bits").alias("x"))
    right = index.where(F.col("axis") == b).select(F.col("bin").alias("bin_b"), "word", F.col("bits").alias("y"))
    both = left.join(right, "word").withColumn("n", F.bit_count(F.col("x").bitwiseAND(F.col("y"))))
    return both.groupBy("bin_a", "bin_b").agg(F.sum("n").alias("n")).where("n > 0")


def brushed(index: DataFrame, brush: dict[str, list[int]]) -> DataFrame:
    """word, bits of the ids whose bins a brush names on every axis: OR within an axis, AND between them."""
    picked = [index.where((F.col("axis") == a) & F.col("bin").isin(chosen)).groupBy("word").agg(F.bit_or("bits").alias("bits")) for a, chosen in brush.items()]
    meet = lambda p, q: p.join(q.withColumnRenamed("bits", "_other"), "word").select("word", F.col("bits").bitwiseAND(F.col("_other")).alias("bits"))
    return reduce(meet, picked).where("bits <> 0")


def brushed_counts(index: DataFrame, brush: dict[str, list[int]], axis: str) -> DataFrame:
    """bin, n of an axis among the brushed ids."""
    chosen = brushed(index, brush).withColumnRenamed("bits", "x")
    n = F.bit_count(F.col("x").bitwiseAND(F.col("bits")))
    return index.where(F.col("axis") == axis).join(chosen, "word").groupBy("bin").agg(F.sum(n).alias("n")).where("n > 0")
