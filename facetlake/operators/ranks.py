"""Ranks and quantile cuts that do not put all rows into one task.

A rank over the whole table is taken per range partition and shifted by the sizes of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """0-based place in the order of ``order`` (ties by no rule: give unique keys)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    # both branches below must see the same ranges
    part = checkpointed(part.withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.join(sizes.select("_p", before.alias("_b")), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def neighbours(df: DataFrame, value: str, *order: str) -> DataFrame:
    """``df`` with ``_pos``, ``_before`` and ``_after``: the value of the rows around each in the order of unique ``order``.

    Each row is sent to the three places that it touches, so no task holds the whole order.
    """
    placed = checkpointed(position(df, *order, name="_pos"))
    sent = placed.select(F.explode(F.array(F.struct((F.col("_pos") + 1).alias("to"), F.col(value).alias("b"), F.lit(None).cast(df.schema[value].dataType).alias("a")), F.struct((F.col("_pos") - 1).alias("to"), F.lit(None).cast(df.schema[value].dataType).alias("b"), F.col(value).alias("a")))).alias("s")).select("s.*")
    got = sent.groupBy(F.col("to").alias("_pos")).agg(F.max("b").alias("_before"), F.max("a").alias("_after"))
    return placed.join(got, "_pos", "left")


def dense_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """0-based dense rank: distinct values are ranked and joined back.  Null has no rank; its rows stay."""
    return df.join(position(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name=name), column, "left")


def linearize(df: DataFrame, column: str, name: str = "linear") -> DataFrame:
    """Evenly spaced between the extremes, in the order of the distinct values.  Null stays null; its rows stay."""
    ranked = position(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name="_r")
    b = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count_distinct(column).alias("_k"))
    spaced = ranked.crossJoin(F.broadcast(b)).select(column, F.when(F.col("_k") > 1, F.col("_lo") + F.col("_r") / (F.col("_k") - 1) * (F.col("_hi") - F.col("_lo"))).otherwise(F.col("_lo")).alias(name))
    return df.join(spaced, column, "left")


def quantile_split(df: DataFrame, column: str, key: str, quantiles: list[float]) -> DataFrame:
    """list: the slice floor(n * q) in which a row's place falls; the first and last quantile are 0 and 1."""
    q = [0.0, *quantiles[1:-1], 1.0]
    n = df.count()
    cuts = [int(n * x) for x in q[1:-1]]
    placed = position(df, column, key)
    return placed.withColumn("list", sum([(F.col("pos") >= c).cast("long") for c in cuts], F.lit(0).cast("long")))
