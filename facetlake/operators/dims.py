"""Row ids, dimensions and layout inflation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which the smaller side of an inflation is broadcast.
BROADCAST_ROWS = 100_000


def dim_of(row_id: Column, sizes: list[int], i: int) -> Column:
    """Index along dimension i, the last dimension running fastest."""
    stride = 1
    for s in sizes[i + 1 :]:
        stride *= s
    return F.pmod(F.floor(row_id / stride), F.lit(sizes[i])).cast("long")


def row_id(dims: list[Column], sizes: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for d, s in zip(dims, sizes):
        out = out * s + d
    return out


def subsample(df: DataFrame, rules: dict[str, tuple[int, int, int]]) -> DataFrame:
    """(low, high, stride) per dimension, high exclusive; the rest is numbered anew."""
    for d, (lo, hi, k) in rules.items():
        c = F.col(d)
        df = df.where((c >= lo) & (c < hi) & ((c - lo) % k == 0)).withColumn(d, F.floor((c - lo) / k).cast("long"))
    return df


def slice_at(df: DataFrame, dim: str, index: int) -> DataFrame:
    return df.where(F.col(dim) == index).drop(dim)


def inflate(a: DataFrame, b: DataFrame, dims_a: list[str], dims_b: list[str]) -> DataFrame:
    """Columns over the union of both layouts: join on shared dimensions, or repeat where none is shared."""
    shared = [d for d in dims_a if d in dims_b]
    if shared:
        return a.join(b, shared)
    if b.count() > BROADCAST_ROWS:
        raise ValueError("the side to repeat is too large")
    return a.crossJoin(F.broadcast(b))


def random_draws(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """About one row in k, the same ones in each run."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)) == 0)
