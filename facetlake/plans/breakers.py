"""Nodes that need a whole column: they end a stage of a derivation graph.

``table`` nodes turn a few numbers of their whole layout into an expression, ``group`` nodes give each row an aggregate of
its group, ``frame`` nodes add columns by operators of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nodes import difference, normalize
from ..operators import ranks, stats
from ..operators.lineage import checkpointed


@dataclass(frozen=True)
class Breaker:
    kind: str  # table, group or frame
    arity: int  # -1: any number
    #: table: (columns, params) -> {name: aggregate}; group: (value, params) -> aggregate
    gather: Callable | None = None
    #: table: (columns, numbers, params) -> {suffix of the output's name: column}; frame: (df, inputs, dims, name, params) -> df
    build: Callable | None = None
    #: how many columns the node gives; None: one of the node's own name
    width: Callable[[dict], int | None] = lambda params: None


def _bounds(columns: list[Column], params: dict) -> dict[str, Column]:
    return {"lo": F.min(columns[0]).cast("double"), "hi": F.max(columns[0]).cast("double")}


def _normalized(columns: list[Column], found: dict, params: dict) -> dict[str, Column]:
    return {"": normalize(columns[0], found["lo"], found["hi"], **params) if found["lo"] is not None else F.lit(None).cast("double")}


def _moments(columns: list[Column], params: dict) -> dict[str, Column]:
    out = {f"mean{i}": F.avg(x) for i, x in enumerate(columns)}
    return out | {f"cov{i}_{j}": F.covar_samp(columns[i], columns[j]) for i in range(len(columns)) for j in range(i, len(columns))}


def _projected(columns: list[Column], found: dict, params: dict) -> dict[str, Column]:
    k = len(columns)
    m = np.array([[found[f"cov{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    axes = stats.principal_axes(m)[0]
    return {str(n): sum((F.lit(float(w)) * (x - F.lit(found[f"mean{i}"])) for i, (w, x) in enumerate(zip(axes[n], columns))), F.lit(0.0)) for n in range(params.get("k", k))}


def _reduced(value: Column, params: dict) -> Column:
    how = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "stddev": F.stddev_pop, "product": F.product, "count": F.count}
    return how[params.get("how", "sum")](value)


def _ranked(df: DataFrame, inputs: list[str], dims: tuple[str, ...], name: str, params: dict) -> DataFrame:
    return ranks.dense_rank(df, inputs[0], name=name)


def _derived(df: DataFrame, inputs: list[str], dims: tuple[str, ...], name: str, params: dict) -> DataFrame:
    """Along ``dim`` on each line of the other dimensions; neighbours are the next coordinates that the line has."""
    dim, kind, h = params["dim"], params.get("kind", "central"), params.get("h", 1.0)
    others = [d for d in dims if d != dim]
    if not others:
        return stats.derivative(df, inputs[0], dim, kind, h, name)
    w, v = Window.partitionBy(*others).orderBy(dim), F.col(inputs[0])
    return df.withColumn(name, difference(v, F.lag(v).over(w), F.lead(v).over(w), kind, h))


def keyed(df: DataFrame, dims: tuple[str, ...]) -> tuple[DataFrame, str]:
    """A written table with one key column: the only dimension, or a place in the order of all of them."""
    return (checkpointed(df), dims[0]) if len(dims) == 1 else (checkpointed(ranks.position(df, *dims, name="_key")), "_key")


def _means(df: DataFrame, inputs: list[str], dims: tuple[str, ...], name: str, params: dict) -> DataFrame:
    df, key = keyed(df, dims)
    centres = params.get("centres") or stats.initial_centres(df, inputs, key, params["k"], params.get("init", "forgy"), params.get("seed", 0))
    out, _ = stats.kmeans(df, inputs, centres, params.get("iterations", 20), params.get("metric", "squared"))
    return out.withColumnRenamed("cluster", name).drop("_key")


def _dense(df: DataFrame, inputs: list[str], dims: tuple[str, ...], name: str, params: dict) -> DataFrame:
    df, key = keyed(df, dims)
    return df.join(stats.dbscan(df, inputs, key, params["eps"], params["min_points"]).withColumnRenamed("cluster", name), key, "left").drop("_key")


BREAKERS: dict[str, Breaker] = {
    "normalization": Breaker("table", 1, _bounds, _normalized),
    "pca": Breaker("table", -1, _moments, _projected, lambda params: params["k"]),
    "reduction": Breaker("group", 2, _reduced),
    "rank": Breaker("frame", 1, build=_ranked),
    "derivative": Breaker("frame", 1, build=_derived),
    "kmeans": Breaker("frame", -1, build=_means),
    "dbscan": Breaker("frame", -1, build=_dense),
}
