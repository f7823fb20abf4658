"""Derivation nodes: a registry of column builders that graphs and callers look up by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    name: str
    arity: int  # -1: any number
    build: Callable[..., Column]


NODES: dict[str, Node] = {}


def register(name: str, arity: int):
    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        NODES[name] = Node(name, arity, f)
        return f

    return put


def domain(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


for _name, _f in {
    "identity": lambda c: c, "cast_float": lambda c: c.cast("double"), "cast_index": lambda c: F.floor(c).cast("long"),
    "inverse": lambda c: F.try_divide(F.lit(1.0), c), "negate": lambda c: -c, "absolute": F.abs, "square": lambda c: c * c,
    "sqrt": lambda c: domain(c >= 0, F.sqrt(c)), "exp": F.exp, "log": lambda c: domain(c > 0, F.log(c)),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": lambda c: domain(F.abs(c) <= 1, F.asin(c)), "acos": lambda c: domain(F.abs(c) <= 1, F.acos(c)),
    "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double"),
}.items():
    register(_name, 1)(_f)

for _name, _f in {
    "plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "multiplication": lambda a, b: a * b, "division": F.try_divide,
    "pow": F.pow, "min": F.least, "max": F.greatest,
}.items():
    register(_name, 2)(_f)


@register("sum", -1)
def weighted_sum(*columns: Column, factors: list[float] | None = None) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(f)) for c, f in zip(columns, factors or [1.0] * len(columns))])


@register("product", -1)
def weighted_product(*columns: Column, exponents: list[float] | None = None) -> Column:
    return reduce(lambda a, b: a * b, [F.pow(c, F.lit(float(e))) for c, e in zip(columns, exponents or [1.0] * len(columns))])


@register("lp_norm", -1)
def lp_norm(*columns: Column, p: float = 2.0) -> Column:
    return F.pow(reduce(lambda a, b: a + b, [F.pow(F.abs(c), F.lit(float(p))) for c in columns]), F.lit(1.0 / p))


@register("clamp", 1)
def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


@register("normalize", 1)
def normalize(c: Column, lo: float, hi: float, inverse: bool = False) -> Column:
    hi = (hi + 1) * 1.1 if lo == hi else hi
    return c * (hi - lo) + lo if inverse else (c - lo) / (hi - lo)


@register("bubble_size", 1)
def bubble_size(c: Column, lo: float, hi: float, scale: str = "identity", normalized: bool = True) -> Column:
    v = (c - lo) / (hi - lo) if normalized else F.abs(c)
    return {"identity": v, "log": F.log(v + 1), "sqrt": F.sqrt(v)}[scale]


def reduction(value: Column, group: list[str], how: str) -> Column:
    """A group's aggregate, given to each of its rows."""
    f = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "stddev": F.stddev_pop, "product": F.product}[how]
    return f(value).over(Window.partitionBy(*group))


def difference(v: Column, behind: Column, ahead: Column, kind: str = "central", h: float = 1.0) -> Column:
    """Difference quotient; neighbours are clamped at the ends, the divisor is not."""
    ahead, behind = F.coalesce(ahead, v), F.coalesce(behind, v)
    return {"forward": (ahead - v) / h, "backward": (v - behind) / h, "central": (ahead - behind) / (2 * h)}[kind]


def derivative(value: str, dim: str, others: list[str], kind: str = "central", h: float = 1.0) -> Column:
    """Along ``dim`` in each line of ``others``; without others see ``stats.derivative``."""
    w = Window.partitionBy(*others).orderBy(dim)
    v = F.col(value)
    return difference(v, F.lag(v).over(w), F.lead(v).over(w), kind, h)


def hashed_uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) per key, the same in any engine: the first 48 bits of an MD5.  A null key counts as empty."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


# vectors of two to four components are arrays


def vec(*columns: Column) -> Column:
    return F.array(*columns)


def vec_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def vec_square(v: Column) -> Column:
    return F.transform(v, lambda x: x * x)


def vec_op(a: Column, b: Column, op: str) -> Column:
    return F.zip_with(a, b, NODES[op].build)
