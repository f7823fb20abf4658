"""Brushes and splits as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def in_ranges(column: str, ranges: list[tuple[float, float]], eps: float = 0.0) -> Column:
    """Inclusive ranges, any of which will do."""
    return any_of([F.col(column).between(lo - eps, hi + eps) for lo, hi in ranges])


def in_lasso(x: str, y: str, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule; a polygon without points accepts every row."""
    if not polygon:
        return F.lit(True)
    px, py, crossings = F.col(x), F.col(y), F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay == by:
            continue
        at = F.lit(float(ax)) + (py - F.lit(float(ay))) * F.lit((bx - ax) / (by - ay))
        crossings = crossings + F.when(((py < ay) != (py < by)) & (px < at), 1).otherwise(0)
    return crossings % 2 == 1


def in_boxes(boxes: list[dict[str, tuple[float, float]]]) -> Column:
    """Any axis-aligned box."""
    return any_of([all_of([F.col(c).between(lo, hi) for c, (lo, hi) in box.items()]) for box in boxes])


def in_gaussian(columns: list[str], mean: list[float], axes: list[list[float]], variances: list[float], scale: float, bounds: list[tuple[float, float]] | None = None) -> Column:
    """Principal-axis distance: sum of squared scores over variances at most scale squared times the rank.

    An axis without variance does not count towards it; with ``bounds`` its score must lie inside.
    """
    total, rank, inside = F.lit(0.0), 0, F.lit(True)
    for n, (axis, var) in enumerate(zip(axes, variances)):
        score = reduce(lambda a, b: a + b, [F.lit(float(w)) * (F.col(c) - F.lit(float(m))) for w, c, m in zip(axis, columns, mean)])
        if var > 1e-12:
            total, rank = total + score * score / F.lit(float(var)), rank + 1
        elif bounds:
            inside = inside & score.between(*map(float, bounds[n]))
    return (total <= F.lit(scale * scale * rank)) & inside


@dataclass
class Brush:
    """Ranges hold per axis (any) and over axes (all); every lasso must accept."""

    ranges: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    lassos: list[tuple[str, str, list[tuple[float, float]]]] = field(default_factory=list)
    active: bool = True

    def column(self) -> Column:
        return all_of([in_ranges(c, r) for c, r in self.ranges.items()] + [in_lasso(*x) for x in self.lassos])


def to_global(local: Brush) -> Brush:
    """A copy of a local brush's ranges and lassos for all lists."""
    return Brush({c: list(r) for c, r in local.ranges.items()}, [(x, y, list(p)) for x, y, p in local.lassos], local.active)


def combine(brushes: list[Brush], mode: str = "and") -> Column:
    """No active brush accepts all rows; ``or`` with brushes that all refuse refuses."""
    parts = [b.column() for b in brushes if b.active]
    if not parts:
        return F.lit(True)
    if mode == "xor":
        return reduce(lambda a, b: a != b, parts)
    return any_of(parts) if mode == "or" else all_of(parts)


def active(global_brush: Column, local_brush: Column, mode: str = "and", immune: bool = False) -> Column:
    if immune:
        return local_brush
    return global_brush | local_brush if mode == "or" else global_brush & local_brush


def uniform_bin(v: Column, lo: float, hi: float, n: int) -> Column:
    """Rounded, so the first and last bins are half as wide."""
    return F.least(F.greatest(F.floor((v - lo) / (hi - lo) * (n - 1) + 0.5), F.lit(0)), F.lit(n - 1)).cast("long")


def value_bin(v: Column, values: list[float]) -> Column:
    return F.least(reduce(lambda a, b: a + b, [(v >= t).cast("int") for t in values]), F.lit(len(values) - 1)).cast("long")


def hist_bin(v: Column, lo: float, hi: float, n: int) -> Column:
    """Outliers fold into the edge bins."""
    return F.floor(F.least(F.greatest((v - lo) / (hi - lo) * n, F.lit(0.0)), F.lit(float(n - 1)))).cast("long")


def priority(v: Column, centre: float, width: float) -> Column:
    """255 at the centre, 0 at ``width`` or more away."""
    return (255 - F.least(F.floor(F.abs(v - centre) / width * 255 + 0.5), F.lit(255))).cast("long")


def alpha(count: Column, a: float, mode: str) -> Column:
    """Opacity of a bin from its count; base 1 - (1 - a) ** count."""
    base = 1 - F.pow(F.lit(1 - a), count)
    return {
        "multiplicative": base, "bounded": F.greatest(base, F.lit(0.03)), "constant": F.lit(a), "square": base * base,
        "sqrt": F.sqrt(base), "log": F.log(base + 1), "complement": (1 - F.exp(1 - count)) * a, "adoption": a * count,
    }[mode]
