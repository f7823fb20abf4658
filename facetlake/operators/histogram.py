"""Binned aggregation: histograms, their registry, smoothing, distances and segments."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.brush import hist_bin

Axis = tuple[str, float, float, int]  # column, low, high, bins


def bins(axes: list[Axis]) -> Column:
    """Linear position, the first axis fastest."""
    parts, stride = [], 1
    for c, lo, hi, n in axes:
        parts.append(hist_bin(F.col(c), lo, hi, n) * stride)
        stride *= n
    return reduce(lambda a, b: a + b, parts)


def hist(df: DataFrame, axes: list[Axis], where: Column | None = None, value: Column | None = None, how: str = "count") -> DataFrame:
    """bin and its count (or sum, min, max of ``value``) over active rows; one partial and one final aggregate."""
    df = df if where is None else df.where(where)
    f = {"count": F.count(F.lit(1)), "sum": F.sum(value) if value is not None else None, "min": F.min(value) if value is not None else None, "max": F.max(value) if value is not None else None}[how]
    return df.groupBy(bins(axes).alias("bin")).agg(f.alias("n"))


def dense(counts: DataFrame, n: int) -> DataFrame:
    """With a zero for each empty bin."""
    return counts.sparkSession.range(n).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def hist_many(df: DataFrame, keys: dict[str, list[Axis]], where: Column | None = None) -> DataFrame:
    """Many histograms in one scan: hist, bin, n."""
    df = df if where is None else df.where(where)
    rows = F.array(*[F.struct(F.lit(k).alias("hist"), bins(a).alias("bin")) for k, a in keys.items()])
    return df.select(F.explode(rows).alias("r")).groupBy("r.hist", "r.bin").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Registry:
    """Histograms that several views ask for; equal ones, whatever the order of their axes, are computed once."""

    known: dict[tuple, tuple[str, int]] = field(default_factory=dict)

    def register(self, axes: list[Axis]) -> str:
        key = tuple(sorted(axes))
        name, uses = self.known.get(key, ("|".join(f"{c}:{n}" for c, _, _, n in key), 0))
        self.known[key] = (name, uses + 1)
        return name

    def release(self, axes: list[Axis]) -> None:
        key = tuple(sorted(axes))
        name, uses = self.known[key]
        if uses > 1:
            self.known[key] = (name, uses - 1)
        else:
            del self.known[key]

    def compute(self, df: DataFrame, where: Column | None = None) -> DataFrame:
        return hist_many(df, {name: list(key) for key, (name, _) in self.known.items()}, where)


def smooth(counts: DataFrame, n: int, sigma: float, skip_first: bool = False, log: bool = False) -> DataFrame:
    """Gaussian over ceil(3 sigma) bins to each side, renormalised at the edges.  ``counts`` is dense and small.

    A negative sigma takes a radius of a fifth of the bins plus one and twice the variance as 2.  ``skip_first`` leaves
    bin 0 out, ``log`` takes log(v + 1) of the smoothed values.
    """
    import math

    r, spread2 = (math.ceil(3 * sigma), 2 * sigma * sigma) if sigma >= 0 else (int(0.2 * n + 1), 2.0)
    kernel = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / spread2) if k else 1.0).alias("w")) for k in range(-r, r + 1)]))
    counts = counts.where("bin > 0") if skip_first else counts
    spread = counts.select("bin", "n", kernel.alias("x")).select((F.col("bin") + F.col("x.k")).alias("bin"), (F.col("n") * F.col("x.w")).alias("v"), F.col("x.w").alias("w"))
    out = spread.where(F.col("bin").between(int(skip_first), n - 1)).groupBy("bin").agg((F.sum("v") / F.sum("w")).alias("v"))
    return out.withColumn("v", F.log(F.col("v") + 1)) if log else out


def area_and_maximum(smoothed: DataFrame) -> DataFrame:
    return smoothed.agg(F.sum("v").alias("area"), F.max("v").alias("maximum"))


def violins(counts: DataFrame, scale: str = "self") -> DataFrame:
    """hist, bin, v: counts by the maximum of their own histogram (``self``), of the attribute's ones (``attribute``, a
    column) or of all (``global``)."""
    by = {"self": ["hist"], "attribute": ["attribute"], "global": []}[scale]
    top = counts.groupBy(*by).agg(F.max("n").alias("_m"))
    joined = counts.join(F.broadcast(top), by) if by else counts.crossJoin(F.broadcast(top))
    return joined.select("hist", "bin", (F.col("n") / F.col("_m")).alias("v"))


def paired(df: DataFrame, axes: list, where: Column) -> DataFrame:
    """bin, n (all rows) and m (rows that the condition accepts), from one scan."""
    return df.groupBy(bins(axes).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(where).alias("m"))


def paired_overlap(p: DataFrame) -> DataFrame:
    return p.agg(F.coalesce(F.sum(F.least("n", "m")), F.lit(0)).cast("long").alias("overlap"))


def paired_chi_square(p: DataFrame) -> DataFrame:
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return p.agg((F.sum(F.when(n + m > 0, (m - n) * (m - n) / (n + m))) / 2 / F.sum(n)).alias("distance"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("n", "m"), "bin").agg(F.coalesce(F.sum(F.least("n", "m")), F.lit(0)).cast("long").alias("overlap"))


def chi_square(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the sum of squared differences over sums, by the first histogram's total."""
    j = a.join(b.withColumnRenamed("n", "m"), "bin", "full").select(F.coalesce("n", F.lit(0)).cast("double").alias("n"), F.coalesce("m", F.lit(0)).cast("double").alias("m"))
    term = F.when(F.col("n") + F.col("m") > 0, (F.col("m") - F.col("n")) * (F.col("m") - F.col("n")) / (F.col("n") + F.col("m")))
    return j.agg((F.sum(term) / 2 / F.sum("n")).alias("distance"))


def bundles(counts: DataFrame) -> DataFrame:
    """Segments between valleys of a dense histogram: first, last, weighted middle, rows."""
    w = Window.orderBy("bin")
    d = counts.withColumn("before", F.lag("n").over(w)).withColumn("after", F.lead("n").over(w))
    valley = (F.col("n") < F.col("before")) & (F.col("n") <= F.col("after"))
    d = d.withColumn("segment", F.sum(F.when(valley, 1).otherwise(0)).over(w).cast("long"))
    return d.groupBy("segment").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.when(F.sum("n") > 0, F.sum(F.col("bin") * F.col("n")).cast("double") / F.sum("n")).alias("middle"), F.sum("n").cast("long").alias("n"))


def axis_counts(df: DataFrame, axes: list[Axis]) -> DataFrame:
    """axis, bin, n, dense, of several axes from one scan."""
    each = F.explode(F.array(*[F.struct(F.lit(a[0]).alias("axis"), F.when(F.col(a[0]).isNotNull(), bins([a])).cast("long").alias("bin")) for a in axes]))
    found = df.select(each.alias("x")).select("x.*").where("bin is not null").groupBy("axis", "bin").agg(F.count(F.lit(1)).alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(a[0]).alias("axis"), F.lit(a[3]).alias("bins")) for a in axes]))
    all_bins = df.sparkSession.range(1).select(cells.alias("x")).select("x.axis", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x.bins").cast("long") - 1)).alias("bin"))
    return all_bins.join(found, ["axis", "bin"], "left").select("axis", "bin", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


def smooth_axes(counts: DataFrame, sigma: float) -> DataFrame:
    """Each axis of ``axis_counts`` under a Gaussian over ceil(3 sigma) bins to each side, renormalised at the edges."""
    import math

    r = math.ceil(3 * sigma)
    kernel = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / (2 * sigma * sigma))).alias("w")) for k in range(-r, r + 1)]))
    spread = counts.select("axis", "bin", "n", kernel.alias("x")).select("axis", (F.col("bin") + F.col("x.k")).alias("bin"), (F.col("n") * F.col("x.w")).alias("v"), F.col("x.w").alias("w"))
    return spread.join(counts.select("axis", "bin"), ["axis", "bin"], "left_semi").groupBy("axis", "bin").agg((F.sum("v") / F.sum("w")).alias("n"))


def axis_bundles(counts: DataFrame, axes: list[Axis]) -> DataFrame:
    """axis, segment, lo, hi, middle: a segment ends where counts rise again after they fell, at the value of that bin.

    The first segment begins at the axis's lower bound, the last one ends at the upper; the middle is the mean of the bins'
    values by their counts (bin b of n stands for b / (n - 1) of the way).  An axis without rows has no segment.
    """
    w = Window.partitionBy("axis").orderBy("bin")  # histograms: some rows an axis
    of = F.create_map(*[x for name, lo, hi, n in axes for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in (lo, hi, n)]))])[F.col("axis")]
    value = F.col("bin") / (of[2] - 1) * (of[1] - of[0]) + of[0]
    step = F.signum(F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0.0)))
    d = counts.withColumn("step", F.when(step != 0, step)).withColumn("was", F.last("step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("begins", (F.col("step") > 0) & (F.coalesce("was", F.lit(0.0)) < 0)).withColumn("segment", F.sum(F.col("begins").cast("long")).over(w))
    s = d.groupBy("axis", "segment").agg(F.min(value).alias("lo"), (F.sum(value * F.col("n")) / F.sum("n")).alias("middle"), F.sum("n").alias("m")).where("m > 0")
    after = Window.partitionBy("axis").orderBy("segment")
    return s.select("axis", "segment", F.when(F.col("segment") == 0, of[0]).otherwise(F.col("lo")).alias("lo"), F.coalesce(F.lead("lo").over(after), of[1]).alias("hi"), "middle")


def bundle_counts(df: DataFrame, segments: DataFrame, order: list[str]) -> DataFrame:
    """a, b, from, to, weight: rows (times 10 over all rows) from each segment of an axis to those of the next one.

    Segments are a few numbers per axis and go into the scan as constants; one pass counts all neighbouring axes.  A value
    on the border of two segments belongs to the lower one; a null lies in none.
    """
    ends: dict[str, list[float]] = {}
    for r in segments.orderBy("axis", "segment").collect():  # at most half the bins of each axis
        ends.setdefault(r["axis"], []).append(float(r["hi"]))

    def segment(axis: str) -> Column:
        inner = ends.get(axis, [0.0])[:-1]
        return F.when(F.col(axis).isNotNull(), sum([(F.col(axis) > x).cast("long") for x in inner], F.lit(0).cast("long")))

    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), segment(a).alias("from"), segment(b).alias("to")) for a, b in zip(order[:-1], order[1:])]))
    counted = df.select(pairs.alias("x")).select("x.*").groupBy("a", "b", "from", "to").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy("a", "b").agg(F.sum("n").alias("all"))
    return counted.where(F.col("from").isNotNull() & F.col("to").isNotNull()).join(F.broadcast(whole), ["a", "b"]).select("a", "b", "from", "to", (F.col("n") * 10.0 / F.col("all")).alias("weight"))


def sides(overlaps: dict[tuple[str, str], int]) -> list[tuple[str, str]]:
    """Greedy pairing of the attributes that overlap most, for opposite sides."""
    out, used = [], set()
    for (a, b), _ in sorted(overlaps.items(), key=lambda x: (-x[1], x[0])):
        if not {a, b} & used:
            out.append((a, b))
            used |= {a, b}
    return out


def pair_overlaps(counts: DataFrame) -> DataFrame:
    """a, b, overlap, share of all pairs of axes of ``axis_counts`` with equal numbers of bins: common rows bin by bin, and
    their least share of either axis."""
    total = counts.groupBy("axis").agg(F.sum("n").alias("all"))
    named = counts.join(F.broadcast(total), "axis")
    left, right = (named.select(F.col("axis").alias(x), "bin", F.col("n").alias(f"n{x}"), F.col("all").alias(f"all{x}")) for x in ("a", "b"))
    both = left.join(right, "bin").where("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("overlap"), F.max(F.greatest("alla", "allb")).alias("most"))
    return both.select("a", "b", F.col("overlap").cast("long").alias("overlap"), F.when(F.col("most") > 0, F.col("overlap") / F.col("most")).otherwise(0.0).alias("share"))


def side_order(shares: dict[tuple[str, str], float], axes: list[str], area: dict[str, float] | None = None) -> list[tuple[str, int]]:
    """(axis, side) in drawing order: the two axes that overlap most go to opposite sides, so that what each side then
    overlaps at worst is least, and so on; a last one goes where it overlaps less.  With ``area``, each side draws large
    areas first.  Works on one number per pair of axes."""
    share = lambda a, b: shares.get((min(a, b), max(a, b)), 0.0)
    left, side, order = list(axes), {}, []

    def worst(axis: str, at: int) -> float:
        return max((share(axis, o) for o in order if side[o] == at), default=0.0)

    while len(left) > 1:
        value, _, a, b = max((share(a, b), -i, a, b) for i, (a, b) in enumerate((a, b) for n, a in enumerate(left) for b in left[n + 1 :]))
        if value <= 0:
            break
        first = not order or worst(a, 0) + worst(b, 1) < worst(a, 1) + worst(b, 0)
        side[a], side[b] = (0, 1) if first else (1, 0)
        order += [a, b]
        left = [x for x in left if x not in (a, b)]
    for a in left:  # one that is left over, or axes that overlap nothing
        side[a] = 0 if worst(a, 0) < worst(a, 1) else 1
        order.append(a)
    if area is not None:
        by = {s: iter(sorted((a for a in order if side[a] == s), key=lambda a: (-area[a], a))) for s in (0, 1)}
        order = [next(by[side[a]]) for a in order]
    return [(a, side[a]) for a in order]


def voxel_smooth(voxels: DataFrame, axis: str, sigma: float) -> DataFrame:
    """One axis of a separable Gaussian of radius int(3 sigma); other columns than ``axis`` and v are kept."""
    import math

    r = int(3 * sigma)
    kernel = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / (2 * sigma * sigma))).alias("w")) for k in range(-r, r + 1)]))
    total = sum(math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1))
    rest = [c for c in voxels.columns if c not in (axis, "v")]
    s = voxels.select(*rest, axis, "v", kernel.alias("_k")).select(*rest, (F.col(axis) + F.col("_k.k")).alias(axis), (F.col("v") * F.col("_k.w")).alias("v"))
    return s.groupBy(*rest, axis).agg((F.sum("v") / total).alias("v"))


def voxel_smooth_all(voxels: DataFrame, sigma: float, axes: tuple[str, ...] = ("x", "y", "z"), keep_ones: bool = False) -> DataFrame:
    """All axes in turn; ``keep_ones`` sets voxels that were 1 back to 1."""
    out = voxels
    for axis in axes:
        out = voxel_smooth(out, axis, sigma)
    if keep_ones:
        ones = voxels.where("v = 1").select(*axes, F.lit(1.0).alias("_one"))
        out = out.join(ones, list(axes), "left").withColumn("v", F.coalesce("_one", "v")).drop("_one")
    return out


def voxel_brush(densities: DataFrame, ranges: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Adds ``active``: every range of every axis must hold (unlike a brush on rows); a null density never does."""
    from ..functions.brush import all_of

    return densities.withColumn("active", F.coalesce(all_of([F.col(c).between(lo, hi) for c, r in ranges.items() for lo, hi in r]), F.lit(False)))


def voxel_lines(voxels: DataFrame) -> DataFrame:
    """z, y, line: the comma-joined 0 and 1 of a row of voxels by x, for writing as text."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", F.col("v").cast("int").alias("v")))), lambda s: s["v"].cast("string")), ",")
    return voxels.groupBy("z", "y").agg(line.alias("line"))


def bin_bitmaps(df: DataFrame, axis: tuple[str, float, float, int], key: str) -> DataFrame:
    """bin, bucket, bitmap: the ids of each bin as compressed-index bitmaps of 32,768 ids (ids from 1)."""
    return df.groupBy(bins([axis]).alias("bin"), F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bitmap"))
