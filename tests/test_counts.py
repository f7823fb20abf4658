"""Kept histograms, bitmap indexes, bundles between axes and surface-area boxes, against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.operators import bitmaps, histogram as H, lists
from facetlake.streaming.kept import KeptHistogram

AXES = [("a", 0.0, 10.0, 5), ("b", 0.0, 1.0, 4)]


def rows(spark, n=700, seed=0):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, float(r.random() * 11 - 0.5), None if i % 50 == 0 else float(r.random())) for i in range(n)], "id long, a double, b double")


def as_dict(df):
    return {tuple(r[:-1]): r[-1] for r in df.collect()}


# kept histograms


def test_blocks_and_a_changed_brush(spark, tmp_path):
    df = rows(spark)
    df.repartition(3).write.parquet(f"{tmp_path}/blocks")
    kept = KeptHistogram(spark, f"file://{tmp_path}/counts", [AXES[0]])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/blocks")
    old, new = F.col("a") < 5, (F.col("a") > 2) & (F.col("b") < 0.5)
    kept.follow(stream, f"{tmp_path}/checkpoint", old).awaitTermination()
    assert len([n for n in kept.taken() if n.startswith("batch")]) == 3
    plain = lambda where: {k: n for k, n in as_dict(H.hist(df, [AXES[0]], where)).items()}
    assert as_dict(kept.counts()) == plain(old)
    assert kept.rebrush("b1", df, old, new) and as_dict(kept.counts()) == plain(new)
    assert not kept.rebrush("b1", df, old, new) and as_dict(kept.counts()) == plain(new)  # a change counts once
    assert kept.rebrush("b2", df, new, old) and as_dict(kept.counts()) == plain(old)
    assert len(kept.versions()) <= kept.keep + 1
    kept.drop()
    assert kept.versions() == [] and kept.counts().count() == 0


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    kept = KeptHistogram(spark, f"file://{tmp_path}/counts", [AXES[0]], keep=1)
    df = rows(spark, 60)
    for number in (0, 1, 1, 0, 2):
        kept.merge(f"batch{number}", kept.deltas(df.where(F.col("id") % 3 == number), F.lit(1)))
    assert as_dict(kept.counts()) == as_dict(H.hist(df, [AXES[0]])) and kept.taken() == {"batch0", "batch1", "batch2"}
    spark.range(1).write.parquet(f"{tmp_path}/counts/aside-000000003")  # left by a failed attempt
    kept.merge("batch3", kept.deltas(df, F.lit(-1)))
    assert kept.counts().count() == 0


def test_only_moved_rows_leave_the_scan(spark, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/t")
    kept = KeptHistogram(spark, f"file://{tmp_path}/counts", [AXES[0]])
    df = spark.read.parquet(f"{tmp_path}/t")
    was, now = F.coalesce(F.col("a") < 4, F.lit(False)), F.coalesce(F.col("a") < 5, F.lit(False))
    plan = kept.deltas(df.where((now & ~was) | (was & ~now)), F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:double>" in plan


# bitmaps


def test_bitmaps(spark, tmp_path):
    df = rows(spark).unionAll(rows(spark)).unionAll(spark.createDataFrame([(None, 1.0, 1.0), (-70, 9.0, 0.9)], "id long, a double, b double"))
    bitmaps.bin_index(df, AXES, "id").write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    one = df.where("id is not null").dropDuplicates(["id"])
    both = one.where("b is not null").groupBy(H.bins([AXES[0]]).alias("x"), H.bins([AXES[1]]).alias("y")).count()
    counted = bitmaps.pair_counts(index, "a", "b")
    assert as_dict(counted) == as_dict(both)
    some = one.where(H.bins([AXES[0]]).isin(1, 3) & H.bins([AXES[1]]).isin(0, 2) & F.col("b").isNotNull()).groupBy(H.bins([AXES[1]]).alias("x")).count()
    asked = bitmaps.brushed_counts(index, {"a": [1, 3], "b": [0, 2]}, "b")
    assert as_dict(asked) == as_dict(some)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "struct<axis:string,bin:bigint,word:bigint,bits:bigint>" in plan and "a:double" not in plan and "Python" not in plan
    assert bitmaps.bin_index(df.limit(0), AXES, "id").count() == 0


# bundles


def one_by_one(n, lo, hi):
    """Segments by walking the bins: a new one begins where counts rise after they fell."""
    value = [lo + b / (len(n) - 1) * (hi - lo) for b in range(len(n))]
    cuts, rising, last = [0], True, 0.0
    for b, v in enumerate(n):
        if not rising and v > last:
            cuts.append(b)
            rising = True
        if rising and v < last:
            rising = False
        last = v
    ends = [*[value[b] for b in cuts[1:]], hi]
    starts = [lo, *ends[:-1]]
    return [(s, e, np.average(value[a:b], weights=n[a:b])) for s, e, a, b in zip(starts, ends, cuts, [*cuts[1:], len(n)])]


@pytest.mark.parametrize("n", [[0, 0, 3, 5, 5, 2, 2, 4, 1], [5, 0, 0, 3, 3], [1, 2, 3, 4], [4, 3, 2, 2, 1], [1, 0, 1, 0, 1, 0, 1]])
def test_bundles_by_walking(spark, n):
    counts = spark.createDataFrame([("a", b, float(v)) for b, v in enumerate(n)], "axis string, bin long, n double")
    got = [(r["lo"], r["hi"], r["middle"]) for r in H.axis_bundles(counts, [("a", 0.0, 10.0, len(n))]).orderBy("segment").collect()]
    assert np.allclose(got, one_by_one(n, 0.0, 10.0))


def test_bundle_counts_add_up(spark):
    df = rows(spark)
    segments = H.axis_bundles(H.axis_counts(df, AXES), AXES)
    got = H.bundle_counts(df, segments, ["a", "b", "a"]).groupBy("a", "b").agg(F.sum("weight")).collect()
    assert {(r[0], r[1]): round(r[2], 6) for r in got} == {("a", "b"): 9.8, ("b", "a"): 9.8}  # one row in fifty has no b
    assert H.axis_bundles(H.axis_counts(df.limit(0), AXES), AXES).count() == 0


# boxes


def area_cut(v, lo, hi):
    v = np.sort(v)
    best = min(((x - lo) * (v <= x).sum() + (hi - x) * (v > x).sum(), x) for x in np.unique(v))
    return best[1]


def test_area_boxes(spark):
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(2, 0.1, (150, 2)), r.normal(8, 0.3, (50, 2))]).round(2)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double")
    lo, hi = x.min(0), x.max(0)
    m = area_cut(x[:, 0], lo[0], hi[0])
    want = {}
    for side, part in (("0", x[x[:, 0] < m]), ("1", x[x[:, 0] >= m])):
        k = area_cut(part[:, 1], lo[1], hi[1])
        ends = (lo[0], m) if side == "0" else (m, hi[0])
        for u, n, e in (("0", (part[:, 1] < k).sum(), (lo[1], k)), ("1", (part[:, 1] >= k).sum(), (k, hi[1]))):
            if n:
                want["r" + side + u] = (int(n), *ends, *e)
    got = {b["box"]: (b["n"], b["lo_a"], b["hi_a"], b["lo_b"], b["hi_b"]) for b in lists.fractures(df, ["a", "b"], 2, rule="area", bins=1 << 16).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_thin_boxes_stay_whole(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(64)], "a double, b double")
    got = lists.fractures(df, ["a"], 4, smallest=0.25).collect()
    assert sorted((r["box"], r["n"]) for r in got) == [(f"r{k:02b}00", 16) for k in range(4)]  # halved to a quarter, then left
    assert lists.fractures(df.limit(0), ["a"], 2, rule="area").count() == 0


# side order


def test_sides_and_their_order():
    shares = {("a", "b"): 0.9, ("a", "c"): 0.1, ("a", "d"): 0.5, ("b", "c"): 0.6, ("b", "d"): 0.2, ("c", "d"): 0.8}
    # a and b part first; then c and d: c overlaps b more than a, d the other way round
    assert H.side_order(shares, ["a", "b", "c", "d"]) == [("a", 0), ("b", 1), ("c", 0), ("d", 1)]
    assert H.side_order(shares, ["a", "b", "c", "d"], {"a": 1, "b": 9, "c": 5, "d": 2}) == [("c", 0), ("b", 1), ("a", 0), ("d", 1)]
    assert H.side_order(shares, ["a", "b", "c"]) == [("a", 0), ("b", 1), ("c", 0)]
    assert H.side_order({}, ["a", "b"]) == [("a", 1), ("b", 1)] and H.side_order({}, []) == []


def test_hierarchies_with_nulls(spark):
    from facetlake.operators import hierarchy

    df = rows(spark)
    top = hierarchy.level_centres(df, ["a", "b"], 2, 3, 3).where("level = 0").groupBy("axis").agg(F.sum("n")).collect()
    assert {r[0]: r[1] for r in top} == {"a": 700, "b": 686}
    assert hierarchy.combination_counts(df, ["a", "b"], 2, 4).agg(F.sum("n")).first()[0] == 686
    v = hierarchy.density_volume(df, ["a", "b"], 3, "a", ["id"])
    assert v.count() == 9 and hierarchy.density_histogram(v, 5).agg(F.sum("n")).first()[0] == 9
    assert hierarchy.level_centres(df.limit(0), ["a"], 2, 2, 2).count() == 0
