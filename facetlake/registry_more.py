"""Queries over lists, kd boxes, further statistics, volumes, codecs and sources, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import brush as B
from .operators import codec, histogram as H, lists, ranks, stats
from .operators.lineage import shared_dir
from .plans.graph import Graph
from .registry import AXES, P1, PENTAGON, VOX, X_SQL, bin_sql, by_list, c, grouped, grouped_sql, lasso_sql, load, query, symbols, voxels, xyz
from .sources import dataset, tables

# lists ----------------------------------------------------------------------------------------------------------
MD5 = "CAST(('0x' || substr(md5({x} || '|{seed}'), 1, {n})) AS BIGINT)"
query("hash_subsample", "orders", f"SELECT o_orderkey FROM orders WHERE {MD5.format(x='o_orderkey', seed=3, n=7)} % 10 = 0")(lambda df: lists.hash_subsample(df, "o_orderkey", 10, 3).select("o_orderkey"))
query(
    "draws_with_replacement", "part",
    f"WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part), d AS (SELECT range AS draw, {MD5.format(x='range', seed=0, n=12)} % (SELECT count(*) FROM part) AS pos FROM range((SELECT (count(*) + 6) // 7 FROM part))) SELECT draw, p_partkey FROM d JOIN p ON d.pos = p.pos",
)(lambda df: lists.draws(df, "p_partkey", 7).select("draw", "p_partkey"))
SPLIT = "SELECT CAST(least(greatest(floor((l_extendedprice - 900) / 104100 * 7 + 0.5), 0), 7) AS BIGINT) AS list, l_extendedprice FROM lineitem"
split = lambda df: df.withColumn("list", B.uniform_bin(c("l_extendedprice"), 900.0, 105000.0, 8))
query("split_named", "lineitem", f"SELECT printf('price %02d of 8', list) AS name, count(*) AS n FROM ({SPLIT}) GROUP BY 1")(lambda df: lists.named(by_list(split(df), "l_extendedprice"), "list", "price %02d of 8").select("name", "n"))
query("drawlist_alpha", "lineitem", f"SELECT list, count(*) AS n, least(greatest(1 / (count(*) * 0.01), 1e-6), 1) AS alpha FROM ({SPLIT}) GROUP BY 1")(lambda df: lists.drawlists(split(df), "list", 0.01))
query("load_behaviour", "orders", "SELECT (o_orderkey - 2) // 3 AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 2 AND 8999 AND (o_orderkey - 2) % 3 = 0")(lambda df: lists.on_load(df, "price", {"o_orderkey": (2, 9000, 3)}))
query("brush_local_to_global", "lineitem", grouped_sql(f"l_quantity BETWEEN 5 AND 20 AND {lasso_sql('l_quantity', 'l_extendedprice', PENTAGON)}"))(lambda df: grouped(df.where(B.active(B.to_global(B.Brush({"l_quantity": [(5, 20)]}, [("l_quantity", "l_extendedprice", PENTAGON)])).column(), F.lit(True)))))


@query("attribute_intersection", None, "SELECT nationkey, acctbal FROM (SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier)")
def _(spark, d):
    short = lambda t: (lambda df: df.toDF(*[x.split("_", 1)[1] for x in df.columns]))(load(spark, d, t))
    return lists.joint([short("customer").drop("custkey", "name"), short("supplier")])


@query("remove_unused_dims", None, "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    grid = load(spark, d, "nation").select("n_nationkey", "n_name").crossJoin(F.broadcast(load(spark, d, "region").select("r_regionkey", "r_name")))
    return lists.without(grid, ["r_name"], {"n_name": ["n_nationkey"], "r_name": ["r_regionkey"]})


query("cluster_lists", "customer", "SELECT c_nationkey AS cluster, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS pos, c_custkey FROM customer")(lambda df: lists.cluster_lists(df.withColumn("cluster", c("c_nationkey")), "cluster", "c_custkey"))
query("axis_order", "part", "SELECT p_partkey, p_retailprice AS a0, p_size AS a1 FROM part")(lambda df: df.select("p_partkey", *[c(x).alias(f"a{n}") for n, x in enumerate(lists.shifted(lists.moved(["p_size", "p_brand", "p_retailprice"], "p_size", "p_retailprice"), "p_brand", 1)[:2])]))
query("category_map", "orders", "SELECT o_orderkey, o_orderpriority AS name FROM orders")(
    lambda df: (lambda coded: coded.crossJoin(F.broadcast(coded.select("o_orderpriority", "code").distinct().agg(F.map_from_entries(F.collect_list(F.struct("code", "o_orderpriority"))).alias("names")))).select("o_orderkey", F.element_at("names", c("code")).alias("name")))(tables.category_codes(df.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code"))
)
query("json_props", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(lambda df: df.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
query("last_values", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50")(lambda df: df.select("o_orderkey", "o_totalprice").orderBy(c("o_orderkey").desc()).limit(50))
query("column_summary", "orders", "SELECT count(o_totalprice) AS size, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")(lambda df: df.agg(F.count("o_totalprice").alias("size"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")))

# kd boxes and Gaussians -----------------------------------------------------------------------------------------
KD = "WITH b AS (SELECT min(p_size) AS l0, max(p_size) AS h0, min(p_retailprice) AS l1, max(p_retailprice) AS h1 FROM part), k AS (SELECT p_size AS x, p_retailprice AS y, b.*, p_size >= (l0 + h0) / 2.0 AS a, p_retailprice >= (l1 + h1) / 2 AS e FROM part, b), m AS (SELECT *, CASE WHEN a THEN (l0 + h0) / 2.0 ELSE l0 END AS l2, CASE WHEN a THEN h0 ELSE (l0 + h0) / 2.0 END AS h2 FROM k)"
query("fracture_boxes", "part", KD + " SELECT 'r' || a::INT || e::INT || (x >= (l2 + h2) / 2.0)::INT AS box, count(*) AS n, min(x)::DOUBLE AS lo_p_size, max(x)::DOUBLE AS hi_p_size, min(y) AS lo_p_retailprice, max(y) AS hi_p_retailprice FROM m GROUP BY 1")(lambda df: lists.fractures(df, ["p_size", "p_retailprice"], 3, "both"))
query("fracture_static", "part", KD + " SELECT 'r' || a::INT || e::INT AS box, count(*) AS n, min(l2)::DOUBLE AS lo_p_size, min(h2)::DOUBLE AS hi_p_size, round(min(CASE WHEN e THEN (l1 + h1) / 2 ELSE l1 END), 6) AS lo_p_retailprice, round(min(CASE WHEN e THEN h1 ELSE (l1 + h1) / 2 END), 6) AS hi_p_retailprice FROM m GROUP BY 1")(
    lambda df: lists.fractures(df, ["p_size", "p_retailprice"], 2).withColumns({x: F.round(x, 6) for x in ("lo_p_retailprice", "hi_p_retailprice")})
)
COV2 = "SELECT covar_samp(p_size, p_size) AS a, covar_samp(p_size, p_retailprice) AS b, covar_samp(p_retailprice, p_retailprice) AS d, avg(p_size) AS u, avg(p_retailprice) AS v FROM part"


@query("brush_gaussian_fitted", "part", f"SELECT count(*) AS n FROM part, ({COV2}) WHERE (d * pow(p_size - u, 2) - 2 * b * (p_size - u) * (p_retailprice - v) + a * pow(p_retailprice - v, 2)) / (a * d - b * b) <= 1.5 * 1.5 * 2")
def _(df):
    columns = ["p_size", "p_retailprice"]
    return df.where(B.in_gaussian(columns, *stats.gaussian(df, columns), 1.5)).agg(F.count(F.lit(1)).alias("n"))


@query("covariance_inverse", "part", f"SELECT i, j, round(CASE WHEN i = j THEN CASE WHEN i = 'p_size' THEN d ELSE a END ELSE -b END / (a * d - b * b), 9) AS value, round(a * d - b * b, 4) AS determinant FROM ({COV2}), (VALUES ('p_size'), ('p_retailprice')) x(i), (VALUES ('p_size'), ('p_retailprice')) y(j)")
def _(df):
    inverse, determinant = stats.inverse_covariance(df, ["p_size", "p_retailprice"])
    return inverse.select(c("a").alias("i"), c("b").alias("j"), F.round("value", 9).alias("value"), F.round(F.lit(determinant), 4).alias("determinant"))


MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query("correlation_matrix", "lineitem", " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS r FROM lineitem GROUP BY 1" for i, a in enumerate(MATRIX) for b in MATRIX[i + 1 :]))(lambda df: stats.correlation_matrix(df, MATRIX, "l_returnflag").withColumn("r", F.round("r", 7)))
#: Principal axes of two columns in closed form.
PCA2 = f"SELECT *, CASE WHEN abs(x0) >= abs(y0) THEN sign(x0) ELSE sign(y0) END AS s0 FROM (SELECT *, cos(0.5 * atan2(2 * b, a - d)) AS x0, sin(0.5 * atan2(2 * b, a - d)) AS y0 FROM ({COV2}))"
SCORES = f"SELECT p_partkey, s0 * (x0 * (p_size - u) + y0 * (p_retailprice - v)) AS pc0, CASE WHEN abs(y0) >= abs(x0) THEN sign(-y0) ELSE sign(x0) END * (-y0 * (p_size - u) + x0 * (p_retailprice - v)) AS pc1 FROM part, ({PCA2})"
query("pca_scores", "part", f"SELECT p_partkey, round(pc0, 6) AS pc0, round(pc1, 6) AS pc1 FROM ({SCORES})")(lambda df: stats.pca(df.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 2).select("p_partkey", F.round("pc0", 6).alias("pc0"), F.round("pc1", 6).alias("pc1")))
query("pca_scaled", "part", f"SELECT p_partkey, round(pc0 / m, 7) AS pc0 FROM ({SCORES}), (SELECT greatest(max(abs(p_size - u)), max(abs(p_retailprice - v))) AS m FROM part, ({COV2}))")(lambda df: stats.pca(df.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 1, scaled=True).select("p_partkey", F.round("pc0", 7).alias("pc0")))
query("pca", "part", f"SELECT p_partkey, p_size, p_retailprice, round(pc0, 6) AS pc0, round(pc1, 6) AS pc1 FROM part JOIN ({SCORES}) USING (p_partkey)")(
    lambda df: stats.pca(df.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 2).withColumns({x: F.round(x, 6) for x in ("pc0", "pc1")})
)
TRIANGLE = [(-20.0, -8.0), (15.0, -4.0), (2.0, 9.5)]
query("projected_lasso", "part", f"SELECT p_partkey FROM ({SCORES}) WHERE {lasso_sql('pc0', 'pc1', TRIANGLE)}")(lambda df: stats.pca(df.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 2).where(B.in_lasso("pc0", "pc1", TRIANGLE)).select("p_partkey"))


def centres(df: DataFrame, found: list[list[float]]) -> DataFrame:
    return df.sparkSession.createDataFrame([(n, *x) for n, x in enumerate(found)], "i long, x double, y double")


DRAWN = f"SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, -ln(({MD5.format(x='p_partkey', seed=1, n=12)} + 0.5) / 281474976710656.0::DOUBLE) AS e FROM part"
query("kmeans_forgy", "part", f"SELECT CAST(row_number() OVER (ORDER BY e, p_partkey) - 1 AS BIGINT) AS i, x, y FROM ({DRAWN}) QUALIFY i < 4")(lambda df: centres(df, stats.initial_centres(df, ["p_size", "p_retailprice"], "p_partkey", 4, "forgy", 1)))
NEAR = "least({})"
query(
    "kmeans_plusplus", "part",
    f"WITH d AS ({DRAWN}), c0 AS (SELECT x, y FROM d ORDER BY e, p_partkey LIMIT 1), c1 AS (SELECT d.x, d.y FROM d, c0 WHERE pow(d.x - c0.x, 2) + pow(d.y - c0.y, 2) > 0 ORDER BY e / (pow(d.x - c0.x, 2) + pow(d.y - c0.y, 2)), p_partkey LIMIT 1), "
    "c2 AS (SELECT x, y FROM (SELECT d.*, least(pow(d.x - c0.x, 2) + pow(d.y - c0.y, 2), pow(d.x - c1.x, 2) + pow(d.y - c1.y, 2)) AS o FROM d, c0, c1) WHERE o > 0 ORDER BY e / o, p_partkey LIMIT 1) "
    "SELECT 0::BIGINT AS i, x, y FROM c0 UNION ALL SELECT 1, x, y FROM c1 UNION ALL SELECT 2, x, y FROM c2",
)(lambda df: centres(df, stats.initial_centres(df, ["p_size", "p_retailprice"], "p_partkey", 3, "plusplus", 1)))
ROUND = "m{n} AS (SELECT sum(x / w) / sum(1 / w) AS x, sum(y / w) / sum(1 / w) AS y FROM (SELECT p_size AS x, p_retailprice AS y, sqrt(pow(p_size - m.x, 2) + pow(p_retailprice - m.y, 2)) AS w FROM part, m{p} m) WHERE w > 0)"
query("median_geometric", "part", "WITH m0 AS (SELECT avg(p_size) AS x, avg(p_retailprice) AS y FROM part), " + ", ".join(ROUND.format(n=n, p=n - 1) for n in range(1, 6)) + " SELECT round(x, 6) AS x, round(y, 6) AS y FROM m5")(
    lambda df: df.sparkSession.createDataFrame([tuple(stats.geometric_median(df, ["p_size", "p_retailprice"], 5))], "x double, y double").select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
)


BOUNDS = Graph().add("a", "plus", "x", "y").add("b", "multiplication", "a", "x")
query("derivation_bounds", "part", " UNION ALL ".join(f"SELECT '{n}' AS attribute, round(min({e}), 8) AS lo, round(max({e}), 8) AS hi FROM ({X_SQL})" for n, e in (("a", "x + y"), ("b", "(x + y) * x"))))(
    lambda df: BOUNDS.write_back(xyz(df), ["a", "b"])[1].select("attribute", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))
)
query("kmeans_l1", "part", "SELECT p_partkey, CAST(CASE WHEN a <= b AND a <= d THEN 0 WHEN b <= d THEN 1 ELSE 2 END AS BIGINT) AS cluster FROM (SELECT p_partkey, " + ", ".join(f"abs(p_size - {x}) + abs(p_retailprice - {y}) AS {n}" for n, x, y in (("a", 10, 901), ("b", 25, 910), ("d", 40, 918))) + " FROM part)")(
    lambda df: stats.kmeans(df, ["p_size", "p_retailprice"], [[10.0, 901.0], [25.0, 910.0], [40.0, 918.0]], 0, "l1")[0].select("p_partkey", "cluster")
)


# histograms and volumes -----------------------------------------------------------------------------------------
def price_hist(df: DataFrame) -> DataFrame:
    return H.dense(H.hist(df, [P1]), 24)


DENSE = f"SELECT b.range AS bin, coalesce(n, 0) AS n FROM range(24) b LEFT JOIN (SELECT {bin_sql([P1])} AS bin, count(*) AS n FROM lineitem GROUP BY 1) h ON b.range = h.bin"
WIDE = f"SELECT h.bin + k AS bin, ln(sum(n * w) / sum(w) + 1) AS v FROM (SELECT * FROM ({DENSE}) WHERE bin > 0) h, (SELECT range - 5 AS k, exp(-pow(range - 5, 2) / 2.0) AS w FROM range(11)) WHERE h.bin + k BETWEEN 1 AND 23 GROUP BY 1"
query("hist_smooth_modes", "lineitem", f"SELECT bin, round(v, 6) AS v FROM ({WIDE})")(lambda df: H.smooth(price_hist(df), 24, -1.0, skip_first=True, log=True).withColumn("v", F.round("v", 6)))
query("hist_area", "lineitem", f"SELECT round(sum(v), 5) AS area, round(max(v), 6) AS maximum FROM ({WIDE})")(lambda df: H.area_and_maximum(H.smooth(price_hist(df), 24, -1.0, skip_first=True, log=True)).select(F.round("area", 5).alias("area"), F.round("maximum", 6).alias("maximum")))
query("hist_axis_nonzero", "lineitem", f"SELECT {bin_sql([AXES[2]])} AS bin, count(*) AS n FROM lineitem WHERE l_discount <> 0 GROUP BY 1")(lambda df: H.hist(df, [AXES[2]], c("l_discount") != 0))
FOUR = {a[0]: [a] for a in AXES}
COUNTS = " UNION ALL ".join(f"SELECT '{k}' AS hist, {bin_sql(a)} AS bin, count(*) AS n FROM lineitem GROUP BY 2" for k, a in FOUR.items())
query("violin_self", "lineitem", f"SELECT hist, bin, round(n / max(n) OVER (PARTITION BY hist), 9) AS v FROM ({COUNTS})")(lambda df: H.violins(H.hist_many(df, FOUR), "self").withColumn("v", F.round("v", 9)))
query("violin_global", "lineitem", f"SELECT hist, bin, round(n / max(n) OVER (), 9) AS v FROM ({COUNTS})")(lambda df: H.violins(H.hist_many(df, FOUR), "global").withColumn("v", F.round("v", 9)))


@query("hist_sides", "lineitem")
def _(df):
    """Pairs of attributes for opposite sides, by the overlap of their histograms over ranges scaled to the same bins."""
    same = {a[0]: [(a[0], a[1], a[2], 8)] for a in AXES}
    counts = {(r["hist"], r["bin"]): r["n"] for r in H.hist_many(df, same).collect()}  # eight bins an attribute
    names = list(same)
    overlap = {(a, b): sum(min(counts.get((a, k), 0), counts.get((b, k), 0)) for k in range(8)) for i, a in enumerate(names) for b in names[i + 1 :]}
    return df.sparkSession.createDataFrame(H.sides(overlap), "first string, second string")


query("priority_bins", "lineitem", f"SELECT bin, n, CAST(row_number() OVER (ORDER BY n, bin) - 1 AS BIGINT) AS pos FROM (SELECT {bin_sql([P1])} AS bin, max(CAST(255 - least(floor(abs(l_quantity - 20) / 30 * 255 + 0.5), 255) AS BIGINT)) AS n FROM lineitem GROUP BY 1)")(lambda df: ranks.position(H.hist(df, [P1], value=B.priority(c("l_quantity"), 20.0, 30.0), how="max"), "n", "bin"))
query("level_centres", "lineitem", " UNION ALL ".join(f"SELECT {k} AS level, CAST(floor(least(greatest((l_extendedprice - 900) / 104100 * 32, 0), 31)) AS BIGINT) // {2**k} AS bin, round(avg(l_extendedprice), 4) AS mean, count(*) AS n FROM lineitem GROUP BY 2" for k in range(4)))(
    lambda df: df.groupBy(B.hist_bin(c("l_extendedprice"), 900.0, 105000.0, 32).alias("f")).agg(F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("n"))
    .select("s", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(c("f") / 2**k).alias("bin")) for k in range(4)])).alias("g")).groupBy("g.level", "g.bin").agg(F.round(F.sum("s") / F.sum("n"), 4).alias("mean"), F.sum("n").alias("n"))
)
query("bin_bitmaps", "orders", "SELECT CAST(floor(least(greatest((o_totalprice - 0) / 510000 * 20, 0), 19)) AS BIGINT) AS bin, 1 + (o_orderkey - 1) // 32768 AS bucket, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderkey > 0 GROUP BY 1, 2")(lambda df: H.bin_bitmaps(df.where("o_orderkey > 0"), ("o_totalprice", 0.0, 510000.0, 20), "o_orderkey").select("bin", "bucket", F.bitmap_count("bitmap").alias("n")))
query("bin_ids", "orders", "SELECT bin, CAST(row_number() OVER (PARTITION BY bin ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey FROM (SELECT CAST(floor(least(greatest(o_totalprice / 510000 * 20, 0), 19)) AS BIGINT) AS bin, o_orderkey FROM orders)")(lambda df: lists.cluster_lists(df.withColumn("bin", B.hist_bin(c("o_totalprice"), 0.0, 510000.0, 20)), "bin", "o_orderkey"))
query("voxel_brush", "lineitem", f"SELECT x, y, z, v BETWEEN 0 AND 1 AND v BETWEEN 1 AND 2 AS active FROM ({VOX})")(lambda df: H.voxel_brush(voxels(df), {"v": [(0, 1), (1, 2)]}).select("x", "y", "z", "active"))
KERNEL = "(SELECT range - 3 AS k, exp(-pow(range - 3, 2) / 2.0) AS w FROM range(7))"
ONCE = "SELECT {p}, sum(v * w) / (SELECT sum(w) FROM " + KERNEL + ") AS v FROM ({s}), " + KERNEL + " GROUP BY 1, 2, 3"
SMOOTH3 = ONCE.format(p="x, y, z + k AS z", s=ONCE.format(p="x, y + k AS y, z", s=ONCE.format(p="x + k AS x, y, z", s=VOX)))
query("voxel_smooth_all", "lineitem", f"SELECT x, y, z, round(v, 8) AS v FROM ({SMOOTH3})")(lambda df: H.voxel_smooth_all(voxels(df), 1.0).withColumn("v", F.round("v", 8)))
query("voxel_smooth_ones", "lineitem", f"SELECT s.x, s.y, s.z, round(CASE WHEN o.v = 1 THEN 1 ELSE s.v END, 8) AS v FROM ({SMOOTH3}) s LEFT JOIN ({VOX}) o ON s.x = o.x AND s.y = o.y AND s.z = o.z")(lambda df: H.voxel_smooth_all(voxels(df), 1.0, keep_ones=True).withColumn("v", F.round("v", 8)))
query("voxel_lines", "lineitem", f"SELECT z, y, string_agg(v, ',' ORDER BY x) AS line FROM ({VOX}) GROUP BY 1, 2")(lambda df: H.voxel_lines(voxels(df)))
query("density_histogram", "part", "SELECT CAST(floor((v - 900) / 30 * 15 + 0.5) AS BIGINT) AS bin, count(*) AS n FROM (SELECT p_size AS x, arg_max(p_retailprice, p_partkey) AS v FROM part GROUP BY 1) GROUP BY 1")(lambda df: df.groupBy("p_size").agg(F.max_by("p_retailprice", "p_partkey").alias("v")).groupBy(F.floor((c("v") - 900) / 30 * 15 + 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n")))

# codecs ---------------------------------------------------------------------------------------------------------
query("quantize_dead_zone", "orders", "SELECT o_orderkey, CAST(sign(o_totalprice - 150000) * floor(abs(o_totalprice - 150000) / 20000) AS BIGINT) AS q FROM orders")(lambda df: df.select("o_orderkey", codec.quantize(c("o_totalprice") - 150000, 20000.0, True).alias("q")))
query("unquantize", "orders", "SELECT o_orderkey, sign(q) * (abs(q) + 0.5) * 20000 AS v FROM (SELECT o_orderkey, CAST(sign(o_totalprice - 150000) * floor(abs(o_totalprice - 150000) / 20000) AS BIGINT) AS q FROM orders)")(
    lambda df: df.select("o_orderkey", codec.unquantize(codec.unzigzag(codec.zigzag(codec.quantize(c("o_totalprice") - 150000, 20000.0, True))), 20000.0, True).alias("v"))
)


def wavelet_sql(kind: str) -> str:
    steps, scale = codec.LIFTS[kind]
    out = "WITH x0 AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CAST(round(o_totalprice * 100) AS BIGINT)::DOUBLE AS v, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"
    for k, by in enumerate(steps):
        l, r = "lag(v) OVER (PARTITION BY o_custkey ORDER BY i)", "lead(v) OVER (PARTITION BY o_custkey ORDER BY i)"
        out += f", x{k + 1} AS (SELECT o_custkey, i, n, CASE WHEN i % 2 = {1 - k % 2} AND n > 1 THEN v + ({by!r})::DOUBLE * (coalesce({l}, {r}) + coalesce({r}, {l})) ELSE v END AS v FROM x{k})"
    return out + f" SELECT o_custkey, CASE WHEN i % 2 = 0 THEN i // 2 ELSE (n + 1) // 2 + i // 2 END AS pos, round(CASE WHEN n < 2 THEN v WHEN i % 2 = 0 THEN v * {scale!r}::DOUBLE ELSE v / {scale!r}::DOUBLE END, 3) AS w FROM x{len(steps)}"


for _name, _kind in (("wavelet", "9/7"), ("wavelet_53", "5/3")):
    query(_name, "orders", wavelet_sql(_kind))(lambda df, k=_kind: codec.lifted(df.withColumn("cents", F.round(c("o_totalprice") * 100).cast("long")), "o_orderkey", "cents", "o_custkey", k).withColumn("w", F.round("w", 3)))
RUNS = "SELECT o_custkey, min(o_orderkey) AS start, min(s) AS symbol, count(*) - 1 AS repeats FROM (SELECT *, i - row_number() OVER (PARTITION BY o_custkey, s ORDER BY i) AS g FROM (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 200000) AS BIGINT) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)) GROUP BY o_custkey, s, g"
query("rle_split", "orders", f"SELECT o_custkey, start, symbol, CAST(part AS INT) AS part, least(1, repeats - part * 2) AS repeats FROM (SELECT *, unnest(range(0, repeats // 2 + 1)) AS part FROM ({RUNS})) WHERE repeats - part * 2 >= 0")(lambda df: codec.split_runs(codec.runs(symbols(df), "o_orderkey", "s", "o_custkey"), 1))


# sources: written into the shared folder and read back ----------------------------------------------------------
def place(spark, suffix: str) -> str:
    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}{suffix}"


def nation_csv(spark, d: str, where: str = "true") -> str:
    path = place(spark, ".csv")
    load(spark, d, "nation").where(where).select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return path


query("source_csv", None, "SELECT n_nationkey::DOUBLE AS n_nationkey, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS BIGINT) AS n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation")(lambda spark, d: dataset.read(spark, nation_csv(spark, d)))
query("source_csv_schema", None, "SELECT * FROM (VALUES (0::BIGINT, 'n_nationkey'), (1, 'n_name'), (2, 'n_regionkey'), (3, 'index')) AS v(position, attribute)")(lambda spark, d: dataset.csv_schema(spark, nation_csv(spark, d)))


@query("source_columns", None, "SELECT count(*) AS n, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi, round(avg(p_size), 3) AS mean FROM part")
def _(spark, d):
    path = place(spark, "")
    tables.write_columns(load(spark, d, "part").select("p_size", "p_retailprice"), path)
    return dataset.read(spark, path).agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.round(F.avg("p_size"), 3).alias("mean"))


def grid_file(spark, d: str) -> str:
    """A NetCDF file of the nations' and regions' keys: a packed number on the grid, a name along one dimension."""
    n, r = (sorted(x[0] for x in load(spark, d, t).select(k).collect()) for t, k in (("nation", "n_nationkey"), ("region", "r_regionkey")))  # 25 and 5 rows of a fixed table
    folder = place(spark, "")
    v = np.add.outer(np.array(n, np.int32) * 10, np.array(r, np.int32))
    names = np.array([list(f"n{x:02d}") for x in n], "S1")
    variables = {"longitude": (["nation", "region"], v, {"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": 0.0}), "name": (["nation", "chars"], names, {})}
    dataset.put(spark, f"{folder}/grid.nc", dataset.netcdf_bytes({"nation": len(n), "region": len(r), "chars": 3}, variables))
    return folder


query("source_netcdf", None, "SELECT n_nationkey::BIGINT AS nation, r_regionkey::BIGINT AS region, CASE WHEN n_nationkey * 10 + r_regionkey <> 0 THEN (n_nationkey * 10 + r_regionkey) * 0.5::DOUBLE + 1 END AS lon, printf('n%02d', n_nationkey) AS name FROM nation, region")(lambda spark, d: dataset.read(spark, grid_file(spark, d) + "/grid.nc").drop("file"))
query("source_netcdf_schema", None, "SELECT * FROM (VALUES ('longitude', 'nation,region', 125::BIGINT, 0.5::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('name', 'nation,chars', 75, 1.0, 0.0, NULL)) AS v(variable, dims, cells, scale, \"offset\", fill)")(
    lambda spark, d: dataset.netcdf_schema(spark, grid_file(spark, d)).select("variable", F.array_join("dims", ",").alias("dims"), F.aggregate("sizes", F.lit(1).cast("long"), lambda a, x: a * x).alias("cells"), "scale", "offset", "fill")
)
query("source_files", None, "SELECT 'grid.nc' AS name")(lambda spark, d: tables.files(spark, grid_file(spark, d), r".*grid.*", r".*\.csv").select(F.regexp_extract("path", "[^/]+$", 0).alias("name")))


def two_files(spark, d: str) -> list[str]:
    out = []
    for where in ("s_suppkey % 2 = 0", "s_suppkey % 2 = 1"):
        out.append(place(spark, ".csv"))
        load(spark, d, "supplier").where(where).select("s_suppkey", "s_acctbal").write.option("header", True).csv(out[-1])
    return out


query("multi_file_analysis", None, "SELECT 's_suppkey' AS attribute, min(s_suppkey)::DOUBLE AS lo, max(s_suppkey)::DOUBLE AS hi, count(*) AS n FROM supplier UNION ALL SELECT 's_acctbal', min(s_acctbal), max(s_acctbal), count(*) FROM supplier")(lambda spark, d: dataset.analyse(spark, two_files(spark, d)))
query("multi_file_rows", None, "SELECT round((s_suppkey - a) / (b - a), 9) AS s_suppkey, round((s_acctbal - l) / (h - l), 9) AS s_acctbal FROM supplier, (SELECT min(s_suppkey)::DOUBLE AS a, max(s_suppkey)::DOUBLE AS b, min(s_acctbal) AS l, max(s_acctbal) AS h FROM supplier)")(
    lambda spark, d: dataset.rows(spark, two_files(spark, d), normalized=True).select(F.round("s_suppkey", 9).alias("s_suppkey"), F.round("s_acctbal", 9).alias("s_acctbal"))
)


@query("settings_json", None, "SELECT 'axes' AS key, 'l_quantity,l_tax' AS value")
def _(spark, d):
    path = place(spark, ".json")
    dataset.save_settings(spark, path, {"axes": ["l_quantity", "l_tax"]})
    return spark.createDataFrame([(k, ",".join(v)) for k, v in dataset.load_settings(spark, path).items()], "key string, value string")
