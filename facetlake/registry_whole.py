"""Queries of staged derivation graphs, kd-trees, clusters of whole tables, bitmap indexes, bundles and kept histograms."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import brush, nodes
from .operators import bitmaps, codec, embedding, hierarchy, histogram as H, lists, ranks, stats
from .operators.lineage import checkpointed, remove, shared_dir
from .operators.space import Space
from .plans.graph import Graph
from .registry import c, load, query
from .sources import dataset, grids
from .streaming.kept import KeptHistogram

# staged derivation graphs ---------------------------------------------------------------------------------------


def trade(spark: SparkSession, d: str) -> dict[tuple[str, ...], DataFrame]:
    """Columns over part x supplier (as far as traded), part, supplier and no dimension."""
    sold = load(spark, d, "lineitem").groupBy(c("l_partkey").alias("part"), c("l_suppkey").alias("supp")).agg(F.sum("l_quantity").alias("sold"))
    part = load(spark, d, "part").select(c("p_partkey").alias("part"), "p_size", "p_retailprice")
    supp = load(spark, d, "supplier").select(c("s_suppkey").alias("supp"), "s_acctbal", "s_nationkey")
    level = load(spark, d, "customer").agg(F.avg("c_acctbal").alias("level"))
    return {("part", "supp"): sold, ("part",): part, ("supp",): supp, (): level}


#: Found bounds, group reductions, a rank and columns of four layouts in one graph of three stages.
TRADE = (
    Graph()
    .add("share", "normalization", "sold")
    .add("balance", "normalization", "s_acctbal")
    .add("usual", "reduction", "share", "s_nationkey", how="avg")
    .add("most", "reduction", "sold", "s_nationkey", how="max")
    .add("place", "rank", "p_size")
    .add("over", "minus", "share", "usual")
    .add("mixed", "sum", "over", "balance", "place", "most", factors=[1.0, 0.5, 0.01, 0.001])
    .add("against", "division", "s_acctbal", "level")
    .add("score", "sum", "mixed", "against", factors=[1.0, 0.25])
    .add("scaled", "normalization", "score")
)
TRADE_SQL = """WITH sold AS (SELECT l_partkey AS part, l_suppkey AS supp, sum(l_quantity) AS sold FROM lineitem GROUP BY 1, 2),
a AS (SELECT sold.*, (sold - min(sold) OVER ()) / (max(sold) OVER () - min(sold) OVER ()) AS share FROM sold),
p AS (SELECT p_partkey AS part, dense_rank() OVER (ORDER BY p_size) - 1 AS place FROM part),
s AS (SELECT s_suppkey AS supp, s_acctbal, s_nationkey, (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS balance FROM supplier),
j AS (SELECT a.part, a.supp, share, balance, place, s_acctbal / (SELECT avg(c_acctbal) FROM customer) AS against, avg(share) OVER (PARTITION BY s_nationkey) AS usual, max(sold) OVER (PARTITION BY s_nationkey) AS most
  FROM a LEFT JOIN p ON a.part = p.part LEFT JOIN s ON a.supp = s.supp),
k AS (SELECT part, supp, share - usual + 0.5 * balance + 0.01 * place + 0.001 * most + 0.25 * against AS score FROM j)
SELECT part, supp, round(score, 7) AS score, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 7) AS scaled FROM k"""


@query("graph_layouts", None, TRADE_SQL)
def _(spark, d):
    return TRADE.run(trade(spark, d), ["score", "scaled"]).withColumns({x: F.round(x, 7) for x in ("score", "scaled")})


#: A product of layouts that share no dimension, then a derivative along one of its dimensions.
GRID = Graph().add("step", "derivative", "filled", dim="size", kind="central").add("filled", "multiplication", "mean_price", "weight").add("up", "reduction", "step", "weight", how="stddev")
GRID_SQL = """WITH p AS (SELECT p_size AS size, avg(p_retailprice) AS m FROM part GROUP BY 1), r AS (SELECT n_regionkey AS region, count(*) AS w FROM nation GROUP BY 1),
g AS (SELECT size, region, m * w AS v, w FROM p, r),
e AS (SELECT *, (coalesce(lead(v) OVER (PARTITION BY region ORDER BY size), v) - coalesce(lag(v) OVER (PARTITION BY region ORDER BY size), v)) / 2 AS step FROM g)
SELECT size, region, round(step, 6) AS step, round(stddev_pop(step) OVER (PARTITION BY w), 6) AS up FROM e"""


@query("graph_inflated_derivative", None, GRID_SQL)
def _(spark, d):
    sizes = load(spark, d, "part").groupBy(c("p_size").alias("size")).agg(F.avg("p_retailprice").alias("mean_price"))
    regions = load(spark, d, "nation").groupBy(c("n_regionkey").alias("region")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return GRID.run({("size",): sizes, ("region",): regions}, ["step", "up"]).withColumns({x: F.round(x, 6) for x in ("step", "up")})


#: Projection and clusters of normalised columns.
SHAPES = Graph().add("a", "normalization", "p_size").add("b", "normalization", "p_retailprice").add("p", "pca", "a", "b", k=1).add("cell", "kmeans", "p0", centres=[[-0.5], [0.0], [0.5]], iterations=4).add("far", "reduction", "p0", "cell", how="max")
MEANS_SQL = ", ".join(
    f"a{i} AS (SELECT f.p_partkey, f.s, arg_min(c.k, struct_pack(d := (f.s - c.m) * (f.s - c.m), k := c.k)) AS k FROM f, c{i} c GROUP BY 1, 2), c{i + 1} AS (SELECT c.k, coalesce(avg(a.s), any_value(c.m)) AS m FROM c{i} c LEFT JOIN a{i} a ON a.k = c.k GROUP BY 1)"
    for i in range(4)
)
SHAPES_SQL = f"""WITH n AS (SELECT p_partkey, (p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE) AS a, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS b FROM part),
v AS (SELECT avg(a) AS u, avg(b) AS w, covar_samp(a, a) AS x, covar_samp(a, b) AS y, covar_samp(b, b) AS z FROM n),
l AS (SELECT *, (x + z) / 2 + sqrt((x - z) * (x - z) / 4 + y * y) AS e FROM v), q AS (SELECT u, w, y AS p, e - x AS r FROM l), o AS (SELECT u, w, p / sqrt(p * p + r * r) AS p, r / sqrt(p * p + r * r) AS r FROM q),
t AS (SELECT u, w, p * CASE WHEN abs(p) >= abs(r) THEN sign(p) ELSE sign(r) END AS p, r * CASE WHEN abs(p) >= abs(r) THEN sign(p) ELSE sign(r) END AS r FROM o),
f AS (SELECT p_partkey, p * (a - u) + r * (b - w) AS s FROM n, t), c0 AS (SELECT * FROM (VALUES (0, -0.5::DOUBLE), (1, 0.0::DOUBLE), (2, 0.5::DOUBLE)) AS g(k, m)), {MEANS_SQL},
e AS (SELECT f.p_partkey, f.s, arg_min(c.k, struct_pack(d := (f.s - c.m) * (f.s - c.m), k := c.k)) AS k FROM f, c4 c GROUP BY 1, 2)
SELECT p_partkey, round(s, 7) AS p0, CAST(k AS BIGINT) AS cell, round(max(s) OVER (PARTITION BY k), 7) AS far FROM e"""


@query("graph_projection", "part", SHAPES_SQL)
def _(df):
    out = SHAPES.run({("p_partkey",): df.select("p_partkey", "p_size", "p_retailprice")}, ["p0", "cell", "far"])
    return out.withColumns({x: F.round(x, 7) for x in ("p0", "far")})

# kd-tree searches: points are customers by (nation, balance), queries are suppliers and orders ---------------------


def customers(spark: SparkSession, d: str, second: bool = False) -> Space:
    return Space.of(load(spark, d, "customer"), ["c_nationkey", "c_acctbal"], "c_custkey", second=second)


CONTAINS_SQL = """SELECT o_orderkey, EXISTS (SELECT 1 FROM part WHERE p_retailprice = floor(o_totalprice / 1000) + 700 AND p_size = month(o_orderdate)) AS contained FROM orders"""


@query("kd_contains", None, CONTAINS_SQL)
def _(spark, d):
    space = Space.of(load(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey")
    asked = load(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"), (F.floor(c("o_totalprice") / 1000) + 700).alias("v"))
    return space.contains(asked, ["m", "v"]).select("o_orderkey", "contained")


BOX_SQL = """SELECT s_suppkey, count(c_custkey) AS n, min(c_custkey) AS least FROM supplier LEFT JOIN customer ON c_nationkey BETWEEN s_nationkey - 2 AND s_nationkey + 2 AND c_acctbal BETWEEN s_acctbal - 150 AND s_acctbal + 150 GROUP BY 1"""


@query("kd_box", None, BOX_SQL)
def _(spark, d):
    asked = load(spark, d, "supplier")
    around = asked.select("s_suppkey", *[(c(x) + sign * w).alias(f"{x}{sign}") for x, w in (("s_nationkey", 2), ("s_acctbal", 150)) for sign in (-1, 1)])
    found = customers(spark, d).in_boxes(around, ["s_nationkey-1", "s_acctbal-1"], ["s_nationkey1", "s_acctbal1"], "s_suppkey")
    sums = found.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.min("first").alias("least"))
    return asked.select("s_suppkey").join(sums, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "least")


RADIUS_SQL = """SELECT s_suppkey, count(*) AS n, round(max(sqrt(pow(c_nationkey - s_nationkey, 2) + pow(c_acctbal - s_acctbal, 2))), 6) AS far FROM supplier JOIN customer ON pow(c_nationkey - s_nationkey, 2) + pow(c_acctbal - s_acctbal, 2) <= 900 GROUP BY 1"""


@query("kd_radius", None, RADIUS_SQL)
def _(spark, d):
    found = customers(spark, d).in_radius(load(spark, d, "supplier"), ["s_nationkey", "s_acctbal"], "s_suppkey", 30.0)
    return found.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.round(F.sqrt(F.max("d2")), 6).alias("far"))


NEAREST_SQL = """WITH d AS (SELECT s_suppkey, c_custkey, (s_nationkey - c_nationkey) * (s_nationkey - c_nationkey) + (s_acctbal - c_acctbal) * (s_acctbal - c_acctbal) AS d2 FROM supplier, customer),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d2, c_custkey) AS k FROM d)
SELECT s_suppkey, c_custkey AS near, round(sqrt(d2), 6) AS distance FROM r WHERE k = 1"""


@query("kd_nearest", None, NEAREST_SQL)
def _(spark, d):
    return customers(spark, d).nearest(load(spark, d, "supplier"), ["s_nationkey", "s_acctbal"], "s_suppkey").withColumn("distance", F.round("distance", 6))


NEIGHBOUR_SQL = """WITH d AS (SELECT a.p_partkey, b.p_partkey AS other, (a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) AS d2 FROM part a JOIN part b ON a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d2, other) AS k FROM d)
SELECT p_partkey, other AS near, round(sqrt(d2), 6) AS distance FROM r WHERE k = 1"""


@query("kd_nearest_other", None, NEIGHBOUR_SQL)
def _(spark, d):
    part = load(spark, d, "part")
    space = Space.of(part, ["p_size", "p_retailprice"], "p_partkey", second=True)
    return space.nearest(part, ["p_size", "p_retailprice"], "p_partkey", other=True).withColumn("distance", F.round("distance", 6))


#: The five nearest other places of every customer's place, ties by key.
K_NEAREST_SQL = """WITH p AS (SELECT c_acctbal, c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1, 2),
d AS (SELECT a.k AS c_custkey, b.k AS near, (a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal) + 400.0 * (a.c_nationkey - b.c_nationkey) * (a.c_nationkey - b.c_nationkey) AS d2 FROM p a JOIN p b ON a.k <> b.k),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, near) AS place FROM d)
SELECT c_custkey, place, near, round(sqrt(d2), 6) AS distance FROM r WHERE place <= 5"""


@query("kd_k_nearest", None, K_NEAREST_SQL)
def _(spark, d):
    places = load(spark, d, "customer").withColumn("nation", 20.0 * c("c_nationkey"))
    found = Space.of(places, ["c_acctbal", "nation"], "c_custkey", rows=512).k_nearest(5)
    return found.select(c("first").alias("c_custkey"), c("place").cast("long").alias("place"), "near", F.round(F.sqrt("d2"), 6).alias("distance"))


@query("tsne_leaves", None)
def _(spark, d):
    places = load(spark, d, "customer")
    scale = places.agg(F.stddev("c_acctbal"), F.stddev("c_nationkey")).first()
    return embedding.tsne(places.select("c_custkey", (c("c_acctbal") / scale[0]).alias("a"), (c("c_nationkey") / scale[1]).alias("b")), ["a", "b"], "c_custkey", perplexity=10, iterations=30)

# spanning trees and single linkage ------------------------------------------------------------------------------
TREE_SQL = """WITH p AS (SELECT s_acctbal, min(s_suppkey) AS k FROM supplier GROUP BY 1), o AS (SELECT k, lag(k) OVER (ORDER BY s_acctbal) AS j, s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal) AS d FROM p)
SELECT least(k, j) AS a, greatest(k, j) AS b, round(d, 6) AS length FROM o WHERE j IS NOT NULL"""
query("spanning_tree", "supplier", TREE_SQL)(lambda df: stats.spanning_tree(df, ["s_acctbal"], "s_suppkey").withColumn("length", F.round("length", 6)))

#: The five clusters that remain when the four widest gaps are cut.
GAP_SQL = """WITH o AS (SELECT s_suppkey, s_acctbal, s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS d FROM supplier), g AS (SELECT d FROM o WHERE d IS NOT NULL ORDER BY d DESC LIMIT 4),
c AS (SELECT s_suppkey, sum(CASE WHEN d >= (SELECT min(d) FROM g) THEN 1 ELSE 0 END) OVER (ORDER BY s_acctbal, s_suppkey) AS c FROM o), n AS (SELECT c, row_number() OVER (ORDER BY min(s_suppkey)) - 1 AS cluster FROM c GROUP BY c)
SELECT s_suppkey, cluster FROM c JOIN n USING (c)"""
query("single_linkage_k", "supplier", GAP_SQL)(lambda df: stats.single_linkage(df, ["s_acctbal"], "s_suppkey", k=5))

CUT_SQL = """WITH RECURSIVE n AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON pow(a.s_acctbal - b.s_acctbal, 2) + pow(20.0 * (a.s_nationkey - b.s_nationkey), 2) <= 3600),
r(a, b) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), l AS (SELECT a, min(b) AS label FROM r GROUP BY a)
SELECT a AS s_suppkey, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS cluster FROM l"""
query("single_linkage_cut", "supplier", CUT_SQL)(lambda df: stats.single_linkage(df.withColumn("nation", 20.0 * c("s_nationkey")), ["s_acctbal", "nation"], "s_suppkey", cut=60.0))

#: Density clusters of all customers in two columns.
DENSE_SQL = """WITH RECURSIVE n AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON pow(10.0 * (a.c_nationkey - b.c_nationkey), 2) + pow(a.c_acctbal - b.c_acctbal, 2) <= 400), k AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 4),
r(a, b) AS (SELECT a, a FROM k UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a JOIN k ON n.b = k.a), l AS (SELECT a, min(b) AS label FROM r GROUP BY a), e AS (SELECT n.a, min(label) AS label FROM n JOIN l ON n.b = l.a GROUP BY n.a),
f AS (SELECT c_custkey, coalesce(l.label, e.label) AS label FROM customer LEFT JOIN l ON c_custkey = l.a LEFT JOIN e ON c_custkey = e.a), d AS (SELECT label, row_number() OVER (ORDER BY label) AS cluster FROM (SELECT DISTINCT label FROM l))
SELECT c_custkey, CAST(coalesce(d.cluster, -1) AS BIGINT) AS cluster FROM f LEFT JOIN d ON f.label = d.label"""
query("dbscan_plane", "customer", DENSE_SQL)(lambda df: stats.dbscan(df.withColumn("nation", 10.0 * c("c_nationkey")), ["nation", "c_acctbal"], "c_custkey", 20.0, 4))

#: Leaders of a whole table without groups, boxes of a width per column.
HOLDS = "[h for h in s.heads if o.u >= h.u - 1.5 and o.u <= h.u + 1.5 and o.v >= h.v - 300 and o.v <= h.v + 300]"
LEADERS_SQL = f"""WITH RECURSIVE o AS (SELECT c_custkey AS k, c_nationkey::DOUBLE AS u, c_acctbal AS v, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
s(k, i, heads, leader) AS (SELECT k, i, [{{'n': 0, 'u': u, 'v': v}}], 0 FROM o WHERE i = 1 UNION ALL
  SELECT o.k, o.i, CASE WHEN len({HOLDS}) > 0 THEN s.heads ELSE list_append(s.heads, {{'n': len(s.heads)::INTEGER, 'u': o.u, 'v': o.v}}) END, CASE WHEN len({HOLDS}) > 0 THEN ({HOLDS})[1].n ELSE len(s.heads)::INTEGER END
  FROM s JOIN o ON o.i = s.i + 1)
SELECT k AS c_custkey, CAST(leader AS BIGINT) AS leader FROM s"""
query("leader_whole", "customer", LEADERS_SQL)(lambda df: stats.leader(df, ["c_nationkey", "c_acctbal"], "c_custkey", [3.0, 600.0]))

# surface-area boxes ---------------------------------------------------------------------------------------------
COST = "(v - {l}) * sum(n) OVER ({p} ORDER BY bin) + ({h} - {l} - (v - {l})) * (sum(n) OVER ({p}) - sum(n) OVER ({p} ORDER BY bin))"
AREA_SQL = f"""WITH b AS (SELECT min(p_size)::DOUBLE AS l0, max(p_size)::DOUBLE AS h0, min(p_retailprice) AS l1, max(p_retailprice) AS h1 FROM part),
c0 AS (SELECT least(floor((p_size - l0) / (h0 - l0) * 1024), 1023) AS bin, count(*) AS n, max(p_size)::DOUBLE AS v, any_value(l0) AS l0, any_value(h0) AS h0 FROM part, b GROUP BY 1),
d0 AS (SELECT v, {COST.format(l="l0", h="h0", p="")} AS cost FROM c0), m0 AS (SELECT v AS m FROM d0 ORDER BY cost, v LIMIT 1),
r AS (SELECT p_size, p_retailprice AS y, CASE WHEN p_size < m THEN '0' ELSE '1' END AS s, m, b.* FROM part, m0, b),
c1 AS (SELECT s, least(floor((y - l1) / (h1 - l1) * 1024), 1023) AS bin, count(*) AS n, max(y) AS v, any_value(l1) AS l1, any_value(h1) AS h1 FROM r GROUP BY 1, 2),
d1 AS (SELECT s, v, {COST.format(l="l1", h="h1", p="PARTITION BY s")} AS cost FROM c1), m1 AS (SELECT s, v AS k FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY cost, v) AS i FROM d1) WHERE i = 1),
t AS (SELECT r.*, k, CASE WHEN y < k THEN '0' ELSE '1' END AS u FROM r JOIN m1 USING (s))
SELECT 'r' || s || u AS box, count(*) AS n, min(CASE WHEN s = '0' THEN l0 ELSE m END) AS lo_p_size, min(CASE WHEN s = '0' THEN m ELSE h0 END) AS hi_p_size, min(CASE WHEN u = '0' THEN l1 ELSE k END) AS lo_p_retailprice, min(CASE WHEN u = '0' THEN k ELSE h1 END) AS hi_p_retailprice FROM t GROUP BY 1"""
query("fracture_area", "part", AREA_SQL)(lambda df: lists.fractures(df, ["p_size", "p_retailprice"], 2, rule="area"))

# bitmap indexes -------------------------------------------------------------------------------------------------
INDEXED = [("o_totalprice", 0.0, 510000.0, 12), ("o_custkey", 0.0, 1500.0, 9)]
BIN = {"o_totalprice": "CAST(least(greatest(floor(o_totalprice / 510000.0 * 12), 0), 11) AS BIGINT)", "o_custkey": "CAST(least(greatest(floor(o_custkey / 1500.0 * 9), 0), 8) AS BIGINT)"}
query("bitmap_pair_counts", "orders", f"SELECT {BIN['o_totalprice']} AS bin_a, {BIN['o_custkey']} AS bin_b, count(*) AS n FROM orders GROUP BY 1, 2")(
    lambda df: bitmaps.pair_counts(bitmaps.bin_index(df, INDEXED, "o_orderkey"), "o_totalprice", "o_custkey")
)
query("bitmap_brush", "orders", f"SELECT {BIN['o_custkey']} AS bin, count(*) AS n FROM orders WHERE {BIN['o_totalprice']} IN (2, 3, 7) AND {BIN['o_custkey']} IN (0, 1, 4, 8) GROUP BY 1")(
    lambda df: bitmaps.brushed_counts(bitmaps.bin_index(df, INDEXED, "o_orderkey"), {"o_totalprice": [2, 3, 7], "o_custkey": [0, 1, 4, 8]}, "o_custkey")
)

# bundles between axes -------------------------------------------------------------------------------------------
LINES = [("l_quantity", 1.0, 50.0, 12), ("l_extendedprice", 900.0, 105000.0, 16), ("l_discount", 0.0, 0.1, 8), ("l_tax", 0.0, 0.08, 6)]


def _line_bin(name: str, lo: float, hi: float, n: int) -> str:
    return f"CAST(least(greatest(floor(({name} - {lo}) / ({hi} - {lo}) * {n}), 0), {n - 1}) AS BIGINT)"


AXIS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS axis, range AS bin, (SELECT count(*) FROM lineitem WHERE {_line_bin(a, lo, hi, n)} = range)::DOUBLE AS n, {lo} AS lo, {hi} AS hi, {n} AS k FROM range({n})" for a, lo, hi, n in LINES)
SEGMENT_SQL = f"""WITH h AS ({AXIS_SQL}), g AS (SELECT a.axis, a.bin, a.lo, a.hi, a.k, sum(b.n * exp(-pow(a.bin - b.bin, 2) / 2)) / sum(exp(-pow(a.bin - b.bin, 2) / 2)) AS n FROM h a JOIN h b ON a.axis = b.axis AND abs(a.bin - b.bin) <= 3 GROUP BY ALL),
x AS (SELECT *, lo + bin / (k - 1.0) * (hi - lo) AS value, sign(n - coalesce(lag(n) OVER (PARTITION BY axis ORDER BY bin), 0)) AS step FROM g),
y AS (SELECT *, last_value(nullif(step, 0) IGNORE NULLS) OVER (PARTITION BY axis ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM x),
z AS (SELECT *, sum(CASE WHEN step > 0 AND was < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY axis ORDER BY bin) AS segment FROM y),
s AS (SELECT axis, CAST(segment AS BIGINT) AS segment, min(value) AS first, sum(value * n) / sum(n) AS middle, min(lo) AS lo, min(hi) AS hi FROM z GROUP BY axis, segment HAVING sum(n) > 0),
e AS (SELECT axis, segment, CASE WHEN segment = 0 THEN lo ELSE first END AS lo, coalesce(lead(first) OVER (PARTITION BY axis ORDER BY segment), hi) AS hi, middle FROM s)"""


def bundles_of(df: DataFrame) -> DataFrame:
    return H.axis_bundles(H.smooth_axes(H.axis_counts(df, LINES), 1.0), LINES)


query("axis_bundles", "lineitem", SEGMENT_SQL + " SELECT axis, segment, round(lo, 6) AS lo, round(hi, 6) AS hi, round(middle, 6) AS middle FROM e")(
    lambda df: bundles_of(df).withColumns({x: F.round(x, 6) for x in ("lo", "hi", "middle")})
)
PAIRS_SQL = " UNION ALL ".join(
    f"""SELECT '{a[0]}' AS a, '{b[0]}' AS b, (SELECT count(*) FROM e WHERE axis = '{a[0]}' AND hi < {a[0]} AND segment < (SELECT max(segment) FROM e WHERE axis = '{a[0]}')) AS "from",
  (SELECT count(*) FROM e WHERE axis = '{b[0]}' AND hi < {b[0]} AND segment < (SELECT max(segment) FROM e WHERE axis = '{b[0]}')) AS "to" FROM lineitem"""
    for a, b in zip(LINES[:-1], LINES[1:])
)
query("bundle_counts", "lineitem", SEGMENT_SQL + f""", p AS ({PAIRS_SQL}) SELECT a, b, "from", "to", round(count(*) * 10.0 / (SELECT count(*) FROM lineitem), 6) AS weight FROM p GROUP BY 1, 2, 3, 4""")(
    lambda df: H.bundle_counts(df, bundles_of(df), [a[0] for a in LINES]).withColumn("weight", F.round("weight", 6))
)

# histograms kept up under change --------------------------------------------------------------------------------
VALUES = [("value", 0.0, 400.0, 16)]


@query("kept_histogram", None, "SELECT CAST(least(greatest(floor(value / 400.0 * 16), 0), 15) AS BIGINT) AS bin, count(*) AS n FROM events WHERE event_type <> 'view' AND value <= 250 GROUP BY 1")
def _(spark, d):
    """Blocks of a stream, then a changed brush: the counts of the new brush over all rows."""
    events = load(spark, d, "events").select("event_type", "value")
    base = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    old, new = c("value") <= 100, (c("event_type") != "view") & (c("value") <= 250)
    kept = KeptHistogram(spark, f"{base}/counts", VALUES)
    events.repartition(3).write.parquet(f"{base}/blocks")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/blocks")
    kept.follow(stream, f"{base}/checkpoint", old).awaitTermination()
    kept.rebrush("wider", events, old, new)
    out = checkpointed(kept.counts())
    remove(spark, base)
    return out


# files cut into ranges ------------------------------------------------------------------------------------------
def written_grids(df: DataFrame, path: str) -> int:
    """Each partition of (o_orderkey, o_custkey, cents) as a NetCDF file below ``path``; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, cust, cents = (np.asarray(x) for x in batch.columns)
            names = np.array([list(f"c{v:06d}") for v in cust], "S1").reshape(len(cust), 7)
            variables = {
                "order": (["row"], key.astype(np.int32), {}), "price": (["row"], cents.astype(np.int32), {"scale_factor": 0.01, "add_offset": 5.0, "_FillValue": -1.0}),
                "customer": (["row", "chars"], names, {}), "level": (["row"], cents / 7.0, {}),
            }
            fs, inner = grids.at(f"{path}/{uuid.uuid4().hex}.nc")
            fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(inner) as f:
                f.write(dataset.netcdf_bytes({"row": len(key), "chars": 7}, variables))
            yield pa.RecordBatch.from_pydict({"n": [1]})

    return df.mapInArrow(run, "n long").count()


@query("netcdf_ranges", None, """SELECT o_orderkey::INTEGER AS "order", CASE WHEN o_custkey % 5 <> 0 THEN round(o_totalprice + 5, 2) END AS price, printf('c%06d', o_custkey) AS customer FROM orders""")
def _(spark, d):
    path = f"{shared_dir(spark)}/grid-{uuid.uuid4().hex}"
    cents = F.when(c("o_custkey") % 5 == 0, -1).otherwise(F.round(c("o_totalprice") * 100)).cast("long")
    written_grids(load(spark, d, "orders").select("o_orderkey", "o_custkey", cents.alias("cents")), path)
    out = checkpointed(grids.open_grid(spark, path, ["order", "price", "customer"], rows=4000).withColumn("price", F.round("price", 2)))
    remove(spark, path)
    return out


@query("halves_ranges", None, "SELECT p_size::BIGINT AS size, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    path = f"{shared_dir(spark)}/halves-{uuid.uuid4().hex}"
    grids.write_halves(load(spark, d, "part").select("p_size", "p_retailprice"), path)
    read = grids.open_halves(spark, path, ["p_size"], rows=500)
    out = checkpointed(read.groupBy(F.round("p_size").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n")))
    remove(spark, path)
    return out


@query("halves_schema", None, """WITH p AS (SELECT count(*) AS rows, min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice) AS u, max(p_retailprice) AS v FROM part)
SELECT 0::BIGINT AS position, 'p_size' AS attribute, a AS lo, b AS hi, rows FROM p UNION ALL SELECT 1, 'p_retailprice', u, v, rows FROM p UNION ALL SELECT 2, 'index', 0, rows - 1, rows FROM p""")
def _(spark, d):
    path = f"{shared_dir(spark)}/halves-{uuid.uuid4().hex}"
    folders = grids.write_halves(load(spark, d, "part").select("p_size", "p_retailprice").repartition(1), path)
    out = grids.halves_schema(spark, folders.first()["folder"])
    remove(spark, path)
    return out


# hierarchies and densities --------------------------------------------------------------------------------------
ND_AXES = ["l_quantity", "l_extendedprice", "l_discount"]
UNIT_SQL = "u AS (SELECT " + ", ".join(f"({a} - min({a}) OVER ()) / (max({a}) OVER () - min({a}) OVER ()) AS {a}" for a in ND_AXES) + " FROM lineitem)"
CELL = "CAST(least(floor({a} * {n}), {n} - 1) AS BIGINT)"
CENTRE_SQL = f"WITH {UNIT_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS axis, {n} AS level, {CELL.format(a=a, n=27)} // {3 ** (2 - n)} AS cell, count(*) AS n, round(avg({a}), 7) AS centre, round(min({a}), 7) AS lo, round(max({a}), 7) AS hi FROM u GROUP BY 3" for a in ND_AXES for n in range(3)
)
query("axis_hierarchy", "lineitem", CENTRE_SQL)(lambda df: hierarchy.level_centres(df, ND_AXES, 3, 3, 3).withColumns({x: F.round(x, 7) for x in ("centre", "lo", "hi")}))
COMBO_SQL = f"WITH {UNIT_SQL} " + " UNION ALL ".join(
    f"SELECT '{a},{b}' AS axes, {CELL.format(a=a, n=9)} AS first, {CELL.format(a=b, n=9)} AS second, count(*) AS n FROM u GROUP BY 2, 3" for i, a in enumerate(ND_AXES) for b in ND_AXES[i + 1 :]
)
query("combination_counts", "lineitem", COMBO_SQL)(lambda df: hierarchy.combination_counts(df, ND_AXES, 2, 9).select("axes", c("cells")[0].alias("first"), c("cells")[1].alias("second"), "n"))
VOLUME_SQL = f"""WITH v AS (SELECT l_orderkey, l_partkey, {', '.join(f"({a} - min({a}) OVER ()) / (max({a}) OVER () - min({a}) OVER ()) AS {a}" for a in ('l_quantity', 'l_discount', 'l_tax', 'l_extendedprice'))} FROM lineitem),
r AS (SELECT {CELL.format(a='l_quantity', n=6)} AS x, {CELL.format(a='l_discount', n=6)} AS y, {CELL.format(a='l_tax', n=6)} AS z, l_extendedprice AS v, l_orderkey AS o, l_partkey AS p FROM v),
q AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY o DESC, p DESC, v DESC) AS i FROM r)"""
VOXELS = ["l_quantity", "l_discount", "l_tax"]
volume = lambda df: hierarchy.density_volume(df, VOXELS, 6, "l_extendedprice", ["l_orderkey", "l_partkey"])
query("density_volume_3d", "lineitem", VOLUME_SQL + " SELECT x, y, z, round(v, 7) AS v FROM q WHERE i = 1")(lambda df: volume(df).withColumn("v", F.round("v", 7)))
query("density_histogram_3d", "lineitem", VOLUME_SQL + " SELECT CAST(floor(v * 11 + 0.5) AS BIGINT) AS bin, count(*) AS n FROM q WHERE i = 1 GROUP BY 1")(lambda df: hierarchy.density_histogram(volume(df), 12))

# violins' overlaps and sides ------------------------------------------------------------------------------------
SIDED = [("l_quantity", 0.0, 50.0, 10), ("l_extendedprice", 0.0, 105000.0, 10), ("l_discount", 0.0, 0.1, 10), ("l_tax", 0.0, 0.08, 10)]
OVERLAP_SQL = "WITH h AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, {_line_bin(a, lo, hi, n)} AS bin, count(*) AS n FROM lineitem GROUP BY 2" for a, lo, hi, n in SIDED) + ")"
query("hist_pair_overlaps", "lineitem", OVERLAP_SQL + " SELECT a.axis AS a, b.axis AS b, CAST(sum(least(a.n, b.n)) AS BIGINT) AS overlap, round(sum(least(a.n, b.n)) / (SELECT count(*) FROM lineitem), 9) AS share FROM h a JOIN h b ON a.bin = b.bin AND a.axis < b.axis GROUP BY 1, 2")(
    lambda df: H.pair_overlaps(H.axis_counts(df, SIDED)).withColumn("share", F.round("share", 9))
)

# scores in [0, 1], the other opacities and bubble sizes ---------------------------------------------------------
UNIT_PCA_SQL = """WITH n AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER () + 1e-6) AS a, (p_retailprice - avg(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER () + 1e-6) AS b FROM part),
v AS (SELECT avg(a) AS u, avg(b) AS w, covar_samp(a, a) AS x, covar_samp(a, b) AS y, covar_samp(b, b) AS z FROM n), l AS (SELECT *, (x + z) / 2 + sqrt((x - z) * (x - z) / 4 + y * y) AS e FROM v),
q AS (SELECT u, w, y AS p, e - x AS r FROM l), o AS (SELECT u, w, p / sqrt(p * p + r * r) AS p, r / sqrt(p * p + r * r) AS r FROM q),
t AS (SELECT u, w, p * CASE WHEN abs(p) >= abs(r) THEN sign(p) ELSE sign(r) END AS p, r * CASE WHEN abs(p) >= abs(r) THEN sign(p) ELSE sign(r) END AS r FROM o), f AS (SELECT p_partkey, p * (a - u) + r * (b - w) AS s FROM n, t)
SELECT p_partkey, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS pc0 FROM f"""
query("pca_unit_scores", "part", UNIT_PCA_SQL)(lambda df: stats.pca_unit(df.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 1).select("p_partkey", F.round("pc0", 6).alias("pc0")))
MODES = {"constant": "0.001::DOUBLE", "square": "pow(1 - pow(0.999, n), 2)", "log": "ln(2 - pow(0.999, n))", "adoption": "0.001::DOUBLE * n"}
query("alpha_modes", "lineitem", f"SELECT bin, {', '.join(f'round({e}, 9) AS {m}' for m, e in MODES.items())} FROM (SELECT {_line_bin('l_quantity', 0.0, 50.0, 10)} AS bin, count(*) AS n FROM lineitem GROUP BY 1)")(
    lambda df: H.hist(df, [("l_quantity", 0.0, 50.0, 10)]).select("bin", *[F.round(brush.alpha(c("n"), 0.001, m), 9).alias(m) for m in MODES])
)
SIZES = {"plain": ("(p_size - 1) / 49.0", "identity", True), "root": ("sqrt((p_size - 1) / 49.0)", "sqrt", True), "log_of_size": ("ln(abs(p_size) + 1)", "log", False), "root_of_size": ("sqrt(abs(p_size))", "sqrt", False)}
query("bubble_sizes", "part", f"SELECT p_partkey, {', '.join(f'round({e}, 9) AS {n}' for n, (e, _, _) in SIZES.items())} FROM part")(
    lambda df: df.select("p_partkey", *[F.round(nodes.bubble_size(c("p_size").cast("double"), 1.0, 50.0, s, unit), 9).alias(n) for n, (_, s, unit) in SIZES.items()])
)

# wavelets and back, vectors of a table's size -------------------------------------------------------------------
BACK_SQL = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"
for _name, _kind in (("wavelet_back", "9/7"), ("wavelet_53_back", "5/3")):
    query(_name, "orders", BACK_SQL)(
        lambda df, k=_kind: codec.unlifted(codec.lifted(df.withColumn("cents", F.round(c("o_totalprice") * 100)), "o_orderkey", "cents", "o_custkey", k), "o_custkey", k).select("o_custkey", "i", F.round("x").cast("long").alias("cents"))
    )
query("node_vectors", "part", "SELECT p_partkey, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, row_number() OVER (ORDER BY p_partkey) - 1 AS iota, round(CAST(('0x' || substr(md5(p_partkey || '|7'), 1, 12)) AS BIGINT) / 281474976710656.0, 9) AS random FROM part")(
    lambda df: ranks.position(df.select("p_partkey"), "p_partkey", name="iota").select("p_partkey", F.lit(0.0).alias("zero"), F.lit(1.0).alias("one"), "iota", F.round(nodes.hashed_uniform(c("p_partkey"), 7), 9).alias("random"))
)
NODES_SQL = LEADERS_SQL[: LEADERS_SQL.rindex("SELECT k AS c_custkey")] + "SELECT CAST(leader AS BIGINT) AS leader, count(*) AS n, round(avg(c_nationkey), 6) AS nation, round(avg(c_acctbal), 6) AS balance FROM s JOIN customer ON k = c_custkey GROUP BY 1"
query("leader_nodes", "customer", NODES_SQL)(
    lambda df: stats.leader(df, ["c_nationkey", "c_acctbal"], "c_custkey", [3.0, 600.0]).join(df, "c_custkey").groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_nationkey"), 6).alias("nation"), F.round(F.avg("c_acctbal"), 6).alias("balance"))
)

DEEP = "[h for h in t.heads if p.u >= h.u - 0.75 and p.u <= h.u + 0.75 and p.v >= h.v - 150 and p.v <= h.v + 150]"
LEVELS_SQL = LEADERS_SQL[: LEADERS_SQL.rindex("SELECT k AS c_custkey")].rstrip() + f""", p AS (SELECT o.k, u, v, leader AS g, row_number() OVER (PARTITION BY leader ORDER BY o.k) AS i FROM s JOIN o ON s.k = o.k),
t(g, k, i, heads, leader) AS (SELECT g, k, i, [{{'n': 0, 'u': u, 'v': v}}], 0 FROM p WHERE i = 1 UNION ALL
  SELECT p.g, p.k, p.i, CASE WHEN len({DEEP}) > 0 THEN t.heads ELSE list_append(t.heads, {{'n': len(t.heads)::INTEGER, 'u': p.u, 'v': p.v}}) END, CASE WHEN len({DEEP}) > 0 THEN ({DEEP})[1].n ELSE len(t.heads)::INTEGER END
  FROM t JOIN p ON p.g = t.g AND p.i = t.i + 1)
SELECT k AS c_custkey, CAST(g AS BIGINT) AS level0, CAST(leader AS BIGINT) AS level1 FROM t"""
query("leader_hierarchy", "customer", LEVELS_SQL)(lambda df: stats.leader_levels(df, ["c_nationkey", "c_acctbal"], "c_custkey", [3.0, 600.0], 0.5, 2))

WIDE_SQL = " UNION ALL ".join(
    f"SELECT p_size AS list, '{a}' AS attribute, min({a}) - CASE WHEN min({a}) = max({a}) THEN 0.02 ELSE 0 END AS lo, (min({a}) + max({a})) / 2.0 AS mid, max({a}) + CASE WHEN min({a}) = max({a}) THEN 0.02 ELSE 0 END AS hi, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS alpha FROM part GROUP BY 1"
    for a in ("p_size", "p_retailprice")
)
query("cluster_bundles_widened", "part", f"SELECT list, attribute, round(lo::DOUBLE, 6) AS lo, round(mid::DOUBLE, 6) AS mid, round(hi::DOUBLE, 6) AS hi, alpha FROM ({WIDE_SQL})")(
    lambda df: lists.cluster_bundles(df, "p_size", ["p_size", "p_retailprice"]).withColumns({x: F.round(x, 6) for x in ("lo", "mid", "hi", "alpha")})
)
