"""All queries over the engine's own operators and their SQL."""

from __future__ import annotations

import itertools
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import brush as B
from .functions import nodes as N
from .operators import codec, dims, embedding, histogram as H, ranks, stats
from .operators.space import Space
from .operators.ward import ward_line
from .plans.graph import Graph
from .sources import tables
from .streaming import histogram as streaming

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(name: str, table: str | None, sql: str | None = None):
    """Register f(table) or, without a table, f(spark, sf_dir)."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.read.parquet(f"{sf_dir}/{table}.parquet")) if table else f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


# selection ------------------------------------------------------------------------------------------------------
MAIN = B.Brush({"l_quantity": [(5, 15), (30, 40)], "l_discount": [(0.02, 0.06)]})
SECOND = B.Brush({"l_tax": [(0.0, 0.03)]})
MAIN_SQL = "((l_quantity BETWEEN 5 AND 15 OR l_quantity BETWEEN 30 AND 40) AND l_discount BETWEEN 0.02 AND 0.06)"
SECOND_SQL = "(l_tax BETWEEN 0.0 AND 0.03)"
PENTAGON = [(5.0, 2000.0), (45.0, 10000.0), (48.0, 60000.0), (25.0, 50000.0), (8.0, 20000.0)]


def grouped(df: DataFrame) -> DataFrame:
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def grouped_sql(where: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE {where} GROUP BY 1, 2"


def lasso_sql(x: str, y: str, polygon) -> str:
    parts = [f"CASE WHEN ({y} < {ay}) <> ({y} < {by}) AND {x} < {ax} + ({y} - {ay}) * {(bx - ax) / (by - ay)!r} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]) if ay != by]
    return "(" + " + ".join(parts) + ") % 2 = 1"


BOXES = [{"l_quantity": (1, 10), "l_extendedprice": (1000, 9000)}, {"l_quantity": (20, 30), "l_extendedprice": (30000, 50000)}]
BOX_SQL = " OR ".join("(" + " AND ".join(f"{k} BETWEEN {lo} AND {hi}" for k, (lo, hi) in b.items()) + ")" for b in BOXES)
GAUSS = (["p_size", "p_retailprice"], [25.0, 910.0], [[0.8, 0.6], [-0.6, 0.8]], [200.0, 30.0], 1.2)
for _name, _where, _sql in (
    ("brush_range_and", lambda: B.combine([MAIN]), MAIN_SQL),
    ("brush_and", lambda: B.combine([MAIN, SECOND]), f"{MAIN_SQL} AND {SECOND_SQL}"),
    ("brush_or", lambda: B.combine([MAIN, SECOND], "or"), f"{MAIN_SQL} OR {SECOND_SQL}"),
    ("brush_xor", lambda: B.combine([MAIN, SECOND], "xor"), f"{MAIN_SQL} <> {SECOND_SQL}"),
    ("brush_multi_range", lambda: B.in_ranges("l_quantity", [(1, 3), (10, 12), (40, 50)]), "l_quantity BETWEEN 1 AND 3 OR l_quantity BETWEEN 10 AND 12 OR l_quantity BETWEEN 40 AND 50"),
    ("brush_tolerance", lambda: B.in_ranges("l_quantity", [(5, 10)], 0.5), "l_quantity BETWEEN 4.5 AND 10.5"),
    ("brush_none", lambda: B.combine([]), "true"),
    ("brush_lasso", lambda: B.in_lasso("l_quantity", "l_extendedprice", PENTAGON), lasso_sql("l_quantity", "l_extendedprice", PENTAGON)),
    ("brush_box_union", lambda: B.in_boxes(BOXES), BOX_SQL),
    ("brush_global_local", lambda: B.active(MAIN.column(), SECOND.column()), f"{MAIN_SQL} AND {SECOND_SQL}"),
    ("brush_global_or_local", lambda: B.active(MAIN.column(), SECOND.column(), "or"), f"{MAIN_SQL} OR {SECOND_SQL}"),
    ("brush_immune", lambda: B.active(MAIN.column(), SECOND.column(), immune=True), SECOND_SQL),
):
    query(_name, "lineitem", grouped_sql(_sql))(lambda df, w=_where: grouped(df.where(w())))

query("brush_mahalanobis", "part", "SELECT count(*) AS n FROM part WHERE pow(0.8 * (p_size - 25) + 0.6 * (p_retailprice - 910), 2) / 200 + pow(-0.6 * (p_size - 25) + 0.8 * (p_retailprice - 910), 2) / 30 <= 2.88")(lambda df: count(df.where(B.in_gaussian(*GAUSS))))
query("brush_ratio", "lineitem", f"SELECT count(CASE WHEN {MAIN_SQL} THEN 1 END) AS active, count(*) AS total FROM lineitem")(lambda df: df.agg(F.count_if(MAIN.column()).alias("active"), F.count(F.lit(1)).alias("total")))
query("active_indices", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 100000 THEN 1 ELSE 0 END AS active FROM orders")(lambda df: df.select("o_orderkey", F.when(B.in_ranges("o_totalprice", [(1000, 100000)]), 1).otherwise(0).alias("active")))


@query("list_semi", None, "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def _(spark, d):
    return load(spark, d, "orders").join(load(spark, d, "customer").where("c_acctbal > 5000"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey")


@query("list_anti", None, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
def _(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("list_explicit", "orders", "SELECT pos, o_orderkey, o_totalprice FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 100)) AS v(pos, k) JOIN orders ON o_orderkey = k")
def _(df):
    ids = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, (5, 3, 5, 100)))).alias("pos", "k"))
    return df.join(F.broadcast(ids), c("o_orderkey") == c("k")).select("pos", "o_orderkey", "o_totalprice")


@query("trim_subsample", "orders", "SELECT (o_orderkey - 10) // 7 AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 5000 AND (o_orderkey - 10) % 7 = 0")
def _(df):
    return dims.subsample(df.select("o_orderkey", "o_totalprice"), {"o_orderkey": (10, 5000, 7)})


query("dim_slice", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 2")(lambda df: dims.slice_at(df.select("l_orderkey", "l_linenumber", "l_quantity"), "l_linenumber", 2))
query("projection", "part", "SELECT p_partkey, p_size FROM part")(lambda df: df.select("p_partkey", "p_size"))
query("attribute_filter", "lineitem", "SELECT l_extendedprice, l_discount, l_shipdate FROM lineitem")(lambda df: df.select(*tables.matching(df.columns, "price|disc|date")))
query("random_subsample", "orders")(lambda df: dims.random_draws(df, "o_orderkey", 10).select("o_orderkey"))


def by_list(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


query("split_uniform", "lineitem", "SELECT CAST(least(greatest(floor((l_extendedprice - 900) / (105000 - 900) * 7 + 0.5), 0), 7) AS BIGINT) AS list, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")(lambda df: by_list(df.withColumn("list", B.uniform_bin(c("l_extendedprice"), 900.0, 105000.0, 8)), "l_extendedprice"))
query("split_value", "part", "SELECT CAST(least((p_size >= 5)::INT + (p_size >= 20)::INT + (p_size >= 40)::INT, 2) AS BIGINT) AS list, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1")(lambda df: by_list(df.withColumn("list", B.value_bin(c("p_size"), [5, 20, 40])), "p_size"))
query("split_quantile", "orders", "WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p, count(*) OVER () AS t FROM orders) SELECT CAST((p >= floor(t * 0.25))::INT + (p >= floor(t * 0.6))::INT AS BIGINT) AS list, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM r GROUP BY 1")(lambda df: by_list(ranks.quantile_split(df.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", [0.0, 0.25, 0.6, 1.0]), "o_totalprice"))


@query("split_auto", "lineitem", "SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING (SELECT count(DISTINCT l_quantity) * 10 <= count(*) FROM lineitem)")
def _(df):
    groups = df.groupBy(c("l_quantity").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg((F.count(F.lit(1)) * 10 <= F.sum("n")).alias("ok"))
    return groups.crossJoin(F.broadcast(total)).where("ok").drop("ok")


# histograms -----------------------------------------------------------------------------------------------------
AXES = [("l_quantity", 1.0, 50.0, 32), ("l_extendedprice", 900.0, 105000.0, 32), ("l_discount", 0.0, 0.1, 8), ("l_tax", 0.0, 0.08, 8)]


def bin_sql(axes) -> str:
    parts, stride = [], 1
    for col, lo, hi, n in axes:
        parts.append(f"CAST(floor(least(greatest(({col} - {lo}) / ({hi} - {lo}) * {n}, 0), {n - 1})) AS BIGINT) * {stride}")
        stride *= n
    return " + ".join(parts)


for _n in (1, 2, 3, 4):
    query(f"hist_{_n}d", "lineitem", f"SELECT {bin_sql(AXES[:_n])} AS bin, count(*) AS n FROM lineitem WHERE {MAIN_SQL} GROUP BY 1")(lambda df, n=_n: H.hist(df, AXES[:n], MAIN.column()))
PRIORITY_SQL = "CAST(255 - least(floor(abs(l_quantity - 20) / 30 * 255 + 0.5), 255) AS BIGINT)"
for _how in ("min", "max", "sum"):
    query(f"hist_priority_{_how}", "lineitem", f"SELECT {bin_sql(AXES[1:2])} AS bin, CAST({_how}({PRIORITY_SQL}) AS BIGINT) AS n FROM lineitem GROUP BY 1")(lambda df, h=_how: H.hist(df, AXES[1:2], value=B.priority(c("l_quantity"), 20.0, 30.0), how=h))
PAIRS = {f"{a[0]}|{b[0]}": [a, b] for a, b in itertools.combinations(AXES, 2)}
query("hist_all_pairs", "lineitem", " UNION ALL ".join(f"SELECT '{k}' AS hist, {bin_sql(a)} AS bin, count(*) AS n FROM lineitem GROUP BY 2" for k, a in PAIRS.items()))(lambda df: H.hist_many(df, PAIRS))
query("hist_adjacent_pairs", "lineitem", " UNION ALL ".join(f"SELECT '{a[0]}>{b[0]}' AS hist, {bin_sql([a, b])} AS bin, count(*) AS n FROM lineitem WHERE {MAIN_SQL} GROUP BY 2" for a, b in zip(AXES, AXES[1:])))(lambda df: H.hist_many(df, {f"{a[0]}>{b[0]}": [a, b] for a, b in zip(AXES, AXES[1:])}, MAIN.column()))


@query("hist_registry", "lineitem", f"SELECT 'l_extendedprice:32|l_quantity:32' AS hist, {bin_sql([AXES[1], AXES[0]])} AS bin, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_discount:8', {bin_sql([AXES[2]])}, count(*) FROM lineitem GROUP BY 2")
def _(df):
    r = H.Registry()
    for axes in ([AXES[0], AXES[1]], [AXES[1], AXES[0]], [AXES[2]], [AXES[3]]):
        r.register(axes)
    r.release([AXES[3]])
    return r.compute(df)


P1 = ("l_extendedprice", 900.0, 105000.0, 24)
DENSE = f"SELECT b.range AS bin, coalesce(n, 0) AS n FROM range(24) b LEFT JOIN (SELECT {bin_sql([P1])} AS bin, count(*) AS n FROM lineitem WHERE {{w}} GROUP BY 1) h ON b.range = h.bin"
ALL_BINS, SOME_BINS = DENSE.format(w="true"), DENSE.format(w=MAIN_SQL)


def price_hist(df: DataFrame, where=None) -> DataFrame:
    return H.dense(H.hist(df, [P1], where), 24)


query("hist_dense", "lineitem", SOME_BINS)(lambda df: price_hist(df, MAIN.column()))
query("hist_smooth", "lineitem", f"WITH h AS ({ALL_BINS}), k AS (SELECT range - 6 AS k, exp(-pow(range - 6, 2) / 8.0) AS w FROM range(13)) SELECT h.bin + k AS bin, round(sum(n * w) / sum(w), 6) AS v FROM h, k WHERE h.bin + k BETWEEN 0 AND 23 GROUP BY 1")(lambda df: H.smooth(price_hist(df), 24, 2.0).withColumn("v", F.round("v", 6)))
query("hist_overlap", "lineitem", f"SELECT CAST(sum(least(a.n, b.n)) AS BIGINT) AS overlap FROM ({ALL_BINS}) a JOIN ({SOME_BINS}) b ON a.bin = b.bin")(lambda df: H.paired_overlap(H.paired(df, [P1], MAIN.column())))
query("hist_chi2", "lineitem", f"SELECT round(sum(CASE WHEN a.n + b.n > 0 THEN pow(a.n - b.n, 2) / (a.n + b.n) END) / 2 / sum(a.n), 9) AS distance FROM ({ALL_BINS}) a JOIN ({SOME_BINS}) b ON a.bin = b.bin")(lambda df: H.paired_chi_square(H.paired(df, [P1], MAIN.column())).withColumn("distance", F.round("distance", 9)))
query("hist_bundles", "lineitem", f"WITH h AS ({SOME_BINS}), w AS (SELECT *, lag(n) OVER (ORDER BY bin) AS b, lead(n) OVER (ORDER BY bin) AS a FROM h), s AS (SELECT *, CAST(sum(CASE WHEN n < b AND n <= a THEN 1 ELSE 0 END) OVER (ORDER BY bin) AS BIGINT) AS segment FROM w) SELECT segment, min(bin) AS first, max(bin) AS last, round(CASE WHEN sum(n) > 0 THEN sum(bin * n) / sum(n) END, 9) AS middle, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY segment")(lambda df: H.bundles(price_hist(df, MAIN.column())).withColumn("middle", F.round("middle", 9)))
query("hist_axis", "lineitem", "SELECT CAST(floor((l_extendedprice - 5000) / 55000 * 0.999999 * 16) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 5000 AND 60000 GROUP BY 1")(lambda df: df.where(c("l_extendedprice").between(5000, 60000)).groupBy(F.floor((c("l_extendedprice") - 5000.0) / 55000.0 * 0.999999 * 16).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
query("hist_dim_reduce", "lineitem", f"SELECT bin % 32 AS bin, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {bin_sql(AXES[:2])} AS bin, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")(lambda df: H.hist(df, AXES[:2]).groupBy((c("bin") % 32).alias("bin")).agg(F.sum("n").alias("n")))
query("pair_min_distance", "lineitem", f"SELECT {bin_sql(AXES[2:])} AS bin, min(abs(l_quantity - 20)) AS d FROM lineitem GROUP BY 1")(lambda df: df.groupBy(H.bins(AXES[2:]).alias("bin")).agg(F.min(F.abs(c("l_quantity") - 20)).alias("d")))
query("cluster_bundles", "lineitem", "SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, (min(l_quantity) + max(l_quantity)) / 2 AS mid, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS alpha FROM lineitem GROUP BY 1")(lambda df: df.groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), ((F.min("l_quantity") + F.max("l_quantity")) / 2).alias("mid"), F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("t")))).select("l_returnflag", "lo", "hi", "mid", F.round(F.lit(100.0) * c("k") / c("t"), 6).alias("alpha")))
query("alpha_mapping", "lineitem", "SELECT bin, round(1 - pow(0.999, n), 9) AS multiplicative, round(greatest(1 - pow(0.999, n), 0.03), 9) AS bounded, round(sqrt(1 - pow(0.999, n)), 9) AS root, round((1 - exp(1 - n)) * 0.001, 9) AS complement FROM (" + f"SELECT {bin_sql([P1])} AS bin, count(*) AS n FROM lineitem GROUP BY 1)")(lambda df: H.hist(df, [P1]).select("bin", *[F.round(B.alpha(c("n"), 0.001, m), 9).alias(a) for a, m in (("multiplicative", "multiplicative"), ("bounded", "bounded"), ("root", "sqrt"), ("complement", "complement"))]))
query("bounds", "lineitem", "SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0, max(l_extendedprice) AS p1 FROM lineitem")(lambda df: df.agg(F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"), F.min("l_extendedprice").alias("p0"), F.max("l_extendedprice").alias("p1")))
query("median_line", "lineitem", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS quantity, round(quantile_cont(l_extendedprice, 0.5), 4) AS price FROM lineitem GROUP BY 1")(lambda df: df.groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.5).alias("quantity"), F.round(F.percentile("l_extendedprice", 0.5), 4).alias("price")))
query("distinct_values", "lineitem", "SELECT DISTINCT l_discount FROM lineitem")(lambda df: df.select("l_discount").distinct())
query("violin_scaling", "lineitem", f"SELECT bin, round(n / max(n) OVER (), 9) AS v FROM ({ALL_BINS})")(lambda df: price_hist(df).crossJoin(F.broadcast(price_hist(df).agg(F.max("n").alias("m")))).select("bin", F.round(c("n") / c("m"), 9).alias("v")))


# derivation nodes -----------------------------------------------------------------------------------------------
UNARY = {
    "identity": "x", "cast_float": "CAST(x AS DOUBLE)", "cast_index": "CAST(floor(x) AS BIGINT)", "inverse": "CASE WHEN x <> 0 THEN 1.0 / x END", "negate": "-x", "absolute": "abs(x)", "square": "x * x",
    "sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END", "exp": "exp(x)", "log": "CASE WHEN x > 0 THEN ln(x) END", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "asin": "CASE WHEN abs(x) <= 1 THEN asin(x) END",
    "acos": "CASE WHEN abs(x) <= 1 THEN acos(x) END", "atan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)", "ceil": "ceil(x)", "floor": "floor(x)",
}
X_SQL = "SELECT p_partkey, CAST((p_size - 25) / 10.0 AS DOUBLE) AS x, CAST(p_retailprice / 300 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS z FROM part"


def xyz(df: DataFrame) -> DataFrame:
    return df.select("p_partkey", ((c("p_size") - 25) / 10.0).alias("x"), (c("p_retailprice") / 300).alias("y"), c("p_size").cast("double").alias("z"))


for _op, _sql in UNARY.items():
    _r = (lambda v: v) if _op == "cast_index" else (lambda v: F.round(v, 9))
    query(f"node_{_op}", "part", f"SELECT p_partkey, {_sql if _op == 'cast_index' else f'round({_sql}, 9)'} AS v FROM ({X_SQL})")(lambda df, o=_op, r=_r: xyz(df).select("p_partkey", r(N.NODES[o].build(c("x"))).alias("v")))
for _op, _sql in {"plus": "x + y", "minus": "x - y", "multiplication": "x * y", "division": "CASE WHEN y <> 0 THEN x / y END", "pow": "pow(y, x)", "min": "least(x, y)", "max": "greatest(x, y)"}.items():
    query(f"node_{_op}", "part", f"SELECT p_partkey, round({_sql}, 8) AS v FROM ({X_SQL})")(lambda df, o=_op: xyz(df).select("p_partkey", F.round(N.NODES[o].build(*([c("y"), c("x")] if o == "pow" else [c("x"), c("y")])), 8).alias("v")))
for _op, _sql, _build in (
    ("sum", "2 * x - 0.5 * y + z", lambda: N.weighted_sum(c("x"), c("y"), c("z"), factors=[2, -0.5, 1])),
    ("product", "pow(y, 2) * pow(z, -1)", lambda: N.weighted_product(c("y"), c("z"), exponents=[2, -1])),
    ("lp_norm", "pow(pow(abs(x), 3) + pow(abs(y), 3), 1.0 / 3)", lambda: N.lp_norm(c("x"), c("y"), p=3)),
    ("clamp", "least(greatest(x, -1), 1.5)", lambda: N.clamp(c("x"), -1.0, 1.5)),
    ("bubble_size", "ln((z - 1) / 49 + 1)", lambda: N.bubble_size(c("z"), 1.0, 50.0, "log")),
    ("vec_norm", "sqrt(x * x + y * y + z * z)", lambda: N.vec_norm(N.vec(c("x"), c("y"), c("z")))),
    ("vec_square", "x * x + y * y", lambda: F.aggregate(N.vec_square(N.vec(c("x"), c("y"))), F.lit(0.0), lambda a, b: a + b)),
    ("vec_plus", "y + z", lambda: N.vec_op(N.vec(c("x"), c("y")), N.vec(c("y"), c("z")), "plus")[1]),
    ("vec_minus", "y - z", lambda: N.vec_op(N.vec(c("x"), c("y")), N.vec(c("y"), c("z")), "minus")[1]),
    ("vec_multiplication", "y * z", lambda: N.vec_op(N.vec(c("x"), c("y")), N.vec(c("y"), c("z")), "multiplication")[1]),
    ("vec_division", "y / z", lambda: N.vec_op(N.vec(c("x"), c("y")), N.vec(c("y"), c("z")), "division")[1]),
):
    query(f"node_{_op}", "part", f"SELECT p_partkey, round({_sql}, 8) AS v FROM ({X_SQL})")(lambda df, b=_build: xyz(df).select("p_partkey", F.round(b(), 8).alias("v")))


@query("node_normalize", "part", "SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 9) AS v FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def _(df):
    b = df.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).first()
    return df.select("p_partkey", F.round(N.normalize(c("p_retailprice"), b["lo"], b["hi"]), 9).alias("v"))


query("node_rank", "part", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_retailprice) - 1 AS BIGINT) AS rank FROM part")(lambda df: ranks.dense_rank(df.select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "rank"))
query("node_linearize", "part", "SELECT p_partkey, round(lo + (r - 1) / (k - 1) * (hi - lo), 9) AS linear FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY p_retailprice) AS r FROM part), (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(DISTINCT p_retailprice) AS k FROM part)")(lambda df: ranks.linearize(df.select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("linear", 9).alias("linear")))
query("node_constants", None, "SELECT range AS i, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, CAST(range AS DOUBLE) AS iota FROM range(100)")(lambda spark, d: spark.range(100).select(c("id").alias("i"), F.lit(0.0).alias("zero"), F.lit(1.0).alias("one"), c("id").cast("double").alias("iota")))
query("node_random", None)(lambda spark, d: spark.range(100).select("id", F.rand(7).alias("v")))
GRAPH = Graph().add("a", "plus", "x", "y").add("b", "multiplication", "a", "a").add("unused", "exp", "z").add("out", "sum", "b", "z", factors=[0.5, 2])
query("derivation_graph", "part", f"SELECT p_partkey, round(0.5 * (x + y) * (x + y) + 2 * z, 8) AS out FROM ({X_SQL})")(lambda df: GRAPH.apply(xyz(df), ["out"]).select("p_partkey", F.round("out", 8).alias("out")))

# reductions that every row of a group gets; orders have few rows per customer, so windows stay small
for _how, _sql in {"min": "min(o_totalprice)", "max": "max(o_totalprice)", "sum": "round(sum(o_totalprice), 4)", "stddev": "round(stddev_pop(o_totalprice), 4)"}.items():
    query(f"red_{_how}", "orders", f"SELECT o_orderkey, {_sql[:-4] + ' OVER (PARTITION BY o_custkey), 4)' if _sql.startswith('round') else _sql + ' OVER (PARTITION BY o_custkey)'} AS v FROM orders")(
        lambda df, h=_how: df.select("o_orderkey", (lambda v: v if h in ("min", "max") else F.round(v, 4))(N.reduction(c("o_totalprice"), ["o_custkey"], h)).alias("v"))
    )
query("red_avg", "orders", "SELECT o_orderkey, avg(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey) AS v FROM orders")(lambda df: df.select("o_orderkey", N.reduction(F.round(c("o_totalprice") * 100).cast("long"), ["o_custkey"], "avg").alias("v")))
query("red_product", "orders", "SELECT o_custkey, round(product(o_totalprice / 100000), 6) AS v FROM orders GROUP BY 1")(lambda df: df.groupBy("o_custkey").agg(F.round(F.product(c("o_totalprice") / 100000), 6).alias("v")))
DAILY = "SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM orders GROUP BY 1"
for _k, _sql in {"forward": "coalesce(lead(v) OVER w, v) - v", "backward": "v - coalesce(lag(v) OVER w, v)", "central": "(coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / 2"}.items():
    query(f"derivative_{_k}", "orders", f"SELECT day, {_sql} AS d FROM ({DAILY}) WINDOW w AS (ORDER BY day)")(
        lambda df, k=_k: df.groupBy(c("o_orderdate").cast("date").alias("day")).agg(F.sum(F.round(c("o_totalprice") * 100).cast("long")).cast("double").alias("v")).transform(stats.derivative, "v", "day", k).select("day", "d")
    )


# dimensions, joins, sets ----------------------------------------------------------------------------------------
@query("inflate_join", None, "SELECT n_nationkey, r_regionkey, n_nationkey * 10 + r_regionkey AS v FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    a = load(spark, d, "nation").select("n_nationkey", c("n_regionkey").alias("r_regionkey"))
    return dims.inflate(a, load(spark, d, "region").select("r_regionkey"), ["n_nationkey", "r_regionkey"], ["r_regionkey"]).select("n_nationkey", "r_regionkey", (c("n_nationkey") * 10 + c("r_regionkey")).alias("v"))


@query("inflate_repeat", None, "SELECT n_nationkey, r_regionkey, n_nationkey + 100 * r_regionkey AS v FROM nation, region")
def _(spark, d):
    return dims.inflate(load(spark, d, "nation").select("n_nationkey"), load(spark, d, "region").select("r_regionkey"), ["n"], ["r"]).withColumn("v", c("n_nationkey") + 100 * c("r_regionkey"))


query("row_ids", None, "SELECT range AS row_id, range // 12 AS a, (range // 4) % 3 AS b, range % 4 AS c FROM range(60)")(lambda spark, d: spark.range(60).select(c("id").alias("row_id"), *[dims.dim_of(c("id"), [5, 3, 4], i).alias(n) for i, n in enumerate("abc")]))
query("cartesian_code", None, "SELECT n_nationkey, r_regionkey, CAST(n_nationkey * 5 + r_regionkey AS BIGINT) AS code FROM nation, region")(lambda spark, d: dims.inflate(load(spark, d, "nation").select("n_nationkey"), load(spark, d, "region").select("r_regionkey"), ["n"], ["r"]).withColumn("code", dims.row_id([c("n_nationkey"), c("r_regionkey")], [25, 5])))
query("csv_categories", "orders", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code FROM orders")(lambda df: tables.category_codes(df.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code"))
query("fixed_point", "part", "SELECT p_partkey, p_size / 65535.0::DOUBLE AS v FROM part")(lambda df: df.select("p_partkey", (c("p_size") / F.lit(65535.0)).alias("v")))
query("affine_decode", "part", "SELECT p_partkey, round(p_size * 0.25 + 3, 9) AS v FROM part")(lambda df: df.select("p_partkey", F.round(c("p_size") * 0.25 + 3, 9).alias("v")))
NATIONS = ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 4000")
for _op, _sql in {"union": f"{NATIONS[0]} UNION {NATIONS[1]}", "intersect": f"{NATIONS[0]} INTERSECT {NATIONS[1]}", "except": f"{NATIONS[0]} EXCEPT {NATIONS[1]}", "xor": f"({NATIONS[0]} EXCEPT {NATIONS[1]}) UNION ({NATIONS[1]} EXCEPT {NATIONS[0]})"}.items():

    @query(f"set_{_op}", None, _sql)
    def _(spark, d, op=_op):
        a = load(spark, d, "customer").where("c_acctbal > 9000").select(c("c_nationkey").alias("k"))
        b = load(spark, d, "supplier").where("s_acctbal > 4000").select(c("s_nationkey").alias("k"))
        return {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b), "xor": lambda: a.subtract(b).union(b.subtract(a))}[op]()


@query("bag_append", None, "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    a = load(spark, d, "customer").select(c("c_nationkey").alias("nation"), c("c_acctbal").alias("balance"))
    return a.unionByName(load(spark, d, "supplier").select(c("s_acctbal").alias("balance"), c("s_nationkey").alias("nation")))


query("priority_order", "part", "SELECT CAST(row_number() OVER (ORDER BY 255 - least(floor(abs(p_size - 20) / 30.0 * 255 + 0.5), 255), p_partkey) - 1 AS BIGINT) AS pos, p_partkey FROM part")(lambda df: ranks.position(df.select("p_partkey", B.priority(c("p_size"), 20.0, 30.0).alias("priority")), "priority", "p_partkey").select("pos", "p_partkey"))
query("sort_indirect", "orders", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey FROM orders")(lambda df: ranks.position(df.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("pos", "o_orderkey"))
query("first_values", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")(lambda df: df.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(50))
query("polyline_index", "part", "SELECT p_partkey, i AS pos, CASE WHEN i = 2 THEN -1 ELSE p_partkey * 2 + i END AS vertex FROM part, (VALUES (0), (1), (2)) AS v(i) WHERE p_size BETWEEN 10 AND 20")(lambda df: df.where(B.in_ranges("p_size", [(10, 20)])).select("p_partkey", F.posexplode(F.array(c("p_partkey") * 2, c("p_partkey") * 2 + 1, F.lit(-1).cast("long"))).alias("pos", "vertex")))


# statistics and learning ----------------------------------------------------------------------------------------
query("corr_pearson", "lineitem", " UNION ALL ".join(f"SELECT '{o}' AS attribute, round(corr(l_quantity, {o}), 8) AS r FROM lineitem" for o in ("l_extendedprice", "l_discount", "l_tax")))(lambda df: stats.pearson(df, "l_quantity", ["l_extendedprice", "l_discount", "l_tax"]).withColumn("r", F.round("r", 8)))
query("corr_spearman", "part", "SELECT round(corr(a, b), 8) AS r FROM (SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS a, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS b FROM part)")(lambda df: stats.spearman(df, "p_size", "p_retailprice", "p_partkey").withColumn("r", F.round("r", 8)))
query("corr_kendall", "supplier", "SELECT round(sum(sign(a.s_nationkey - b.s_nationkey) * sign(a.s_acctbal - b.s_acctbal)) / (SELECT count(*) * (count(*) - 1) / 2 FROM supplier), 8) AS tau FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")(lambda df: stats.kendall(df, "s_nationkey", "s_acctbal").withColumn("tau", F.round("tau", 8)))
COV = ["l_quantity", "l_discount", "l_tax"]
query("covariance", "lineitem", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 8) AS cov FROM lineitem" for i, a in enumerate(COV) for b in COV[i:]))(lambda df: stats.covariance(df, COV).withColumn("cov", F.round("cov", 8)))
query("range_selfjoin", "supplier", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a, supplier b WHERE pow(a.s_acctbal - b.s_acctbal, 2) + pow(a.s_nationkey - b.s_nationkey, 2) <= 2500")(lambda df: stats.within(df, ["s_acctbal", "s_nationkey"], "s_suppkey", 50.0).select("a", "b"))
query("nearest_distance", "supplier", "SELECT a.s_suppkey, round(min(sqrt(pow(a.s_acctbal - b.s_acctbal, 2) + pow(a.s_nationkey - b.s_nationkey, 2))), 6) AS distance FROM supplier a, supplier b WHERE b.s_nationkey < 5 GROUP BY 1")(lambda df: stats.nearest_flagged(df, ["s_acctbal", "s_nationkey"], "s_suppkey", c("s_nationkey") < 5).withColumn("distance", F.round("distance", 6)))
query("dbscan", "supplier", """WITH RECURSIVE n AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a, supplier b WHERE pow(a.s_acctbal - b.s_acctbal, 2) <= 3600), k AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 3),
r(a, b) AS (SELECT a, a FROM k UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a JOIN k ON n.b = k.a), l AS (SELECT a, min(b) AS label FROM r GROUP BY a), e AS (SELECT n.a, min(label) AS label FROM n JOIN l ON n.b = l.a GROUP BY n.a),
f AS (SELECT s_suppkey, coalesce(l.label, e.label) AS label FROM supplier LEFT JOIN l ON s_suppkey = l.a LEFT JOIN e ON s_suppkey = e.a)
SELECT s_suppkey, CAST(CASE WHEN label IS NULL THEN -1 ELSE (SELECT count(DISTINCT m.label) FROM l m WHERE m.label <= f.label) END AS BIGINT) AS cluster FROM f""")(lambda df: stats.dbscan(df, ["s_acctbal"], "s_suppkey", 60.0, 3))
CENTRES = [[10.0, 901.0], [25.0, 910.0], [40.0, 918.0]]


def kmeans_sql() -> str:
    best = "(SELECT c FROM {m} ORDER BY pow(p_size - x, 2) + pow(p_retailprice - y, 2), c LIMIT 1)"
    out = "WITH m0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(CENTRES)) + ") AS v(c, x, y))"
    for i in range(3):
        out += f", a{i} AS (SELECT p_size, p_retailprice, {best.format(m=f'm{i}')} AS c FROM part), m{i + 1} AS (SELECT m{i}.c, coalesce(avg(p_size), any_value(m{i}.x)) AS x, coalesce(avg(p_retailprice), any_value(m{i}.y)) AS y FROM m{i} LEFT JOIN a{i} ON a{i}.c = m{i}.c GROUP BY m{i}.c)"
    return out + f" SELECT p_partkey, CAST({best.format(m='m3')} AS BIGINT) AS cluster FROM part"


query("kmeans_lloyd", "part", kmeans_sql())(lambda df: stats.kmeans(df, ["p_size", "p_retailprice"], CENTRES, 3)[0].select("p_partkey", "cluster"))
query("bin_index", "orders", "SELECT CAST(floor(least(greatest(o_totalprice / 510000 * 20, 0), 19)) AS BIGINT) AS bin, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")(lambda df: df.groupBy(B.hist_bin(c("o_totalprice"), 0.0, 510000.0, 20).alias("bin")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n")))
ND = [(a[0], a[1], a[2], 8) for a in AXES[:3]]
ND_SQL = [bin_sql([a]) for a in ND]
query("nd_hierarchy", "lineitem", f"SELECT b0, b1, b2, count(*) AS n FROM (SELECT {', '.join(f'{s} AS b{i}' for i, s in enumerate(ND_SQL))} FROM lineitem) GROUP BY CUBE (b0, b1, b2)")(lambda df: df.select(*[H.bins([a]).alias(f"b{i}") for i, a in enumerate(ND)]).cube("b0", "b1", "b2").agg(F.count(F.lit(1)).alias("n")))
query("hierarchy_levels", "lineitem", " UNION ALL ".join(f"SELECT {k} AS level, CAST(floor(least(greatest((l_extendedprice - 900) / 104100 * 32, 0), 31)) AS BIGINT) // {2 ** k} AS bin, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY 2" for k in range(4)))(
    lambda df: (lambda f: reduce(lambda a, b: a.unionAll(b), [f.groupBy(F.lit(k).alias("level"), F.floor(c("bin") / 2**k).alias("bin")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")) for k in range(4)]))(df.groupBy(B.hist_bin(c("l_extendedprice"), 900.0, 105000.0, 32).alias("bin")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.count(F.lit(1)).alias("n")))
)
query("hash_cells", "orders", "SELECT CAST(floor(o_totalprice / 25000) AS BIGINT) AS cell, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")(lambda df: df.groupBy(F.floor(c("o_totalprice") / 25000).alias("cell")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n")))
VOX = "SELECT " + ", ".join(f"CAST(floor(({a} - {lo}) / ({hi} - {lo}) * {n - 1} + 0.5) AS BIGINT) AS {k}" for k, (a, lo, hi, n) in zip("xyz", [(x[0], x[1], x[2], 6) for x in AXES[:3]])) + ", max(CASE WHEN l_tax <= 0.02 THEN 1 ELSE 0 END) AS v FROM lineitem GROUP BY 1, 2, 3"


def voxels(df: DataFrame) -> DataFrame:
    return df.groupBy(*[B.uniform_bin(c(a), lo, hi, 6).alias(k) for k, (a, lo, hi, _) in zip("xyz", AXES[:3])]).agg(F.max(F.when(c("l_tax") <= 0.02, 1).otherwise(0)).alias("v"))


query("voxel_binary", "lineitem", VOX)(voxels)
query("voxel_smooth", "lineitem", f"SELECT x + k AS x, y, z, round(sum(v * exp(-k * k / 2.0)) / (SELECT sum(exp(-k * k / 2.0)) FROM (SELECT range - 3 AS k FROM range(7))), 8) AS v FROM ({VOX}), (SELECT range - 3 AS k FROM range(7)) GROUP BY 1, 2, 3")(lambda df: H.voxel_smooth(voxels(df), "x", 1.0).withColumn("v", F.round("v", 8)))
query("density_volume", "part", "SELECT p_size % 10 AS x, arg_max(p_retailprice, p_partkey) AS v FROM part GROUP BY 1")(lambda df: df.groupBy((c("p_size") % 10).alias("x")).agg(F.max_by("p_retailprice", "p_partkey").alias("v")))
query("quantize", "orders", "SELECT o_orderkey, q, CASE WHEN q < 0 THEN -2 * q - 1 ELSE 2 * q END AS symbol FROM (SELECT o_orderkey, CAST(sign(o_totalprice - 150000) * floor(abs(o_totalprice - 150000) / 20000 + 0.5) AS BIGINT) AS q FROM orders)")(lambda df: df.select("o_orderkey", codec.quantize(c("o_totalprice") - 150000, 20000.0).alias("q")).withColumn("symbol", codec.zigzag(c("q"))))
RLE = "SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 200000) AS BIGINT) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders"
symbols = lambda df: df.select("o_custkey", "o_orderkey", F.floor(c("o_totalprice") / 200000).alias("s"))
query("rle_zero", "orders", f"SELECT o_custkey, o_orderkey, s, CAST(i - coalesce(lag(i) OVER (PARTITION BY o_custkey ORDER BY i), 0) - 1 AS BIGINT) AS zeros FROM ({RLE}) WHERE s <> 0")(lambda df: codec.zero_runs(symbols(df), "o_orderkey", "s", "o_custkey"))
query("rle_runs", "orders", f"SELECT o_custkey, min(o_orderkey) AS start, min(s) AS symbol, count(*) - 1 AS repeats FROM (SELECT *, i - row_number() OVER (PARTITION BY o_custkey, s ORDER BY i) AS g FROM ({RLE})) GROUP BY o_custkey, s, g")(lambda df: codec.runs(symbols(df), "o_orderkey", "s", "o_custkey"))


LEADER_SQL = """WITH RECURSIVE o AS (SELECT s_nationkey AS g, s_suppkey AS k, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
s(g, k, i, heads, leader) AS (SELECT g, k, i, [v], 0 FROM o WHERE i = 1 UNION ALL
  SELECT o.g, o.k, o.i, CASE WHEN len(list_filter(s.heads, lambda h: o.v >= h - 400 AND o.v <= h + 400)) > 0 THEN s.heads ELSE list_append(s.heads, o.v) END,
    CASE WHEN len(list_filter(s.heads, lambda h: o.v >= h - 400 AND o.v <= h + 400)) > 0 THEN list_position(s.heads, list_filter(s.heads, lambda h: o.v >= h - 400 AND o.v <= h + 400)[1]) - 1 ELSE len(s.heads) END
  FROM s JOIN o ON o.g = s.g AND o.i = s.i + 1)
SELECT k AS s_suppkey, CAST(leader AS BIGINT) AS leader FROM s"""
query("leader", "supplier", LEADER_SQL)(lambda df: stats.leader(df.select("s_suppkey", "s_acctbal", "s_nationkey"), ["s_acctbal"], "s_suppkey", 800.0, "s_nationkey"))
query("hierarchical", "supplier")(lambda df: ward_line(df, "s_acctbal", "s_suppkey", 4))


@query("tsne", "supplier")
def _(df):
    """The exact form up to some thousand rows, in one task; above, spread over leaves."""
    if df.count() <= 2000:
        return stats.on_all(df, ["s_acctbal", "s_nationkey"], "s_suppkey", lambda k, x: (lambda y: pd.DataFrame({"s_suppkey": k, "x": y[:, 0], "y": y[:, 1]}))(stats.tsne((x - x.mean(0)) / (x.std(0) + 1e-9), min(10, (len(x) - 1) / 3), 100)), "s_suppkey long, x double, y double")
    there = df.where(Space.there(["s_acctbal", "s_nationkey"]))
    b = there.agg(*[f(x) for x in ("s_acctbal", "s_nationkey") for f in (F.avg, F.stddev_pop)]).first()
    unit = df.select("s_suppkey", *[((c(x) - b[2 * n]) / (b[2 * n + 1] + 1e-9)).alias(x) for n, x in enumerate(("s_acctbal", "s_nationkey"))])
    places = there.select("s_acctbal", "s_nationkey").distinct().count()
    return embedding.tsne(unit, ["s_acctbal", "s_nationkey"], "s_suppkey", min(10, (places - 1) / 3), 100)


EVENT_AXIS = [("value", 0.0, 400.0, 16)]
query("stream_hist", None, f"SELECT {bin_sql(EVENT_AXIS)} AS bin, count(*) AS n FROM events GROUP BY 1")(lambda spark, d: streaming.run_available(spark, d, "events", EVENT_AXIS))


from . import registry_more, registry_whole  # noqa: E402, F401
