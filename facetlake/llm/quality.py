"""Quality rules with risk-controlled cutoffs.

Counts of each whole text give a base verdict and five measures.  For every stratum and measure the cutoffs of a grid
are tested in a fixed sequence, the loosest first, on labelled documents of good quality: a cutoff may be used only if
the exact binomial probability of seeing as few false rejections as were seen, were the true rate ``alpha`` split over
the measures, is at most ``delta`` split over strata x measures (Bonferroni), and so for all looser ones.  Within a
sequence nothing is split: the first cutoff of it that is unsafe in truth must pass its own test before any later one
counts.  A stricter cutoff rejects no fewer documents, so the strictest one that passes ends the sequence; none is used
if none passes.  So with probability 1 - delta, in every stratum at once, at most a share ``alpha`` of the good documents
that pass the base rules is rejected.  With 4 strata a stratum needs 1,495 good labelled documents for a first cutoff.

Defined results.  Null text: no words, base_failed.  Null stratum: a stratum of its own.  Null label: not good.
Several labels of a document: the best counts.  Repeated rows stay, each with the same verdict.  Without labels
every document that passes the base rules is kept.  Equal 64-bit hashes of two different five-word windows of one
text would count as a repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "[\x20\x09-\x0d]+"
WINDOW = 5
#: Measures, a larger one being worse, as integers; and the cutoffs tested for each.
MEASURES = {
    "symbols": ("n_symbols * 10000 div word_chars", (50, 100, 200, 300, 500, 700, 1000, 1500, 2000, 3000)),
    "dup_lines": ("n_dup_lines * 10000 div n_lines", (500, 1000, 1500, 2000, 2500, 3000, 4000, 5000, 6000, 8000)),
    "repeats": ("n_repeat_words * 10000 div n_words", (100, 200, 300, 500, 700, 900, 1100, 1300, 1600, 1900)),
    "long_words": ("word_chars * 100 div n_words", (550, 600, 650, 700, 750, 800, 900, 1000, 1200, 1500)),
    "short_words": ("0 - word_chars * 100 div n_words", (-500, -450, -400, -350, -300, -250, -200, -150, -120, -100)),
}
#: Strata up to this many are joined by broadcast: a row of five numbers each.
BROADCAST_STRATA = 10_000


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\x20\x09-\x0d]"))
    df = docs.withColumn("_w", F.filter(F.split(t, SPACE), lambda w: w != "")).withColumn("_l", lines).withColumn("n_symbols", F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long")).drop(text)
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    # windows of five words as hashes; only texts that repeat one sort them
    df = df.withColumn("_h", F.expr(f"if(n_words > {WINDOW}, transform(sequence(1, cast(n_words as int) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))), array())")).drop("_w")
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, i) -> struct(h, i))), cast(array() as array<struct<h:bigint,i:int>>))")).drop("_h")
    twice = "filter(transform(_s, (x, k) -> if((k > 0 and _s[greatest(k - 1, 0)].h = x.h) or (k < size(_s) - 1 and _s[least(k + 1, size(_s) - 1)].h = x.h), x.i, null)), p -> p is not null)"
    df = df.withColumn("_p", F.expr(f"sort_array({twice})")).drop("_s")
    covered = f"aggregate(sequence(1, size(_p) - 1), {WINDOW}L, (a, k) -> a + least({WINDOW}, _p[k] - _p[k - 1]))"
    return df.withColumn("n_repeat_words", F.expr(f"case when size(_p) = 0 then 0L when size(_p) = 1 then {WINDOW}L else {covered} end")).drop("_p")


def with_measures(df: DataFrame) -> DataFrame:
    """Adds base_failed and the measures (null where a text has no words)."""
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return df.withColumns({"base_failed": failed} | {f"m_{k}": F.expr(f"case when n_words > 0 then {e} end") for k, (e, _) in MEASURES.items()})


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly from log terms; 1 where k is the mean at least (over 1/2 in truth).

    Terms are taken in blocks, so memory grows with the root of k only.
    """
    block = 4096
    odds = F.log(F.lit(p)) - F.log(F.lit(1 - p))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("c"))

    def add(s: Column, j: Column) -> Column:
        t = s["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (s["c"] + F.exp(t)).alias("c"))

    one, size = F.lit(1).cast("long"), F.lit(block).cast("long")
    inner = lambda s, i: F.aggregate(F.sequence(i * size + one, F.least((i + one) * size, k)), s, add)
    starts = F.when(k > 0, F.sequence(F.lit(0).cast("long"), F.floor((k - one) / size))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(starts, start, inner, lambda s: s["c"]))


def cutoffs(scored: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per stratum (column ``stratum_key``) with a cutoff per measure, null where none is safe."""
    good = labels.groupBy(F.col(key).alias("_k")).agg(F.max("quality").alias("_q")).where("_q = 1")
    held = scored.where("not base_failed").join(good, F.col(key) == F.col("_k")).withColumn("stratum_key", stratum_key(stratum))
    over = [F.count(F.when(F.col(f"m_{m}") > c, 1)).alias(f"{m}|{c}") for m, (_, grid) in MEASURES.items() for c in grid]
    table = held.groupBy("stratum_key").agg(F.count(F.lit(1)).alias("n"), *over)
    cells = ", ".join(f"'{m}', {c}, `{m}|{c}`" for m, (_, grid) in MEASURES.items() for c in grid)
    tests = sum(len(grid) for _, grid in MEASURES.values())
    long = table.withColumn("strata", F.count(F.lit(1)).over(all_rows())).select("stratum_key", "n", "strata", F.expr(f"stack({tests}, {cells}) as (measure, cutoff, k)"))
    safe = long.where(binomial_cdf(F.col("k"), F.col("n"), alpha / len(MEASURES)) <= delta / (F.col("strata") * len(MEASURES)))
    return safe.groupBy("stratum_key").agg(*[F.min(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"c_{m}") for m in MEASURES])


def all_rows():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def stratum_key(stratum: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null"))


def decide(scored: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``kept`` and ``failed`` (the measures over their cutoff, comma-joined); ``chosen`` is a written table."""
    few = chosen.count() <= BROADCAST_STRATA
    df = scored.withColumn("stratum_key", stratum_key(stratum)).join(F.broadcast(chosen) if few else chosen, "stratum_key", "left").drop("stratum_key")
    over = F.array_compact(F.array(*[F.when(F.col(f"m_{m}") > F.col(f"c_{m}"), F.lit(m)) for m in MEASURES]))
    df = df.withColumn("failed", F.array_join(over, ","))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == "")).drop(*[f"c_{m}" for m in MEASURES])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """key, stratum, counts, measures, base_failed, failed, kept for every row.  Texts are read once."""
    own = docs.select(F.col(key), F.col(stratum), F.col(text))
    scored = common.as_table(docs.sparkSession, with_measures(counts(own, text)), "quality")
    chosen = common.as_table(docs.sparkSession, cutoffs(scored, labels, key, stratum, alpha, delta), "quality-cutoffs")
    return decide(scored, chosen, stratum)


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Texts are neither shuffled nor written: they are measured once for the cutoffs and again as the result is read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key_own"), F.col(stratum).alias("stratum_own"), F.col(text).alias("text_own"))
    with common.Scratch(spark) as scratch:
        scored = scratch.table(with_measures(counts(own, "text_own")).withColumnRenamed("key_own", key), "quality")
        chosen = common.as_table(spark, cutoffs(scored, labels, key, "stratum_own", alpha, delta), "quality-cutoffs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(stratum).alias("stratum_own"), F.col(text).alias("text_own"))
    # numbered, so that the verdict stays above the measures: pushed below, each of its parts would compute them again
    measured = with_measures(counts(rows, "text_own")).withColumn("number_own", F.monotonically_increasing_id())
    return decide(measured, chosen, "stratum_own").where("kept and number_own >= 0").select("_row.*")


def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = judge(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def _oracle(alpha: float = 0.02, delta: float = 0.05) -> str:
    sql = {m: e.replace(" div ", " // ") for m, (e, _) in MEASURES.items()}
    sql["short_words"] = "0 - word_chars * 100 // n_words"
    grid = ", ".join(f"('{m}', {c})" for m, (_, cuts) in MEASURES.items() for c in cuts)
    a = alpha / len(MEASURES)
    value = "CASE measure " + " ".join(f"WHEN '{m}' THEN m_{m}" for m in MEASURES) + " END"
    failed = ", ".join(f"CASE WHEN m_{m} > c_{m} THEN '{m}' END" for m in MEASURES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g),
q AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r WHERE c > 1),
rep AS (SELECT rid, CAST(sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS BIGINT) AS n FROM q GROUP BY rid),
f AS (SELECT rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce('=' || lang, 'null') AS sk,
             {", ".join(f"CASE WHEN n_words > 0 THEN {e} END AS m_{k}" for k, e in sql.items())} FROM f),
good AS (SELECT doc_id AS k FROM labels GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT m.* FROM m JOIN good ON m.doc_id = good.k WHERE NOT base_failed),
grid(measure, cutoff) AS (VALUES {grid}),
cell AS (SELECT sk, measure, cutoff, count(*) AS n, count(CASE WHEN {value} > cutoff THEN 1 END) AS k FROM held, grid GROUP BY sk, measure, cutoff),
safe AS (SELECT * FROM cell WHERE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a!r}) + (n - j) * ln({1 - a!r}))))
         <= {delta!r} / ((SELECT count(DISTINCT sk) FROM held) * {len(MEASURES)})),
c AS (SELECT sk, {", ".join(f"min(CASE WHEN measure = '{m}' THEN cutoff END) AS c_{m}" for m in MEASURES)} FROM safe GROUP BY sk),
v AS (SELECT m.*, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed FROM m LEFT JOIN c USING (sk))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM v
"""


ORACLE = _oracle()
