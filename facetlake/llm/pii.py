"""Personal data: rule spans that stay, and candidates that gradient-boosted trees add to them.

Loose generators propose overlapping spans.  Trees are boosted on format and context features to tell

* positive examples: rule hits in a form that the rule itself misses (a phone number without its plus sign, a card
  number with dots, an address with ``[at]``), in the context of the hit, from
* negative ones: candidates that touch no rule hit of their kind and cannot be of it (checksum, number of digits, parts).

Neither sort may be added.  The candidates that may are those that touch no rule hit and would be valid in the rule's
form; they carry no label and are not trained on.  On a held-out fold each kind gets the lowest score threshold at
which at most a share ``risk`` of its negatives passes, with exact binomial confidence 1 - ``delta`` over all kinds and
thresholds tested; a kind without one adds nothing (about 150 held-out negatives are needed).  So the stated bound is on
candidates that are certainly wrong, all of which are free ones.  Added spans never overlap a rule's span or a better
added one.  Addresses of machines have no loose form that could be valid, so that kind adds nothing.

All of it is SQL expressions on one row per document: texts are neither moved nor split, and the fitted trees
become CASE expressions.  Training uses at most about ``max_examples`` labelled candidates, chosen by hash.

Defined results.  Null or empty text: no spans.  Null or repeated ids: each row by itself.  An empty table, or one
without both sorts of examples: rule spans only.  Positions count code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import binomial_cdf

KINDS = ("email", "ip", "card", "phone")
#: The rules' patterns, with possessive repeats and a look behind so that long runs take linear time.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser ones, for candidates.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"[0-9](?:[\x20.-]?[0-9])++",
    "phone": r"[+(]?[0-9][\x20().0-9-]+[0-9]",
}
CUES = {"email": "mail|contact|write|@", "ip": "ip|addr|host|server", "card": "card|visa|credit|carte|karte|tarjeta", "phone": "tel|phone|call|fax|mobil"}
FEATURES = ("kind", "chars", "digits", "letters", "seps", "groups", "longest", "touch_left", "touch_right", "cue", "other_cue", "quoted")
SCORES = tuple(x / 10 for x in range(-10, 16))


def found(t: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (s, e, m), code points."""
    hits, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    pairs = F.arrays_zip(F.transform(gaps, F.length).alias("g"), hits.alias("m"))
    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("o"))

    def step(a: Column, x: Column) -> Column:
        s = a["p"] + x["g"]
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(e.alias("p"), F.when(x["m"].isNull(), a["o"]).otherwise(F.concat(a["o"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))))).alias("o"))

    return F.aggregate(pairs, zero, step, lambda a: a["o"])


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    d = digits_of(m)
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5]|)(?:\.|$)){4}$") & ~m.rlike(r"(?:^|\.)(?:\.|$)")
    if kind == "card":
        return F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def features(t: Column, kind: str, x: Column) -> list[Column]:
    m, d = x["m"], digits_of(x["m"])
    left = F.lower(F.substr(t, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))))
    before, after = F.when(x["s"] > 0, F.substr(t, F.greatest(x["s"], F.lit(1)), F.lit(1))).otherwise(""), F.substr(t, x["e"] + 1, F.lit(1))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    letters = F.regexp_replace(m, "[^A-Za-z]", "")
    others = "|".join(c for k, c in CUES.items() if k != kind) + "|token|key|id"
    flag = lambda c: c.cast("int")
    values = [
        F.lit(KINDS.index(kind)), F.length(m), F.length(d), F.length(letters), F.length(m) - F.length(d) - F.length(letters), F.size(groups),
        F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.length(g))), flag(before.rlike("[A-Za-z0-9_]")), flag(after.rlike("[A-Za-z0-9_]")),
        flag(left.rlike(CUES[kind])), flag(left.rlike(others)), flag(before.rlike("[\"'=]")),
    ]
    return [v.cast("double").alias(n) for n, v in zip(FEATURES, values)]


def loosened(kind: str, m: Column) -> Column:
    """A rule hit in a form that the rule misses; null where there is none."""
    if kind == "email":
        return F.regexp_replace(m, "@", " [at] ")
    if kind == "card":
        return F.regexp_replace(digits_of(m), "(.{4})(?=.)", "$1.")
    return F.expr("cast(null as string)") if kind == "ip" else F.substr(m, F.lit(2))


def possible(kind: str, m: Column) -> Column:
    """Whether a loose match would be valid in the rule's form."""
    if kind == "email":
        return m.rlike(r"\.[A-Za-z0-9-]++$")
    return F.lit(False) if kind == "ip" else valid(kind, m)


#: What a candidate is to the trees.
FREE, POSITIVE, NEGATIVE = 0, 1, 2


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``base`` (s, o, e) and ``cands`` (o, s, e, sort, touch, features)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_t", t).withColumn("_has", F.col("_t").rlike("[0-9@]|[(\\[]at[)\\]]")).drop(text)
    T = F.col("_t")

    def hits(kind: str) -> Column:
        return F.transform(F.filter(found(T, RULES[kind]), lambda x: valid(kind, x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("o"), x["e"].alias("e"), x["m"].alias("m")))

    none = F.array().cast("array<struct<s:int,o:int,e:int,m:string>>")
    df = df.withColumn("_hits", F.when(F.col("_has"), F.concat(*[hits(k) for k in KINDS])).otherwise(none))
    df = df.withColumn("base", F.transform("_hits", lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"))))
    B = F.col("base")

    def example(kind: str, x: Column, m: Column, sort: Column, touch: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("o"), x["s"].alias("s"), x["e"].alias("e"), sort.alias("sort"), touch.alias("touch"), *features(T, kind, F.struct(x["s"].alias("s"), x["e"].alias("e"), m.alias("m"))))

    def cands(kind: str) -> Column:
        o = KINDS.index(kind)
        least = {"email": 0, "ip": 0, "card": 12, "phone": 7}[kind]
        loose = F.filter(found(T, LOOSE[kind]), lambda x: F.length(digits_of(x["m"])) >= least)
        free = F.filter(loose, lambda x: ~F.exists(B, lambda b: (b["o"] == o) & (b["s"] < x["e"]) & (x["s"] < b["e"])))
        touch = lambda x: F.exists(B, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        own = F.transform(free, lambda x: example(kind, x, x["m"], F.when(possible(kind, x["m"]), FREE).otherwise(NEGATIVE), touch(x)))
        if kind == "ip":
            return own
        made = F.transform(F.filter("_hits", lambda x: x["o"] == o), lambda x: example(kind, x, loosened(kind, x["m"]), F.lit(POSITIVE), F.lit(True)))
        return F.concat(own, made)

    kind = "array<struct<o:int,s:int,e:int,sort:int,touch:boolean," + ",".join(f"{n}:double" for n in FEATURES) + ">>"
    df = df.withColumn("cands", F.when(F.col("_has"), F.concat(*[cands(k) for k in KINDS])).otherwise(F.array().cast(kind)))
    return df.drop("_t", "_has", "_hits")


def tree_column(node, get) -> Column:
    """A fitted tree as a CASE expression; get(i) is feature i."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    s = node.split()
    return F.when(get(s.featureIndex()) <= float(s.threshold()), tree_column(node.leftChild(), get)).otherwise(tree_column(node.rightChild(), get))


def fit(scanned: DataFrame, max_examples: int = 20_000, trees: int = 12, depth: int = 3, risk: float = 0.05, delta: float = 0.05):
    """(score of a candidate, threshold of each kind), or None where there is nothing to learn."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = scanned.sparkSession
    rows = scanned.select(F.explode("cands").alias("c")).select("c.*").where(F.col("sort") != FREE)
    rows = rows.withColumn("label", (F.col("sort") == POSITIVE).cast("double"))
    per = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(per) < 2:
        return None
    total = sum(per.values())
    # equal candidates fall together, so no example is in both folds
    place = F.pmod(F.xxhash64(*FEATURES, "s", "e"), F.lit(1 << 20)) / (1 << 20)
    rows = rows.withColumn("place", place)
    share = min(1.0, max_examples / total)
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.where(F.col("place") < 0.5 * share)).select("features", "label")
    train = common.as_table(spark, train.repartition(2), "pii-train")
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False).fit(train)
    parts = list(zip(model.treeWeights, model.trees))

    def score(c: Column) -> Column:
        total = F.lit(0.0)
        for w, tree in parts:
            total = total + F.lit(float(w)) * tree_column(tree._java_obj.rootNode(), lambda i: c[FEATURES[i]])
        return total

    # negatives that pass each threshold
    held = rows.where((F.col("place") >= 0.5) & (F.col("sort") == NEGATIVE)).withColumn("score", score(F.struct(*FEATURES)))
    over = [F.count(F.when(F.col("score") >= g, 1)).alias(f"k{n}") for n, g in enumerate(SCORES)]
    cells = ", ".join(f"{g}D, k{n}" for n, g in enumerate(SCORES))
    table = held.groupBy("o").agg(F.count(F.lit(1)).alias("n"), *over).select("o", "n", F.expr(f"stack({len(SCORES)}, {cells}) as (g, k)"))
    safe = table.where(binomial_cdf(F.col("k"), F.col("n"), risk) <= delta / (len(SCORES) * len(KINDS)))
    cuts = {r["o"]: r["g"] for r in safe.groupBy("o").agg(F.min("g").alias("g")).collect()}  # a row per kind at most
    return (score, cuts) if cuts else None


def select(scanned: DataFrame, model) -> DataFrame:
    """``scanned`` with ``spans``: rule spans and the candidates that the model adds, by (s, o)."""
    if model is None:
        return scanned.withColumn("spans", F.sort_array("base")).drop("cands")
    score, cuts = model
    limit = lambda c: F.coalesce(*[F.when(c["o"] == o, F.lit(float(g))) for o, g in cuts.items()], F.lit(1e9))
    free = F.filter("cands", lambda c: (c["sort"] == FREE) & ~c["touch"])
    scored = F.transform(free, lambda c: F.struct(score(c).alias("v"), c["o"].alias("o"), c["s"].alias("s"), c["e"].alias("e")))
    df = scanned.withColumn("_c", F.filter(scored, lambda c: c["v"] >= limit(c))).drop("cands")

    def worse(c: Column, d: Column) -> Column:
        better = (d["v"] > c["v"]) | (d["v"] == c["v"]) & ((d["s"] < c["s"]) | (d["s"] == c["s"]) & ((d["e"] > c["e"]) | (d["e"] == c["e"]) & (d["o"] < c["o"])))
        return (d["s"] < c["e"]) & (c["s"] < d["e"]) & better

    best = F.filter("_c", lambda c: ~F.exists("_c", lambda d: worse(c, d)))
    added = F.transform(best, lambda c: F.struct(c["s"].alias("s"), c["o"].alias("o"), c["e"].alias("e")))
    return df.withColumn("spans", F.sort_array(F.concat("base", added))).drop("_c")


def detect(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` without its text, with ``base`` and ``spans``: arrays of (s, o, e), o being the place in KINDS."""
    scanned = common.as_table(docs.sparkSession, scan(docs, text), "pii-candidates")
    return select(scanned, fit(scanned, **limits)).withColumn("base", F.sort_array("base"))


def joined(spans: str) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["o"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: str = "spans") -> Column:
    """The text with ``[KIND]`` for each span; a span inside an earlier one goes with it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("p"), F.lit("").alias("o"))

    def step(a: Column, x: Column) -> Column:
        gap = F.concat(a["o"], F.substr(text, a["p"] + 1, F.greatest(x["s"] - a["p"], F.lit(0))), F.element_at(names, x["o"] + 1))
        out = F.when(x["s"] >= a["p"], gap).otherwise(a["o"])
        return F.struct(F.greatest(a["p"], x["e"]).alias("p"), out.alias("o"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["o"], F.substr(text, a["p"] + 1, F.lit(1 << 30))))


def redacted(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` with its spans redacted; a column n_chars follows the new text.

    Texts are scanned once for the trees and again as the result is read, so they are not written in between.
    """
    with common.Scratch(docs.sparkSession) as scratch:
        model = fit(scratch.table(scan(docs.select(F.col(text).alias("_text")), "_text").select("cands"), "pii-candidates"), **limits)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    rows = select(scan(own, "_text"), model)
    new = F.when(F.size("spans") > 0, redact(F.col(f"_row.`{text}`"))).otherwise(F.col(f"_row.`{text}`"))
    out = rows.select(*[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    size = lambda c: F.length(text).cast(docs.schema[c].dataType).alias(c)
    return out.select(*[size(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def op9_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["o"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
