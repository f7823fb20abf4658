"""URL filtering against dated lists: an as-of join of captures and list entries.

Entries (list, kind, pattern, action, at) become validity intervals [at, next change) per list and pattern.  A
capture is looked up under its host, the host's parent domains and its path prefixes, and meets the intervals
that hold its fetch time; it is blocked if a block list has an entry active then and no allow list has one.

Both sides carry a time bucket, so a capture meets the few changes of one bucket, not a pattern's whole past, and
a salt, so that one host with a third of all captures is dealt over ``salts`` tasks (the list side, which is the
small one, is repeated).  No side is broadcast by hand.

Defined results.  Null url or time, or a url without a host: never blocked, no entries.  Null fields of an entry:
it is ignored.  Several actions at one time: add wins.  Repeated captures: a row each.  Empty tables: no rows, or
nothing blocked.  Times far outside share the edge buckets.  Captures keep their other columns, but for host, n_active,
blocked, reason and names with a leading underscore, which are replaced; entries' other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKET = 30 * 86400
SALTS = 16
#: Buckets that an open entry is repeated in at most.
MOST_BUCKETS = 512
OPEN_END = 1 << 53


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)


def path_of(url: Column) -> Column:
    """Path segments, as in the url."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """list, verdict, kind, pattern, valid_from, valid_to: the times at which an entry is active."""
    e = entries.select("list", "verdict", "kind", "pattern", "action", "at").dropna().distinct()
    key = ["list", "verdict", "kind", "pattern"]
    e = e.groupBy(*key, "at").agg(F.max(F.col("action") == "add").alias("on"))
    w = Window.partitionBy(*key).orderBy("at")
    e = e.withColumn("was", F.lag("on").over(w)).where("was is null or was <> on")
    e = e.withColumn("valid_to", F.coalesce(F.lead("at").over(w), F.lit(OPEN_END)))
    return e.where("on").select(*key, F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with host, n_active, blocked and reason (first active block entry)."""
    spark = captures.sparkSession
    # the middle of the fetch times is cut into buckets; what lies outside falls into the first and last one
    span = captures.agg(F.percentile_approx(at, [0.01, 0.99]).alias("p")).first()["p"] or [0, 0]
    top = max(0, min(MOST_BUCKETS - 1, int((span[1] - span[0]) // BUCKET)))
    width = max(BUCKET, (span[1] - span[0]) / MOST_BUCKETS)
    bucket_of = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.floor((t.cast("double") - span[0]) / width))).cast("int")
    live = intervals(entries)
    deepest = live.where("kind = 'prefix'").agg(F.coalesce(F.max(F.size(F.split("pattern", "/"))), F.lit(0)).alias("n")).first()["n"]
    live = live.withColumn("bucket", F.explode(F.sequence(bucket_of(F.col("valid_from")), bucket_of(F.col("valid_to") - 1))))
    live = live.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    c = captures.drop("host", "n_active", "blocked", "reason", "_row", "_at", "_n", "_ok", "_reason").withColumn("host", host_of(F.col(url)))
    # written, so that both uses below see the same numbers even if tasks are run again
    c = common.as_table(spark, c.withColumn("_row", F.monotonically_increasing_id()), "url-captures")
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    parts = F.slice(path_of(F.col(url)), 1, max(deepest, 1))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.col("host"), F.array_join(F.slice(parts, 1, i), "/")).alias("pattern")))
    some = F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))
    keys = c.where((F.col("host") != "") & F.col(at).isNotNull()).select("_row", F.col(at).alias("_at"), F.explode(F.concat(domains, some)).alias("k"))
    keys = keys.select("_row", "_at", "k.kind", "k.pattern", bucket_of(F.col("_at")).alias("bucket"), F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int").alias("salt"))
    met = keys.join(live, ["kind", "pattern", "bucket", "salt"]).where("valid_from <= _at and _at < valid_to")
    reason = F.when(F.col("verdict") == "block", F.concat_ws("|", "list", "kind", "pattern"))
    found = met.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), F.min(reason).alias("_reason"), F.max(F.col("verdict") == "allow").alias("_ok"))
    out = c.join(found, "_row", "left")
    blocked = F.coalesce(F.col("_reason").isNotNull() & ~F.col("_ok"), F.lit(False))
    return out.withColumn("n_active", F.coalesce("_n", F.lit(0)).cast("long")).withColumn("blocked", blocked).withColumn("reason", F.when(blocked, F.col("_reason"))).drop("_row", "_n", "_ok", "_reason")


def synthetic_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of the synthetic pages, by the bytes of the host's MD5.

    Half of the hosts are on a block list for some days, a part of these twice; a few are allowed for good; first
    path segments of other hosts are listed as prefixes.  Days count from 2024-01-01.
    """
    h = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1).alias("seg")).where("host <> ''").distinct()
    b = lambda n: F.conv(F.substring(F.md5("host"), 2 * n - 1, 2), 16, 10).cast("long")
    day = lambda d: F.lit(1704067200) + d * 86400
    hosts = h.select("host").distinct().withColumns({f"b{n}": b(n) for n in range(1, 6)})
    row = lambda lst, verdict, kind, pattern, action, at: F.struct(F.lit(lst).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), at.alias("at"))
    c = F.col
    on = day(c("b2"))
    off = day(c("b2") + 1 + c("b3") % 90)
    again = day(c("b2") + 100 + c("b4") % 60)
    listed = hosts.where("b1 < 128").select(F.explode(F.array(row("abuse", "block", "domain", c("host"), "add", on), row("abuse", "block", "domain", c("host"), "remove", off))).alias("e"))
    twice = hosts.where("b1 < 64").select(row("abuse", "block", "domain", c("host"), "add", again).alias("e"))
    allowed = hosts.where("b5 < 32").select(row("trusted", "allow", "domain", c("host"), "add", day(F.lit(0))).alias("e"))
    segs = h.where("seg <> ''").withColumn("b1", b(1)).withColumn("b2", b(2)).where("b1 >= 128")
    prefixes = segs.select(row("paths", "block", "prefix", F.concat_ws("/", "host", "seg"), "add", day(c("b2"))).alias("e"))
    return listed.unionAll(twice).unionAll(allowed).unionAll(prefixes).select("e.*")


def op1_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_at", F.expr("1704067200 + pmod(page_id * 7919, 31536000)"))
    return judge(pages, common.as_table(spark, synthetic_entries(pages), "url-lists")).drop("url")


ORACLE = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, url, 1704067200 + ((page_id * 7919) % 31536000 + 31536000) % 31536000 AS fetched_at,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') AS parts,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg
  FROM pages),
b AS (SELECT host, seg, CAST('0x' || substr(md5(host), 1, 2) AS BIGINT) AS b1, CAST('0x' || substr(md5(host), 3, 2) AS BIGINT) AS b2, CAST('0x' || substr(md5(host), 5, 2) AS BIGINT) AS b3,
             CAST('0x' || substr(md5(host), 7, 2) AS BIGINT) AS b4, CAST('0x' || substr(md5(host), 9, 2) AS BIGINT) AS b5
      FROM (SELECT DISTINCT host, seg FROM p WHERE host <> '')),
h AS (SELECT DISTINCT host, b1, b2, b3, b4, b5 FROM b),
e AS (
  SELECT 'abuse' AS list, 'block' AS verdict, 'domain' AS kind, host AS pattern, true AS on_, 1704067200 + b2 * 86400 AS ts FROM h WHERE b1 < 128
  UNION SELECT 'abuse', 'block', 'domain', host, false, 1704067200 + (b2 + 1 + b3 % 90) * 86400 FROM h WHERE b1 < 128
  UNION SELECT 'abuse', 'block', 'domain', host, true, 1704067200 + (b2 + 100 + b4 % 60) * 86400 FROM h WHERE b1 < 64
  UNION SELECT 'trusted', 'allow', 'domain', host, true, 1704067200 FROM h WHERE b5 < 32
  UNION SELECT 'paths', 'block', 'prefix', host || '/' || seg, true, 1704067200 + b2 * 86400 FROM b WHERE b1 >= 128 AND seg <> ''),
m AS (SELECT list, verdict, kind, pattern, ts, max(on_) AS on_ FROM e GROUP BY list, verdict, kind, pattern, ts),
k AS (SELECT * FROM (SELECT *, lag(on_) OVER (PARTITION BY list, verdict, kind, pattern ORDER BY ts) AS was FROM m) WHERE was IS NULL OR was <> on_),
iv AS (SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY list, verdict, kind, pattern ORDER BY ts) AS till FROM k) WHERE on_),
keys AS (
  SELECT rid, fetched_at, 'domain' AS kind, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS pattern FROM p WHERE host <> ''
  UNION ALL SELECT rid, fetched_at, 'prefix', unnest(list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/'))) FROM p WHERE host <> ''),
f AS (SELECT rid, count(*) AS n, min(CASE WHEN verdict = 'block' THEN list || '|' || iv.kind || '|' || iv.pattern END) AS reason, max(verdict = 'allow') AS ok
      FROM keys JOIN iv ON keys.kind = iv.kind AND keys.pattern = iv.pattern AND ts <= fetched_at AND (till IS NULL OR fetched_at < till) GROUP BY rid)
SELECT page_id, fetched_at, coalesce(host, '') AS host, coalesce(n, 0) AS n_active, coalesce(reason IS NOT NULL AND NOT ok, false) AS blocked,
       CASE WHEN coalesce(reason IS NOT NULL AND NOT ok, false) THEN reason END AS reason
FROM p LEFT JOIN f USING (rid)
"""
