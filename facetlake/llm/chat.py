"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut each conversation into turn-aligned spans: a window holds the system turn (the
first turn, if its role is ``system``), the last turns before the span as far as ``history`` tokens allow, and as
many new turns as the budget takes, one at least.  History that would leave no room for the first new turn is
left out.  Only assistant turns that are new in a window are under its loss mask, so every target counts once.

A turn is ``<s>[ROLE]``, role, ``[/ROLE]``, text, ``</s>`` with line feeds between.  A control string inside a role
or text gets one more backslash in front than it has; a real mark always follows a line feed or starts a turn, so
the escape is reversible.

Defined results.  Null role or text: empty.  Null turn: before the others.  Equal turn numbers: by role, then text.
Null conv_id: one conversation.  Repeated rows: turns of their own.  An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CONTROL = r"</?s>|\[/?(?:INST|SYS|ROLE)\]"
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"
#: Tokens of a turn's own marks.
MARKS = 6
OPEN, MID, CLOSE = "<s>[ROLE]\n", "\n[/ROLE]\n", "\n</s>"


def escape(c):
    return F.regexp_replace(c, rf"(?<!\\)(\\*+)({CONTROL})", r"\\$1$2")


def unescape(c):
    return F.regexp_replace(c, rf"(?<!\\)\\(\\*+)({CONTROL})", "$1$2")


def windows(conversations: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """conv_id, window, text, loss (spans of code points), n_repeated (leading turns seen before)."""
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKS)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID), escape(F.col("text")), F.lit(CLOSE))
    t = t.select("conv_id", F.row_number().over(w).alias("i"), (F.sum("tokens").over(w) - F.col("tokens")).alias("b"), "tokens", "role", piece.alias("piece"), F.length(escape(F.col("text"))).alias("n"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "b", "tokens", "role", "piece", "n"))).alias("t"))
    c = c.withColumn("i0", F.expr("if(t[0].role = 'system', 1, 0)")).withColumn("s0", F.expr("if(i0 = 1, t[0].tokens, 0L)"))
    c = c.withColumn("p", F.expr("slice(transform(t, x -> x.b), i0 + 1, size(t))"))  # prefix sums of the body
    # a new window opens at the first turn that the open one has no room for
    kept = f"x.b - array_min(filter(p, q -> q >= x.b - {history}))"
    opened = f"struct(concat(a.starts, array(struct(x.i as i, if(s0 + {kept} + x.tokens <= {budget}, {kept}, 0L) as h))) as starts, x.b as b, if(s0 + {kept} + x.tokens <= {budget}, {kept}, 0L) as h)"
    start = "struct(array(struct(i0 + 1 as i, 0L as h)) as starts, coalesce(get(p, 0), 0L) as b, 0L as h)"
    fold = f"aggregate(slice(t, i0 + 2, size(t)), {start}, (a, x) -> if(s0 + a.h + x.b + x.tokens - a.b <= {budget}, a, {opened}))"
    c = c.withColumn("starts", F.expr(f"{fold}.starts")).drop("p")
    new = "slice(t, s.i, greatest(coalesce(get(starts, k + 1).i, size(t) + 1) - s.i, 0))"
    past = "if(s.h > 0, filter(slice(t, i0 + 1, s.i - 1 - i0), x -> x.b >= get(t, s.i - 1).b - s.h), filter(t, x -> false))"
    # the system turn is new in the first window
    body = f"transform(starts, (s, k) -> struct(k as window, concat(slice(t, 1, i0), {past}, {new}) as turns, if(k = 0, 0, i0 + size({past})) as n_repeated))"
    rows = c.withColumn("w", F.explode(F.expr(body))).select("conv_id", "w.*")
    where = f"aggregate(slice(turns, 1, k), 0, (a, y) -> a + length(y.piece)) + length(x.piece) - x.n - {len(CLOSE)}"
    rows = rows.withColumn("loss", F.expr(f"filter(transform(turns, (x, k) -> if(x.role = 'assistant' and k >= n_repeated, struct({where} as start, x.n as length), null)), y -> y is not null)"))
    return rows.select("conv_id", F.col("window").cast("long").alias("window"), F.expr("array_join(transform(turns, x -> x.piece), '')").alias("text"), "loss", "n_repeated")


def parse(formatted: DataFrame) -> DataFrame:
    """Windows with ``turns`` (role and text, unescaped) and ``targets`` (texts under the loss mask, unescaped)."""
    pieces = F.expr("slice(_p, 1, size(_p) - 1)")
    halves = lambda x: F.split(F.substring(x, len(OPEN) + 1, 1 << 30), r"\n\[/ROLE\]\n", 2)
    df = formatted.withColumn("_p", F.split("text", CLOSE, -1)).withColumn("_h", F.transform(pieces, halves))
    df = df.withColumn("turns", F.transform("_h", lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text"))))
    return df.withColumn("targets", F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"])))).drop("_p", "_h")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation of what its windows say."""
    p = parse(formatted).select("conv_id", F.struct("window", F.expr("slice(turns, n_repeated + 1, size(turns))").alias("turns"), "targets", F.length("text").cast("long").alias("chars")).alias("w"))
    c = p.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    c = c.select("conv_id", F.expr("flatten(transform(w, x -> x.turns))").alias("turns"), F.expr("array_join(flatten(transform(w, x -> x.targets)), '')").alias("loss"), F.expr("aggregate(w, 0L, (a, x) -> a + x.chars)").alias("formatted_chars"))
    said = F.expr("array_join(transform(turns, x -> concat(x.role, '\n', x.text, '\n')), '')")
    return c.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op6_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    given = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(common.as_table(spark, windows(given), "chat"))


def _oracle(budget: int = 512, history: int = 128) -> str:
    fixed = len(OPEN) + len(MID) + len(CLOSE)
    return rf"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]')) + {MARKS} AS tokens,
             length(text) + len(regexp_extract_all(text, '{CONTROL}')) + length(role) + len(regexp_extract_all(role, '{CONTROL}')) + {fixed} AS chars FROM x),
c AS (SELECT conv_id, CASE WHEN list(role ORDER BY turn, role, text)[1] = 'system' THEN 1 ELSE 0 END AS i0, count(*) AS n,
             list(tokens ORDER BY turn, role, text) AS ts, list(chars ORDER BY turn, role, text) AS cs FROM e GROUP BY conv_id),
d AS (SELECT *, CASE WHEN i0 = 1 THEN ts[1] ELSE 0 END AS s0, list_transform(range(0, n), lambda i: coalesce(list_sum(ts[1:i]), 0)) AS bs FROM c),
r(conv_id, w, s, h) AS (
  SELECT conv_id, 0, CAST(i0 AS BIGINT), CAST(0 AS BIGINT) FROM d
  UNION ALL
  SELECT conv_id, w + 1, nx, CASE WHEN s0 + past + ts[nx + 1] <= {budget} THEN past ELSE 0 END FROM (
    SELECT *, CAST(bs[nx + 1] - list_min(list_filter(bs[i0 + 1:], lambda q: q >= bs[nx + 1] - {history})) AS BIGINT) AS past FROM (
      SELECT r.conv_id, r.w, d.*exclude(conv_id), list_min(list_filter(range(r.s + 1, d.n), lambda i: d.s0 + r.h + d.bs[i + 1] + d.ts[i + 1] - d.bs[r.s + 1] > {budget})) AS nx
      FROM r JOIN d ON r.conv_id = d.conv_id) WHERE nx IS NOT NULL)),
extra AS (SELECT r.conv_id, sum(CASE WHEN w = 0 THEN 0 ELSE CASE WHEN i0 = 1 THEN cs[1] ELSE 0 END
            + coalesce(list_sum(list_transform(range(i0, s), lambda i: CASE WHEN h > 0 AND bs[i + 1] >= bs[s + 1] - h THEN cs[i + 1] ELSE 0 END)), 0) END) AS chars
          FROM r JOIN d ON r.conv_id = d.conv_id GROUP BY r.conv_id)
SELECT e.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(e.chars) + max(extra.chars) AS BIGINT) AS formatted_chars
FROM e JOIN extra ON e.conv_id = extra.conv_id GROUP BY e.conv_id
"""


ORACLE = _oracle()
