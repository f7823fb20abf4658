"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

An indexed word of length L is cut in two even segments; one edit leaves one of them whole, so a word of equal length, or
one longer, that is one edit away holds a segment at its own place, or shifted by the difference of the lengths.  Indexed
words and probing ones therefore meet on (L, segment, place).  A segment that very many words share would give all pairs of
its group; there the other half is cut in two in turn (one edit leaves one of these whole as well), and so on until groups
are small or the window in which two words may differ is a single place, whose groups the alphabet bounds.  Every pair that
meets is verified to be one edit apart, in the window only as all else is equal, and is taken from one window alone: the one
in which the words first differ.

Words are counted over all documents, once per Python worker and partition before the shuffle.  Words are in no task's
memory beyond ``held`` of them; chains of forms are followed by pointer doubling over written tables.

Defined results.  A null or empty text has no word.  A null id counts as an empty one.  Repeated ids and rows count each
time.  Ties go to the smallest word in code-point order.  Extra columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Latin-1 bytes: A-Z become a-z, the letters from U+00C0 on stay, all else (also what Latin-1 lacks, as "?") is a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def worn(run: str, h: int) -> str:
    """The run without one code point if 31 divides its hash: the form in which it counts."""
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = 7, held: int = 150_000) -> DataFrame:
    """word, n: words of at least ``shortest`` code points, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
            sums.clear()
            return made

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py()
                if not t:
                    continue
                k = k.as_py()
                before = zlib.crc32(f"{'' if k is None else k}:".encode())
                for raw, n in Counter(w for w in t.encode("latin-1", "replace").translate(FOLD).split(b" ") if len(w) >= shortest).items():
                    word = raw.decode("latin-1")
                    word = worn(word, zlib.crc32(raw if raw.isascii() else word.encode(), before))
                    if len(word) >= shortest:
                        sums[word] += n
                if len(sums) >= held:
                    yield out()
        if sums:
            yield out()

    return docs.select(key, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, more, lo, hi) with their windows cut in two, and the key that is left outside the window.

    ``more`` is 0 for indexed words, 1 for words that probe for indexed ones a code point shorter; lo and hi are places of
    the indexed word.
    """
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi")))
    cut = rows.withColumn("w", half).select("word", "n", "more", "w.lo", "w.hi")
    key = F.expr("concat(substring(word, 1, lo), '|', substring(word, hi + more + 1), '|', length(word) - more, '|', lo)")
    return cut.withColumn("key", key)


def piece(side: str) -> Column:
    return F.expr(f"substring({side}.word, {side}.lo + 1, {side}.hi - {side}.lo + {side}.more)")


def met(rows: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: indexed and probing words of one key that are one edit apart, each pair once."""
    here, there = rows.where("more = 0").alias("r"), rows.alias("s")
    one_edit = F.levenshtein(piece("r"), piece("s"), 1) == 1
    once = F.expr("s.more = 1 or r.word < s.word")
    first = F.expr("r.hi = length(r.word) or substring(r.word, 1, r.hi) <> substring(s.word, 1, r.hi)")
    return here.join(there, (F.col("r.key") == F.col("s.key")) & once & one_edit & first).select(
        F.col("r.word").alias("a"), F.col("s.word").alias("b"), F.col("r.n").alias("a_n"), F.col("s.n").alias("b_n")
    )


def near_pairs(words: DataFrame, scratch: common.Scratch, crowd: int = 4096) -> DataFrame:
    """a, b, a_n, b_n of all words one edit apart.  A key whose index and probe rows would be compared more than ``crowd``
    times is cut further; the pairs and the rows of each round are written tables."""
    whole = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("more"), F.lit(0).alias("lo"))
    rows = halved(whole.withColumn("hi", F.length("word") - F.col("more")))
    found = []
    while True:
        met_often = (F.sum(1 - F.col("more")) * F.count(F.lit(1)) > crowd) & (F.max(F.col("hi") - F.col("lo")) > 1)
        crowded = scratch.table(rows.groupBy("key").agg(met_often.alias("c")).where("c").select("key"), "variants-crowded")
        if crowded.isEmpty():
            found.append(scratch.table(met(rows), "variants-pairs"))
            return reduce(DataFrame.unionAll, found)
        found.append(scratch.table(met(rows.join(crowded, "key", "left_anti")), "variants-pairs"))
        rows = scratch.table(halved(rows.join(crowded, "key", "left_semi")), "variants-rows")


def roots(forms: DataFrame, scratch: common.Scratch) -> DataFrame:
    """word, root: the last of the chain of (word, form).  Each round doubles the steps that a pointer has gone."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = scratch.table(step, "variants-roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def group(docs: DataFrame, scratch: common.Scratch, text: str = "text", key: str = "doc_id", shortest: int = 7, least: int = 2, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of ``least`` occurrences, the near word that it is a variant of (one
    of at least ``factor`` times its occurrences) and the last form of that chain."""
    words = scratch.table(word_counts(docs, text, key, shortest).where(F.col("n") >= least), "variants-words")
    pairs = near_pairs(words, scratch)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    near = near.select("word", "n_near", (-F.col("best.m")).alias("m"), F.col("best.other").alias("other"))
    takes = F.col("m") >= factor * F.col("n")
    known = scratch.table(
        words.join(near, "word", "left").select("word", F.when(takes, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("m")).alias("form_n")),
        "variants-near",
    )
    chain = roots(known.where("form is not null"), scratch)
    return known.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_pigeonhole_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.Scratch(spark) as scratch:
        return common.as_table(spark, group(common.read(spark, sf_dir, "documents"), scratch), "variants")
