"""Fill-in-middle transformation with bit masks held in Python's large integers.

A text of w code points becomes an integer of w bits that has its letters set: ``bytes.translate`` maps the code points to
binary digits, base two turns them into a number in linear time.  Shifting it by one and combining the two leaves a bit for
every code point that begins a token, ``bit_count`` gives the number of tokens, and the place of the k-th one is found by
halving: count the lower half, go on in the half that holds it.  No list of tokens is made.

Defined results.  A null or empty text has no token and stays plain, as does a text that holds one of the marks.  A null id
hashes like an empty one.  Repeated ids and rows stay and are cut alike.  Extra columns are not read.  An empty table gives
an empty result.  Memory holds a slice of a batch of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARKS = ("<P>", "<S>", "<M>")
#: A binary digit per byte: one for A-Z and a-z.
LETTERS = bytes(49 if 65 <= b & 0xDF <= 90 and b < 128 else 48 for b in range(256))
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def starts(text: str) -> int:
    """Bit i is set if a token ([A-Za-z]+ or any other code point) begins at code point i."""
    if not text:
        return 0
    letters = int(text.encode("latin-1", "replace")[::-1].translate(LETTERS), 2)  # a byte per code point, the first one lowest
    return ((1 << len(text)) - 1) & ~(letters & letters << 1)


def select(bits: int, k: int, width: int) -> int:
    """Place of the set bit with k set bits below it."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, k, at, width = bits >> half, k - below, at + half, width - half
    return at


def transform(text: str, key: int | None, seed: int, changed: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix, of the middle, output) of one text."""
    bits = starts(text)
    n = bits.bit_count()
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= changed or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (select(bits, k, len(text)) if k < n else len(text) for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, changed: int = 90, suffix_first: int = 20, slice_chars: int = 4_000_000) -> DataFrame:
    """Row per row of ``docs``: key, n, form, prefix_chars, middle_chars, output.  Map-only.

    ``changed`` per cent of the texts are changed, ``suffix_first`` per cent of these begin with their suffix (spm).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                rows, end, size = [], at, 0
                while end < batch.num_rows and (end == at or size < slice_chars):
                    t = texts[end].as_py() or ""
                    rows.append(transform(t, keys[end].as_py(), seed, changed, suffix_first))
                    size += len(t)
                    end += 1
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), *columns], [key, *schema.names])
                at = end

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output came from."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op13_bit_parallel_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _number(k: int) -> str:
    return "(" + " + ".join(f"(strpos('0123456789abcdef', substr(h, {8 * k + i}, 1)) - 1) * {16 ** (8 - i)}" for i in range(1, 9)) + ")"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS tokens, {_number(0)} AS h1, {_number(1)} AS h2, {_number(2)} AS h3, {_number(3)} AS h4 FROM d),
v AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b FROM u),
w AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(tokens[1:a], ''), '') AS p, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS m, coalesce(array_to_string(tokens[b + 1:], ''), '') AS s FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM w
"""
