"""Toxicity, spelling variants and fill-in-middle against brute force, and their defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.llm import common, middle, toxicity, variants

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "1", "<P> marked", "Ab1cd  e", "ß straße ŒUVRE 日本語 \U0001f600x", "word " * 3000, "x" * 5000, "same text here", "same text here", "a\nb\r\nc\x00d"]


def docs_of(spark, texts):
    rows = [(i if t is not None else None, t, "en", "clash", 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, output string, n int, word string")


# fill-in-middle


def cut_by_list(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (len(tokens), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")))


def test_select_finds_every_bit():
    r = random.Random(0)
    for width in (1, 2, 63, 64, 65, 1000):
        bits = r.getrandbits(width) | 1
        assert [middle.select(bits, k, width) for k in range(bits.bit_count())] == [i for i in range(width) if bits >> i & 1]


def test_middle_by_lists(spark):
    docs = docs_of(spark, ODD * 12).withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("doc_id")))
    got = middle.fill_in_middle(docs, slice_chars=100).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i if t is not None else None, *cut_by_list(i if t is not None else None, t), t or "") for i, t in enumerate(ODD * 12))
    assert Counter(map(tuple, got)) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middle_query_and_shares(spark):
    rows = {r.doc_id: r for r in middle.op13_bit_parallel_middle(spark, SF).collect()}
    for d in common.read(spark, SF, "documents").select("doc_id", "text").collect():
        n, form, a, b, out = cut_by_list(d.doc_id, d.text)
        r = rows[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, b)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
    assert middle.fill_in_middle(docs_of(spark, [])).count() == 0


# spelling variants


def words_by_pattern(rows):
    total = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def near_by_deletions(words):
    """All pairs one edit apart: equal after taking away a place, or one is the other less a code point."""
    by, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in by.values():
        for a in group:
            near[a] |= group - {a}
    return near


def grouped(words):
    near, form = near_by_deletions(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").collect()]
    want = grouped(words_by_pattern(docs))
    got = variants.op12_pigeonhole_variants(spark, SF).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert any(n_near for *_, n_near, _ in want)


@pytest.mark.parametrize("crowd", [2, 40, 4096])
def test_variants_in_crowds(spark, crowd):
    r = random.Random(1)
    words = {"".join(r.choice("abé") for _ in range(r.choice((7, 8, 8, 9, 10)))): r.choice((2, 3, 40, 500, 9000)) for _ in range(700)}
    words |= {"a" * k: 3 for k in range(7, 14)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    with common.Scratch(spark) as scratch:
        pairs = variants.near_pairs(table, scratch, crowd).collect()
    near = near_by_deletions(words)
    want = {frozenset((a, b)) for a in near for b in near[a]}
    assert len(pairs) == len(want) and {frozenset((p.a, p.b)) for p in pairs} == want
    assert all(p.a_n == words[p.a] and p.b_n == words[p.b] for p in pairs)


def test_variants_chain_and_odd_rows(spark):
    texts = [None, "", "Wonderful " * 3000, "wonderfull " * 200, "wonderfulll " * 12, "wonderfu " * 2, "ÀÉÎÕÜÇÑ àéîõüçñ " * 2, "short " * 9, "lonely-words"]
    docs = docs_of(spark, texts)
    with common.Scratch(spark) as scratch:
        got = set(map(tuple, variants.group(docs, scratch).collect()))
        assert variants.group(docs_of(spark, []), scratch).count() == 0
    want = grouped(words_by_pattern([(i if t is not None else None, t) for i, t in enumerate(texts)]))
    assert got == want
    assert len({r[2] for r in got if r[0].startswith("wonder")}) < len([r for r in got if r[0].startswith("wonder")])


# toxicity


def test_risk_is_unbiased_and_training_never_rewards_overfitting():
    r = np.random.default_rng(0)
    toxic = r.random(20000) < 0.3
    z = np.where(toxic, 1.0, -1.0) + r.normal(size=20000)
    p, clean = toxicity.risk(z[toxic], z, toxic.mean())
    assert abs(clean - 0.7 * toxicity.sigmoid(z[~toxic]).mean()) < 0.01 and abs(p - 0.3 * toxicity.sigmoid(-z[toxic]).mean()) < 0.01
    rows = toxicity.Rows.of([np.array([0, 2])] * 40)
    rest = toxicity.Rows.of([np.array([0, 2])] * 20 + [np.array([1, 2])] * 180)
    w, b = toxicity.train(rows, rest, 3, 0.1)
    assert rows.scores(w, b).min() > 0 > rest.scores(w, b)[20:].max()


def test_cut_lies_in_the_gap():
    positive, unlabelled = np.array([-3.0, 4, 5, 6]), np.array([-5.0, -4, -3, -2, -1, 5])
    assert 0.9 < toxicity.best_cut(positive, unlabelled, 0.2) < 2


def test_near_copies_count_once():
    import pyarrow as pa

    lists = [[f"w{k}" for k in range(50)], [f"w{k}" for k in range(1, 50)], [f"v{k}" for k in range(50)], []]
    words, ids, cuts = toxicity.rows_of(pa.chunked_array([pa.array(lists, pa.list_(pa.string()))]))
    assert len(toxicity.firsts(toxicity.sketches(words, ids, cuts))) == 3


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.5), ("sf0.1", 0.85)])
def test_toxicity_on_held_out_labels(spark, sf, least):
    got = toxicity.op11_nonnegative_pu(spark, f"/root/testdata/{sf}")
    docs, labels = common.read(spark, f"/root/testdata/{sf}", "documents"), common.read(spark, f"/root/testdata/{sf}", "labels")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) >= least and np.mean(clean) <= 0.01


def test_held_out_labels_are_not_learnt(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.read(spark, sf, "documents"), common.read(spark, sf, "labels")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.scored(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_toxicity_of_odd_rows(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(None, 1), (3, None), (3, 0), (6, 1), (6, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.scored(docs, known).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got} == {0.0}
    assert toxicity.scored(docs.limit(0), labels).count() == 0
