"""The dealt operators against libraries, brute force and SQL, and their defined results for odd rows."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from facetlake.llm import bpe, chat, media, neardup, packing, pii, quality, queries, token_files, url_filter, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a\x1cb", "x<|endoftext|> y \n<|endoftext|>", "ΑΣ İx é ́ﬁ", "日本 123 ４５", "a" * 3000, "it's 's \t\r\n B!!", "same text here", "same text here", "\U0001f600 " * 40]


def docs_of(spark, texts, extra=""):
    rows = [(i if t is not None else None, t, "en", "s", 0, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, n_words int")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted((tuple(r[cols.index(c)] for c in got.columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_bpe_equals_library(spark):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = bpe.digests(docs_of(spark, ODD), P.path("word_bpe_49k.json")).collect()
    want = []
    for t in ODD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((1, 0), (1, 9), (700, 50), (3000, 10**6), (5000, 2**40)):
        v = np.sort(r.integers(0, top + 1, n))
        e = token_files.EliasFano.load(token_files.EliasFano.of(v).dump())
        assert [e.select(i) for i in range(0, n, 37)] == v[::37].tolist()
        assert (e.slice(n // 3, n) == v[n // 3 :]).all()


def test_token_files(spark, tmp_path):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    manifest = token_files.write(docs_of(spark, ODD), f"file://{tmp_path}/t", P.path("word_bpe_49k.json"))
    start = 0
    want = []
    for i, t in sorted(enumerate(ODD), key=lambda x: (x[1] is not None, x[0])):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i if t is not None else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.read(manifest).collect()), key=lambda r: r[1]) == want


def test_packing(spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs_of(spark, ODD), P.path("byte_bpe_50k.json"), window=64).collect()
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for t in ODD)
    assert sum(r.length for r in rows) == total
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(64 for _ in by) - total < 64


def test_media(spark):
    table = media.store(docs_of(spark, ODD))
    rows = media.resolve(media.interleave(table.select("k", "html")), media.measure(table)).where("item.kind = 'media'").collect()
    assert len(rows) == len(ODD)
    raw = sorted((t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 64)) * 64, b"\0") for t in ODD)
    assert sorted(hashlib.sha256(p).hexdigest() for p in raw) == sorted(r.payload_sha256 for r in rows)
    items = media.items_of("<p>a &amp; b</p><figure><img src='sha256:x' alt='q'><figcaption>cap</figcaption></figure><script>no</script><p>c")
    assert [(i["pos"], i["kind"], i["text"], i["caption"]) for i in items] == [(0, "text", "a & b", None), (1, "media", None, "cap"), (2, "text", "c", None)]
    assert media.items_of(None) == []


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 3)
    monkeypatch.setattr(warc, "SAMPLE_ROWS", 2)
    pages = spark.createDataFrame([(i if i else None, u, h, 5, "x") for i, (u, h) in enumerate([(None, None), ("http://www.b.org/X?q#f", "hi"), ("http://a.org", "hi"), ("bad url\n", ""), ("http://a.org/", "é" * 100_000), ("http://a.org/", "hi"), ("http://a.org/", None)])], "page_id long, url string, html string, captured_at long, d string")
    path = f"file://{tmp_path}/w"
    rows = warc.merge(warc.runs(warc.write(pages, path), path), path, task_rows=2).collect()
    keys = [warc.order(r.asDict()) for r in rows]
    assert keys == sorted(keys) and len(rows) == 7
    assert {r.page_id: r.refers_to for r in rows} == {None: None, 1: None, 2: 1, 3: None, 4: None, 5: 1, 6: 3}
    r = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 7):
        lists = [sorted(({"url_key": f"u{x % 5}", "captured_at": int(x), "page_id": n} for n, x in enumerate(r.integers(0, 30, 20))), key=warc.order) for _ in range(k)]
        assert list(map(warc.order, warc.LoserTree(lists))) == sorted(warc.order(c) for x in lists for c in x)


def chosen_by_hand(values, strata, grid, alpha, delta):
    """The strictest cutoff of the fixed sequence, loosest first, that passes with all before it."""
    n, a, best = len(values), alpha / len(quality.MEASURES), None
    for cutoff in sorted(grid, reverse=True):
        k = sum(v > cutoff for v in values)
        p = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(a) + (n - j) * math.log1p(-a)) for j in range(k + 1)) if k < n * a else 1.0
        if p > delta / (strata * len(quality.MEASURES)):
            break
        best = cutoff
    return best


def test_quality_cutoffs_are_chosen(spark):
    """Large strata get cutoffs in the order of the sequence, one a document short of enough gets none; bad documents don't count."""
    r = np.random.default_rng(3)
    sizes = {"en": 6000, "de": 1800, "few": 300}
    rows, i = [], 0
    for lang, n in sizes.items():
        for good in (1, 0):
            values = {"symbols": r.exponential(60 if good else 900, n), "dup_lines": r.exponential(300, n), "repeats": r.exponential(150, n), "long_words": r.normal(500, 60, n), "short_words": r.normal(-450, 40, n)}
            for j in range(n):
                rows.append((i, lang, good, False, *[int(values[m][j]) for m in quality.MEASURES]))
                i += 1
    scored = spark.createDataFrame(rows, "doc_id long, lang string, good int, base_failed boolean, " + ", ".join(f"m_{m} long" for m in quality.MEASURES))
    labels = scored.selectExpr("doc_id", "good as quality", "0 as toxic")
    got = {c.stratum_key: c for c in quality.cutoffs(scored.drop("good"), labels).collect()}
    by = {lang: [x for x in rows if x[1] == lang and x[2]] for lang in sizes}
    want = {(lang, m): chosen_by_hand([x[4 + k] for x in by[lang]], 3, quality.MEASURES[m][1], 0.02, 0.05) for lang in sizes for k, m in enumerate(quality.MEASURES)}
    assert {(lang, m): got[f"={lang}"][f"c_{m}"] if f"={lang}" in got else None for lang, m in want} == want
    assert sum(v is not None for (lang, _), v in want.items() if lang == "en") == 5 and all(want["few", m] is None for m in quality.MEASURES)
    # the verdict comes from them: clearly bad documents go, good ones stay but for the share allowed
    verdict = quality.decide(scored, spark.createDataFrame([tuple(c) for c in got.values()], quality.cutoffs(scored, labels).schema)).groupBy("lang", "good").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {(v.lang, v.good): v.k for v in verdict}
    assert share["en", 1] > 0.98 and share["de", 1] > 0.98 and share["en", 0] < share["en", 1] - 0.1 and share["few", 1] == share["few", 0] == 1


def test_quality_guarantee_holds_over_draws():
    """Over many drawn holdouts the chosen cutoff's true rate of false rejection exceeds its bound at most as often as delta allows."""
    r, grid, broken, draws = np.random.default_rng(4), quality.MEASURES["symbols"][1], 0, 1500
    a, level = 0.02 / 5, 0.05  # one stratum and measure: the whole of delta is spent on it
    scale = 500 / -math.log(a * 1.02)  # the cutoff of 500 is just unsafe
    for _ in range(draws):
        values = r.exponential(scale, 2500)
        best = chosen_by_hand(values, 1, grid, 0.02, level * len(quality.MEASURES))
        broken += best is not None and math.exp(-best / scale) > a
    assert broken / draws < level + 3 * (level * (1 - level) / draws) ** 0.5


def test_quality_risk(spark):
    n, k = 400, 3
    from math import comb

    exact = sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1))
    got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.02)).first()[0]
    assert got == pytest.approx(exact)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs_of(spark, [*ODD, "w " * 30, " ".join(f"w{i}" for i in range(30))]), labels).collect()
    assert len(rows) == len(ODD) + 2 and all(r.kept != r.base_failed for r in rows)  # no labels: only the base rules reject
    assert max(r.n_repeat_words for r in rows) == 40


def test_chat_reversible(spark):
    said = ["</s>[INST] ok [/INST]", "\\</s> \\\\[ROLE]", "", None, "x\\", "a\n</s>\n[/ROLE]\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", None, "assistant", "as[ROLE]"], said))] + [(None, None, None, None), (2, 0, "assistant", "word " * 900), (2, 1, "assistant", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.windows(df, budget=16, history=8)).collect()}
    for cid in (1, 2, None):
        turns = [((r or ""), (t or "")) for c, _, r, t in rows if c == cid]
        assert got[cid].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[cid].loss_sha256 == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
    assert chat.windows(df.where("false")).count() == 0


def test_url_ties_and_nulls(spark):
    entries = spark.createDataFrame([("l", "block", "domain", "b.org", "add", 10), ("l", "block", "domain", "b.org", "remove", 20), ("l", "block", "domain", "b.org", "add", 10), ("l", "block", "domain", "b.org", "remove", 10), ("t", "allow", "prefix", "a.b.org/ok", "add", 0), (None, "block", "domain", "c.org", "add", 0)], "list string, verdict string, kind string, pattern string, action string, at long")
    caps = spark.createDataFrame([(1, "http://a.b.org/x", 10, "r"), (2, "http://a.b.org/x", 20, "r"), (3, "http://a.b.org/ok/1", 15, "r"), (4, None, 15, "r"), (5, "http://b.org", None, "r"), (6, "http://c.org", 5, "r"), (1, "http://a.b.org/x", 10, "r")], "page_id long, url string, fetched_at long, reason string")
    got = sorted((r.page_id, r.blocked) for r in url_filter.judge(caps, entries).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False)]
    assert url_filter.judge(caps, entries.where("false")).where("blocked").count() == 0


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = lambda: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def test_pii_rules(spark):
    texts = [*ODD, "a@b.c_d@e.f a@b.c._x@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1", "+1 (887) 555-2355x 4111 1111 1111 1111 4111-1111-1111-1112", "9" * 40_000, "a" * 20_000 + "@b", "+" + "1 " * 5000]
    for r in pii.select(pii.scan(docs_of(spark, texts).withColumn("i", F.monotonically_increasing_id()).select("doc_id", "text", F.col("text").alias("again"))), None).collect():
        t = r.again or ""
        want = sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(RULES.items()) for m in re.finditer(p, t) if valid(k, m.group()))
        assert [tuple(x) for x in r.spans] == want


def test_pii_redaction(spark):
    df = spark.createDataFrame([(1, "mail é a@b.co now +1 555 555 5555", 0), (2, None, 0)], "doc_id long, text string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in pii.redacted(df).collect()) == [(1, "mail é [EMAIL] now [PHONE]"), (2, None)]


def test_neardup_classes(spark):
    r = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in r.integers(0, 4000, 200)) for _ in range(30)]
    texts = [None, "", "", "!!", "one two", "ONE two", *base, *base[:10]]
    for k in range(60):  # a crowd of near copies
        w = base[0].split()
        w[int(r.integers(0, 200))] = f"x{k}"
        texts.append(" ".join(w))
    df = docs_of(spark, texts)
    got = {(x.doc_id): x.class_id for x in neardup.classes(df).collect()}
    idf = neardup.frequencies(df)
    sets = {i: neardup.shingles(neardup.hashes_of(neardup.words_of(t)), idf) for i, t in enumerate(texts) if t is not None}
    label = {i: i for i in sets}
    for _ in range(4):
        for i in sets:
            for j in sets:
                if neardup.similarity(sets[i], sets[j]) >= neardup.THRESHOLD or texts[i] == texts[j]:
                    label[i] = label[j] = min(label[i], label[j])
    assert {i: got[i] for i in sets} == label
    assert neardup.classes(df.where("false")).count() == 0
    assert neardup.survivors(df.where("doc_id is not null")).count() == len(set(label.values()))


def test_pipeline_keeps_clean_rows(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.join(docs, "doc_id", "left_anti").count() == 0
    assert rows.select("doc_id").distinct().count() > 0.7 * docs.count()


def linked(texts, idf):
    """Smallest index of each text's component, by brute force."""
    sets = [neardup.shingles(neardup.hashes_of(neardup.words_of(t)), idf) for t in texts]
    label = list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if neardup.similarity(sets[i], sets[j]) >= neardup.THRESHOLD]
    while (new := [min([label[i]]) for i in range(len(sets))]) is not None:
        for i, j in pairs:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return label
        label = new


def one_bucket(monkeypatch):
    """All texts share one band and no other; each word weighs the same."""
    real = neardup.samples

    def same_first(*a):
        out = real(*a)
        out[:, 0] = 0.5
        return out

    monkeypatch.setattr(neardup, "samples", same_first)
    monkeypatch.setattr(neardup, "BANDS", np.array([[0]]))
    monkeypatch.setattr(neardup, "frequencies", lambda *_: np.ones(neardup.SLOTS, np.float32))


def test_neardup_families_round_several_centres(spark, monkeypatch):
    """Two families are linked by one pair only, whose texts different leaders settle."""
    one_bucket(monkeypatch)
    monkeypatch.setattr(neardup, "CELL_ROWS", 100)
    r = np.random.default_rng(3)
    shared = [f"c{x}" for x in range(160)]
    own = [[f"f{k}x{x}" for x in range(42)] for k in range(8)]
    texts = []
    for k in range(8):
        for n in range(60):  # near copies of the centre
            w = shared + own[k]
            w[int(r.integers(0, 160))] = f"k{k}n{n}"
            texts.append(" ".join(w))
    for k in range(7):  # bridges
        texts += [" ".join(shared + own[k + 1][:m] + own[k][m:]) for m in (12, 27)]
    texts = [texts[i] for i in r.permutation(len(texts))]
    got = {x.doc_id: x.class_id for x in neardup.classes(docs_of(spark, texts)).collect()}
    want = linked(texts, np.ones(neardup.SLOTS, np.float32))
    assert len(set(want)) < 8
    assert [got[i] for i in range(len(texts))] == want


def test_neardup_recall_in_a_crowd_below_the_threshold(spark, monkeypatch):
    """Pairs just above the threshold inside a crowd just below it, whose texts share one band only."""
    one_bucket(monkeypatch)
    monkeypatch.setattr(neardup, "CELL_ROWS", 64)
    r = np.random.default_rng(4)
    shared = [f"c{x}" for x in range(170)]
    texts = []
    for n in range(100):
        own = [f"o{n}x{x}" for x in range(30)]
        texts += [" ".join(shared + own), " ".join(shared + own[:13] + [f"p{n}x{x}" for x in range(17)])]
    texts = [texts[i] for i in r.permutation(len(texts))]
    got = {x.doc_id: x.class_id for x in neardup.classes(docs_of(spark, texts)).collect()}
    want = linked(texts, np.ones(neardup.SLOTS, np.float32))
    assert len(set(want)) == 100
    assert [got[i] for i in range(len(texts))] == want


def test_warc_id_with_two_payloads(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c")]
    pages = spark.createDataFrame([(i, f"http://x.org/{n}", h, 5) for n, (i, h) in enumerate(rows)], "page_id long, url string, html string, captured_at long")
    path = f"file://{tmp_path}/w"
    got = warc.merge(warc.runs(warc.write(pages, path), path), path).collect()
    assert sorted((r.url_key[-1], r.page_id, r.record_type, r.refers_to) for r in got) == [
        ("0", 1, "response", None), ("1", 2, "revisit", 1), ("2", 2, "response", None), ("3", 3, "revisit", 1), ("4", 3, "revisit", 2), ("5", 3, "response", None)
    ]


def test_neardup_repeated_and_null_ids(spark):
    r = np.random.default_rng(6)
    a, b, c, d = ([f"w{x}" for x in r.integers(0, 9000, 200)] for _ in range(4))
    near = lambda w: " ".join([*w[:100], "changed", *w[101:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, near(a)), (6, near(b)), (None, " ".join(c)), (None, near(c)), (None, near(d)), (7, " ".join(d)), (8, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in neardup.classes(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (1, 1), (5, 1), (6, 1), (None, None), (None, None), (None, 7), (7, 7), (8, 8)], key=repr)
    kept = [tuple(x) for x in neardup.survivors(df).collect()]
    assert {t for i, t in kept if i is not None} == {" ".join(a), " ".join(b), " ".join(d), "alone"}
    assert len(kept) == 5 and sum(i is None for i, _ in kept) == 1


def test_neardup_recall(spark):
    """Every link of brute force over random near copies around the threshold: at least 0.99 end in one class."""
    r = np.random.default_rng(8)
    texts = []
    for k in range(60):
        base = [f"b{k}x{x}" for x in r.integers(0, 5000, 240)]
        for _ in range(8):
            w = list(base)
            for at in r.integers(0, 240, int(r.integers(1, 7))):
                w[at] = f"e{r.integers(0, 10**9)}"
            texts.append(" ".join(w))
    texts = [texts[i] for i in r.permutation(len(texts))]
    df = docs_of(spark, texts)
    got = {x.doc_id: x.class_id for x in neardup.classes(df).collect()}
    idf = neardup.frequencies(df)
    sets = [neardup.shingles(neardup.hashes_of(neardup.words_of(t)), idf) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if neardup.similarity(sets[i], sets[j]) >= neardup.THRESHOLD]
    assert len(links) > 300
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)
    by = defaultdict(set)
    for i, c in got.items():
        by[c].add(i)
    want = linked(texts, idf)
    assert all(len({want[i] for i in members}) == 1 for members in by.values())  # nothing that brute force keeps apart


def test_samples_estimate_the_similarity():
    r = np.random.default_rng(9)
    keys, weights = r.integers(0, 2**63, 4000, dtype=np.uint64), r.random(4000) * 30 + 5
    a, b = np.sort(keys[:2400]), np.sort(keys[600:3000])
    of = dict(zip(keys.tolist(), weights))
    sets = [(x, np.array([of[k] for k in x.tolist()])) for x in (a, b)]
    est = []
    for part in range(40):  # forty pairs of slices
        x, y = [(k[k % np.uint64(40) == part], w[k % np.uint64(40) == part]) for k, w in sets]
        s = neardup.samples(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), np.array([0, len(x[0]), len(x[0]) + len(y[0])]))
        est.append((s[0] == s[1]).mean() - neardup.similarity(x, y))
    assert abs(np.mean(est)) < 0.03


def test_packing_equals_brute_force(spark):
    """Ids of every piece, and each window's order by BM25 over its shard, term by term."""
    import math

    r = np.random.default_rng(10)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 60, int(r.integers(3, 60)))) for _ in range(90)] + [None, "", "same text"] + ["same text"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    window = 128
    rows = packing.pack(df, P.path("byte_bpe_50k.json"), window=window).collect()  # one partition, one shard
    for i, own in ids.items():
        at = 0
        for p in sorted((p for p in rows if p.doc_id == i), key=lambda p: p.start):
            piece = np.array(own[at : at + p.length], "<u4")
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(own), zlib.crc32(piece.tobytes())) and p.ids == piece.astype("<u2").tobytes()
            at += p.length
        assert at == len(own)
    n, mean = len(ids), sum(map(len, ids.values())) / len(ids)
    df_of = defaultdict(int)
    for own in ids.values():
        for t in set(own):
            df_of[t] += 1

    def score(q, d):
        return sum(math.log1p((n - df_of[t] + 0.5) / (df_of[t] + 0.5)) * (f := ids[d].count(t)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ids[d]) / mean)) for t in set(ids[q]))

    used: set[int] = set()
    for seq in sorted({p.sequence_id for p in rows}):
        pieces = sorted((p for p in rows if p.sequence_id == seq), key=lambda p: p.offset)
        seed = pieces[0].doc_id
        used.add(seed)
        if len(ids[seed]) - pieces[0].start >= window:
            continue
        for p in pieces[1:]:
            best = max(score(seed, d) for d in ids if d not in used)
            assert score(seed, p.doc_id) == pytest.approx(best, rel=1e-9)
            used.add(p.doc_id)


def test_packing_scores_go_through_few_postings():
    """Postings of frequent terms, gathered one by one for every seed, took most of the time of filling windows."""
    r = np.random.default_rng(11)
    docs = [np.concatenate([r.integers(0, 200, 300), [1000 + d // 3]]).astype(np.uint16) for d in range(300)]
    docs[7], docs[250] = docs[90], np.array([65535], np.uint16)
    held = np.zeros((len(docs), packing.VOCABULARY))
    for d, x in enumerate(docs):
        np.add.at(held[d], x, 1)
    frequency, lens = (held > 0).sum(axis=0), held.sum(axis=1)
    index = packing.Index(docs, frequency, len(docs), lens.mean())
    weight = np.log1p((len(docs) - frequency + 0.5) / (frequency + 0.5)) * held * 2.2 / (held + 1.2 * (0.25 + 0.75 * lens / lens.mean())[:, None])
    for seed in (0, 7, 90, 250, 299):
        scores = index.scores(seed)
        assert np.allclose(scores, weight @ (held[seed] > 0), rtol=1e-9, atol=0) and scores[7] == scores[90]
    assert len(index.doc) <= len(docs)  # of about 47,000


def test_batches_lose_no_row(spark):
    """More rows in one task than any operator takes at once: every row comes out of the operators that work in batches."""
    n = 11_000
    df = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    packed = packing.pack(df, P.path("byte_bpe_50k.json"))
    assert packed.select("doc_id").distinct().count() == n
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert bpe.digests(df, P.path("word_bpe_49k.json")).select("doc_id").distinct().count() == n
    assert neardup.classes(df).select("doc_id").distinct().count() == n
    assert media.store(df).select("k").distinct().count() == n


def test_packing_odd_tables(spark):
    df = spark.createDataFrame([(None, None, 1, 2)] * 3 + [(5, "a b c", 1, 2)] * 40, "doc_id long, text string, place long, ids long")
    rows = packing.pack(df, P.path("byte_bpe_50k.json"), window=16).collect()
    assert sum(r.doc_id is None for r in rows) == 3 and sum(r.length for r in rows) == 3 + 40 * max(r.doc_tokens for r in rows)
    assert packing.pack(df.where("false"), P.path("byte_bpe_50k.json")).count() == 0


def planted(n: int):
    """Texts with rule hits, numbers that are none, and phone numbers and addresses in forms that the rules miss."""
    r = np.random.default_rng(12)
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))

    def card():
        d = digits(15)
        return d + next(str(x) for x in range(10) if sum(y if i % 2 == 0 else 2 * y - 9 * (y > 4) for i, y in enumerate(map(int, reversed(d + str(x))))) % 10 == 0)

    def wrong():
        d = card()
        return d[:-1] + str((int(d[-1]) + 3) % 10)

    phone = lambda: f"1 ({digits(3)}) {digits(3)}-{digits(4)}"
    texts = []
    for k in range(n):
        texts.append(f"call me at +{phone()} or mail u{k}@site{k}.org card {card()} end")
        texts.append(f"order no {wrong()} of {digits(8)} and write to nobody@nowhere in {digits(9)}")
    loose = [f"please call me at {phone()} today" for _ in range(20)] + [f"or mail u{k} [at] site{k}.org now" for k in range(20)]
    return texts, loose


def test_pii_adds_planted_forms(spark):
    texts, loose = planted(700)
    df = spark.createDataFrame(list(enumerate([*texts, *loose])), "doc_id long, text string")
    rows = {x.doc_id: x for x in pii.detect(df).collect()}
    added = lambda x: len(x.spans) - len(x.base)
    assert sum(added(rows[i]) for i in range(len(texts), len(texts) + len(loose))) >= 36  # of 40
    assert sum(added(rows[i]) > 0 for i in range(len(texts))) <= 0.05 * len(texts)
    assert all(set(map(tuple, x.base)) <= set(map(tuple, x.spans)) for x in rows.values())


def test_url_far_times_and_many_buckets(spark):
    entries = spark.createDataFrame([("l", "block", "domain", "b.org", "add", 10)], "list string, verdict string, kind string, pattern string, action string, at long")
    times = [0, 9, 10, 11, 10**17, -(10**17), 2**62, None]
    caps = spark.createDataFrame([(i, "http://b.org", t, 7, 8) for i, t in enumerate(times)], "page_id long, url string, fetched_at long, _row int, _at int")
    got = {x.page_id: x.blocked for x in url_filter.judge(caps, entries).collect()}
    assert got == {i: t is not None and t >= 10 and t < url_filter.OPEN_END for i, t in enumerate(times)}


def test_media_odd_markup(spark):
    html = ["a<![foo b<p>c", "<img src=sha256:x data-bytes=99999999999999999999>", "<img data-bytes='" + "9" * 5000 + "'>", None, "", "<figure><img src='sha256:u'><img src='sha256:v'><figcaption>both</figcaption></figure>t"]
    df = spark.createDataFrame([(1, h, "x") for h in html], "page_id long, html string, items string").drop("items")
    media_of = spark.createDataFrame([("u", "p")], "digest string, payload_sha256 string")
    got = sorted((r.n_items, r.n_media, r.n_resolved) for r in media.described(df, media_of).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 0), (3, 2, 1)]  # an unknown section is a comment
    assert [i["caption"] for i in media.items_of(html[-1])] == ["both", "both", None]


def test_media_fields(spark):
    """All measured fields of each row, against its own text."""
    texts = [None, "", "é", "x" * 64, "y" * 65, "same", "same"]
    table = media.store(docs_of(spark, texts))
    rows = media.resolve(media.interleave(table.select("k", "html")), media.measure(table)).where("item.kind = 'media'").collect()
    for r in rows:
        raw = (texts[r.k] if r.k is not None else "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.item.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        image = np.frombuffer(padded, np.uint8)
        assert r.feature.split(",")[:2] == [f"{image.mean():.4f}", f"{image.std():.4f}"]
        assert "None" not in r.item.caption


def test_pipeline_odd_rows(spark, tmp_path):
    """Null, empty, repeated and short rows, extra columns with names that stages use, and an empty table."""
    import corpus_pipeline

    prose = [" ".join(f"w{k}x{x}" for x in range(60)) for k in range(6)]
    rows = [(None, None, None, None, 0, "a", 1), (1, "", "en", "s", 0, "b", 2), (2, prose[0], "en", "s", 0, "c", 3), (2, prose[0], "en", "s", 0, "d", 4), (3, prose[1] + " mail me@site.org", None, None, None, None, None), *[(10 + k, p, "fr", "t", 0, "e", 5) for k, p in enumerate(prose[2:])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int")
    spark.createDataFrame([(2, 1, 0), (None, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given, ids in ((docs, {2, 3, 10, 11, 12, 13}), (docs.where("false"), set())):
        df = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == docs.columns
        kept = df.collect()
        assert {r.doc_id for r in kept} == ids and len(kept) == len(ids)
        assert not any("@" in (r.text or "") for r in kept)
        packed = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == ids


def test_pipeline_against_brute_force(spark):
    """The stages' decisions on a small table, worked out without Spark."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}

    def failed(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = defaultdict(list)
        for i in range(len(w) - 4):
            grams[tuple(w[i : i + 5])].append(i)
        covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        return len(w) < 10 or 100 * len(covered) > 20 * len(w)

    assert good == {i for i, t in texts.items() if not failed(t)}  # too few labels here for any cutoff
    ids = sorted(good)
    frame = docs.where(F.col("doc_id").isin(ids))
    label = linked([texts[i] for i in ids], neardup.frequencies(frame))
    first = {ids[k] for k in set(label)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == first
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i in sorted(first)[:40]:
        hits = sorted(((m.start(), m.end(), k.upper()) for k, p in RULES.items() for m in re.finditer(p, texts[i]) if valid(k, m.group())), key=lambda h: (h[0], ["EMAIL", "IP", "CARD", "PHONE"].index(h[2])))
        out, at = "", 0
        for s, e, k in hits:
            if s >= at:
                out += texts[i][at:s] + f"[{k}]"
            at = max(at, e)
        want = len(lib.encode(out + texts[i][at:], add_special_tokens=False).ids) + 1
        assert {r.doc_tokens for r in rows if r.doc_id == i} == {want}
