"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five-word windows (lower-case ``\\w+`` words; a shorter text is one shingle).  A shingle weighs its
count in the text times the sum of its words' inverse document frequencies, ``1 + ln(N / df)``: that is the idf of
five independent words.  The shingle's own document frequency is not used, because it is high exactly within a large
group of near copies, where it would push their similarity below the threshold.  Document frequencies cover all
documents, in 2**20 word-hash slots (4 MB, whatever the corpus), which is what tasks share.

Texts with equal words are collapsed first.  Each distinct text gets 64 consistent weighted samples.  Its 36 bands
are sevens of samples out of four fixed shuffles, so a pair at similarity 0.8 shares a band with probability 0.994,
one at 0.3 with 0.008.  Two texts are linked if their exact weighted Jaccard similarity reaches 0.8, and a class is a
connected component of the links.  Only links that join two components need to be found, so the work is:

1. In each bucket the member that meets most others leads (the middle of a group of copies), and every member is
   compared with the leaders it meets.  That is linear in the members and settles most of a group, whatever its size.
2. Buckets that still hold several components are gone through pair by pair, but only across components: members of
   the main component meet the others in cells of bounded size, a cell compares its best-agreeing pairs first and
   skips those that links found meanwhile have joined.  A pair is looked at in the first band that it shares, and
   measured if at least 42 of its 64 samples agree (0.2 % of the pairs at 0.8 do not).  Cells give links, never pairs.
No group or bucket is capped.  Texts that share bands but lie just below 0.8 of each other all have to be told apart;
that is quadratic in such a crowd, in memory of a cell and without pair rows.

Defined results.  Null text counts as empty.  Texts without words are in one class only if they are equal.
Repeated rows and ids stay; null doc_id gets a row with its class.  If ids repeat or are null, rows take part under a
number of their own.  An empty table gives no rows.  Other columns are ignored by ``classes`` and kept by ``survivors``.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8
SAMPLES = 64
#: Samples of which a linked pair shares at least so many.
AGREE = 42
#: Most members and bytes of text on one side of a cell.
CELL_ROWS, CELL_BYTES = 512, 16 << 20
#: Lists of up to this many ids (8 bytes each) are broadcast to filter documents; longer ones are joined.
BROADCAST_IDS = 1_000_000
SLOTS = 1 << 20
#: Shingles of recently compared texts that a task remembers (32 MB); a longer text is held on its own.
HELD = 1 << 21
WORD = re.compile(r"\w+")
CACHE = 250_000
_words: dict[str, bytes] = common.memory()
U64 = np.uint64


def layout(shuffles: int = 4, rows: int = 7) -> np.ndarray:
    """Samples of each band: (bands, rows)."""
    draw = np.random.default_rng(11)
    cut = SAMPLES // rows * rows
    return np.concatenate([draw.permutation(SAMPLES)[:cut].reshape(-1, rows) for _ in range(shuffles)])


BANDS = layout()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashes_of(words: list[str]) -> np.ndarray:
    """64-bit hash of each word."""
    known = common.turn_to(_words)
    try:
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8")
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        out = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8")
        if len(known) > CACHE:  # frequent words come first in the dictionary
            for w in list(known)[CACHE // 2 :]:
                del known[w]
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shingles(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, weights) of a text's word hashes."""
    if not len(h):
        return np.zeros(0, U64), np.zeros(0)
    own = idf[(h >> U64(44)).astype(np.int64)]
    n = max(1, len(h) - SHINGLE + 1)
    x, w = np.zeros(n, U64), np.zeros(n)
    for k in range(min(SHINGLE, len(h))):
        x = x * U64(0x9E3779B97F4A7C15) + h[k : k + n]
        w += own[k : k + n]
    keys, first, tf = np.unique(mix(x), return_index=True, return_counts=True)
    return keys, w[first] * tf


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity, exact."""
    if not len(a[0]):
        return 0.0
    at = np.minimum(a[0].searchsorted(b[0]), len(a[0]) - 1)
    low = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high > 0 else 0.0


SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Gamma(2, 1) at the middles of n equal shares, by bisection of 1 - (1 + x) exp(-x)."""
    u = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return lo


_gamma = gamma_quantiles()
GAMMA, LOG_GAMMA = _gamma.astype(np.float32), np.log(_gamma).astype(np.float32)


def samples(keys: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples of many sets, keys[cuts[i]:cuts[i + 1]] being set i.

    Entry (i, k) is the smallest ln a over set i: a shingle with the same quantised weight gives the same value, so
    equal entries stand for equal samples.  Its draws r and c (Gamma) and beta (uniform) are 16 bits each of one hash.
    """
    out = np.empty((len(cuts) - 1, len(SEEDS)), np.float32)
    logw = np.log(weights).astype(np.float32)
    block = min(1 << 15, len(keys))
    a = np.empty(len(keys), np.float32)
    xs, ys = np.empty((2, block), U64)  # buffers of a block, used again and again
    rs, cs, bs, ts = np.empty((4, block), np.float32)
    for k, seed in enumerate(SEEDS):
        for at in range(0, len(keys), block):
            own = keys[at : at + block]
            m = len(own)
            x, y, r, c, beta, t = xs[:m], ys[:m], rs[:m], cs[:m], bs[:m], ts[:m]
            np.bitwise_xor(own, seed, out=x)
            x *= U64(0xD6E8FEB86659FD93)
            x ^= np.right_shift(x, U64(32), out=y)
            x *= U64(0xD6E8FEB86659FD93)
            x ^= np.right_shift(x, U64(29), out=y)
            draws = x.view(np.uint16).reshape(-1, 4)
            GAMMA.take(draws[:, 0], out=r, mode="clip")
            LOG_GAMMA.take(draws[:, 1], out=c, mode="clip")
            np.multiply(draws[:, 2], np.float32(2**-16), out=beta, dtype=np.float32)
            np.divide(logw[at : at + block], r, out=t)
            t += beta
            np.floor(t, out=t)
            t -= beta
            t += np.float32(1)
            t *= r
            np.subtract(c, t, out=a[at : at + block])
        out[:, k] = np.minimum.reduceat(a, cuts[:-1])
    return out


def frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """idf of each word slot, over all documents; a vector of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                if t:
                    slots = np.unique(hashes_of(list(set(words_of(t)))) >> U64(44)).astype(np.int64)
                    df[slots] += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["slot", "df"])
        pa.default_memory_pool().release_unused()  # Arrow's pool would hold on to freed buffers

    # summed by slot before anything meets: at most SLOTS + 1 rows remain
    total = docs.select(text).mapInArrow(count, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df"))
    df, n = np.zeros(SLOTS, np.int64), 1
    for b in total.repartition(4).toArrow().to_batches():
        slot, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        df[slot[slot >= 0]] = c[slot >= 0]
        n = int(c[slot < 0][0]) if (slot < 0).any() else n
    return (1 + np.log(n / np.maximum(df, 1))).astype(np.float32)


def sketch(docs: DataFrame, shared, key: str, text: str) -> DataFrame:
    """k, digest (of the words, or of a text without any), size (bytes), samples (64 int32; null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                digests, sizes, sigs = [], [], []
                sets: list[tuple[np.ndarray, np.ndarray]] = []
                slots: list[int] = []
                for n, t in enumerate(part.column(1).to_pylist()):
                    h = hashes_of(words_of(t))
                    raw = b"w" + h.tobytes() if len(h) else b"t" + (t or "").encode("utf-8", "surrogatepass")
                    digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                    sizes.append(len(t or ""))
                    sigs.append(None)
                    if len(h):
                        sets.append(shingles(h, idf))
                        slots.append(n)
                if sets:
                    cuts = np.concatenate([[0], np.cumsum([len(s[0]) for s in sets])])
                    s = samples(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), cuts)
                    for n, row in zip(slots, s):
                        sigs[n] = row.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["k", "digest", "size", "samples"])
        pa.default_memory_pool().release_unused()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"k {kind}, digest binary, size long, samples binary")


def banded(reps: DataFrame) -> DataFrame:
    """key, rep for each band of each sampled text; a key's last six bits are its band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(len(BANDS), dtype=U64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                s = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, SAMPLES).astype(U64)
                h = np.broadcast_to(number + U64(1), (len(s), len(BANDS)))
                for r in range(BANDS.shape[1]):
                    h = mix(h * U64(0x9E3779B97F4A7C15) + s[:, BANDS[:, r]])
                h = h << U64(6) | number
                reps_of = np.repeat(part.column(0).to_numpy(), len(BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(reps_of)], ["key", "rep"])

    return reps.where("samples is not null").select("rep", "samples").mapInArrow(run, "key long, rep long")


def buckets(scratch: common.Scratch, reps: DataFrame) -> DataFrame:
    """key, rep, lead of the buckets with two members at least; the member that meets most others leads."""
    band = banded(reps)
    shared = band.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.table(band.join(shared, "key"), "neardup-members")
    met = scratch.table(members.groupBy("rep").agg(F.sum("n").alias("met")), "neardup-met")
    lead = members.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("lead"))).alias("m")).select("key", (-F.col("m.lead")).alias("lead"))
    return scratch.table(members.join(lead, "key"), "neardup-buckets")


def only(docs: DataFrame, key: str, ids: DataFrame, keep: bool) -> DataFrame:
    """Rows of ``docs`` whose key is (not) among ``ids`` (a written table with the same column)."""
    short = ids.count() <= BROADCAST_IDS
    joined = docs.join(F.broadcast(ids) if short else ids, key, "left_semi" if keep else "left_anti")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def compared(cells: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """a, b: links that join two components of a cell.

    ``cells`` has cell, rep, comp, side (0 and 1 are compared with each other, 2 also among themselves), lead (its
    pairs are known) and band (pairs that share an earlier one are left to it; -1: none is).
    """
    masks = [np.packbits(np.isin(np.arange(SAMPLES), b)).view(U64)[0] for b in BANDS]
    names = ["cell", "rep", "comp", "side", "lead", "band", "samples", "text"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of one cell each; rows come sorted by cell."""
        open_: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if open_ and open_[0].column(0)[0].as_py() != cell[lo]:
                    yield pa.Table.from_batches(open_)
                    open_ = []
                open_.append(b.slice(lo, hi - lo))
        if open_:
            yield pa.Table.from_batches(open_)

    def candidates(s: np.ndarray, side: np.ndarray, comp: np.ndarray, lead: np.ndarray, band: int) -> list[tuple[int, int]]:
        """Pairs of places worth measuring, best agreement first."""
        found = []
        for i in range(len(s)):
            to = np.flatnonzero(((side != side[i]) | (side == 2)) & (comp != comp[i]))
            to = to[to > i]
            if band >= 0:
                to = to[~lead[to]] if not lead[i] else to[:0]
            same = s[to] == s[i]
            n = np.count_nonzero(same, axis=1)
            good = n >= AGREE
            if not good.any():
                continue
            to, n, same = to[good], n[good], same[good]
            if band > 0:
                bits = np.packbits(same, axis=1).view(U64).ravel()
                late = np.zeros(len(bits), bool)
                for m in masks[:band]:
                    late |= bits & m == m
                to, n = to[~late], n[~late]
            found.append(np.stack([n, np.full(len(to), i), to]))
        if not found:
            return []
        all_ = np.concatenate(found, axis=1)
        return all_[1:, np.argsort(-all_[0], kind="stable")].T.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, held, size = shared.value, OrderedDict(), 0

        def of(i: int, text: pa.StringScalar) -> tuple[np.ndarray, np.ndarray]:
            nonlocal size
            if i in held:
                held.move_to_end(i)
                return held[i]
            held[i] = made = shingles(hashes_of(words_of(text.as_py())), idf)
            size += len(made[0])
            while size > HELD and len(held) > 2:
                size -= len(held.popitem(last=False)[1][0])
            return made

        links: list[tuple[int, int]] = []
        for g in groups(batches):
            rep, comp, side, lead = (g.column(c).to_numpy() for c in ("rep", "comp", "side", "lead"))
            s = np.frombuffer(b"".join(g.column("samples").to_pylist()), np.int32).reshape(-1, SAMPLES)
            text, up = g.column("text"), {}

            def root(c: int) -> int:
                while up.get(c, c) != c:
                    c = up[c]
                return c

            for i, j in candidates(s, side, comp, lead, g.column("band")[0].as_py()):
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y and similarity(of(int(rep[i]), text[i]), of(int(rep[j]), text[j])) >= THRESHOLD:
                    up[max(x, y)] = min(x, y)
                    links.append((int(rep[i]), int(rep[j])))
            if len(links) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])
                links = []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    rows = cells.join(texts, "rep").select(names)
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def blocks(n: str, size: str) -> Column:
    """Parts that n members with so many bytes are cut into."""
    return F.greatest(F.ceil(F.col(n) / CELL_ROWS), F.ceil(F.col(size) / CELL_BYTES), F.lit(1)).cast("int")


def part_of(n: str) -> Column:
    """A member's part out of n."""
    return F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")


def stars(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Cells of each leader with the members that it meets."""
    met = members.where("rep <> lead").select("lead", "rep").distinct().join(texts.select("rep", "size"), "rep")
    parts = met.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).select("lead", blocks("n", "size").alias("parts"))
    led = met.join(parts, "lead").select("lead", "rep", F.lit(1).alias("side"), part_of("parts").alias("part"))
    leads = parts.select("lead", F.col("lead").alias("rep"), F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return led.unionAll(leads).select(F.xxhash64("lead", "part").alias("cell"), "rep", F.col("rep").alias("comp"), "side", F.lit(False).alias("lead"), F.lit(-1).alias("band"))


def borders(scratch: common.Scratch, members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Cells of the buckets that hold several components."""
    own = members.where("n > 2").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", "lead", F.coalesce("label", "rep").alias("comp"))
    own = scratch.table(own, "neardup-components")
    mixed = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    own = scratch.table(own.join(mixed, "key").join(texts.select("rep", "size"), "rep"), "neardup-open")
    of = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    top = of.groupBy("key").agg(F.max(F.struct("n", "comp", "size")).alias("m"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    top = top.select("key", F.col("m.comp").alias("main"), (blocks("n", "size") == 1).alias("whole"), F.struct(F.col("m.n").alias("n"), F.col("m.size").alias("size")).alias("i"), F.struct((F.col("n") - F.col("m.n")).alias("n"), (F.col("size") - F.col("m.size")).alias("size")).alias("o"))
    top = top.select("key", "main", "whole", blocks("i.n", "i.size").alias("inner"), blocks("o.n", "o.size").alias("outer"))
    rows = own.join(top, "key").withColumn("is_main", F.col("comp") == F.col("main"))
    k = F.when(F.col("is_main"), part_of("inner")).otherwise(part_of("outer"))
    rows = rows.withColumn("k", k)
    others = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda j: F.struct(F.least("k", j).alias("x"), F.greatest("k", j).alias("y"), F.when(j == F.col("k"), 2).when(j > F.col("k"), 0).otherwise(1).alias("side")))
    mains = F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda j: F.struct(F.col("k").alias("x"), (-1 - j).alias("y"), F.lit(0).alias("side")))
    to = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("side"))))
    to = to.when(F.col("is_main"), F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda i: F.struct(i.alias("x"), (-1 - F.col("k")).alias("y"), F.lit(1).alias("side"))))
    rows = rows.withColumn("to", F.explode(to.otherwise(F.concat(others, mains))))
    return rows.select(F.xxhash64("key", "to.x", "to.y").alias("cell"), "rep", "comp", F.col("to.side").alias("side"), (F.col("rep") == F.col("lead")).alias("lead"), F.col("key").bitwiseAND(63).cast("int").alias("band"))


def components(scratch: common.Scratch, links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of ``links`` (a, b)."""
    edges = scratch.table(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup-edges")
    labels = scratch.table(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "neardup-labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = scratch.table(new.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "neardup-labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def single(docs: DataFrame, key: str) -> bool:
    """Whether every row has a whole number of its own as key."""
    if docs.schema[key].dataType.simpleString() not in {"tinyint", "smallint", "int", "bigint"}:
        return False
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty()


def numbered(scratch: common.Scratch, docs: DataFrame) -> DataFrame:
    """The rows, written with a number of their own: _row."""
    return scratch.table(docs.withColumn("_row", F.monotonically_increasing_id()), "neardup-numbered")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (smallest id of its class), for every row."""
    if single(docs, key):
        return grouped(docs, key, text)
    spark = docs.sparkSession
    with common.Scratch(spark) as scratch:
        rows = numbered(scratch, docs.select(key, text))
        of = scratch.table(rows.select("_row", key).join(grouped(rows, "_row", text), "_row"), "neardup-of")
        least = of.groupBy("class_id").agg(F.min(key).alias("least"))
        return common.as_table(spark, of.join(least, "class_id").select(key, F.col("least").alias("class_id")), "neardup-classes")


def grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``classes`` of rows with a number each.  Its own tables are gone when it returns, but for the result."""
    spark = docs.sparkSession
    with common.Scratch(spark) as scratch:
        shared = spark.sparkContext.broadcast(frequencies(docs, text))  # 4 MB
        table = scratch.table(sketch(docs, shared, key, text), "neardup-sketches")
        # one representative per distinct text
        reps = table.groupBy("digest").agg(F.min("k").cast("long").alias("rep"), F.first("samples").alias("samples"), F.first("size").alias("size"))
        reps = scratch.table(reps, "neardup-reps")
        members = buckets(scratch, reps)
        met = scratch.table(members.select("rep").distinct(), "neardup-met")
        one = only(docs.select(F.col(key).cast("long").alias("rep"), F.coalesce(text, F.lit("")).alias("text")), "rep", met, True)
        texts = scratch.table(one.join(reps.select("rep", "size", "samples").join(met, "rep", "left_semi"), "rep"), "neardup-texts")
        links = scratch.table(compared(stars(members, texts), texts, shared), "neardup-links")
        cells = scratch.table(borders(scratch, members, components(scratch, links), texts), "neardup-cells")
        more = scratch.table(compared(cells, texts, shared), "neardup-links")
        label = components(scratch, links.unionAll(more).distinct())
        of = reps.select("digest", "rep").join(label, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("class_id"))
        out = common.as_table(spark, table.select(F.col("k").alias(key), "digest").join(of, "digest").drop("digest"), "neardup-classes")
        shared.unpersist()
        return out


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that of its smallest id.  A row with a null id stays if its class has no other."""
    spark = docs.sparkSession
    if single(docs, key):
        copies = grouped(docs, key, text).where(F.col("class_id") != F.col(key)).select(key)
        return only(docs, key, common.as_table(spark, copies, "neardup-copies"), False)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = common.as_table(spark, docs.select(own, F.monotonically_increasing_id().alias("row")), "neardup-numbered")
    id_of, text_of = (F.col(f"doc.`{c}`") for c in (key, text))
    of = rows.select("row", id_of.alias("id")).join(grouped(rows.select("row", text_of.alias("text")), "row", "text"), "row")
    first = of.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m"))
    return rows.join(first.select("m.row"), "row", "left_semi").select("doc.*")


def op10_icws_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents"))
