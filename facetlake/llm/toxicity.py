"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the distinct words of a text, and over how many of them begin alike, is trained from confirmed toxic
texts and unlabelled ones.  Its loss is the non-negative risk estimator with sigmoid loss: with the share of toxic texts
(class prior) p, the risk on clean texts is the one on unlabelled texts less p times the one of toxic texts taken as clean;
where that difference falls below zero, the step goes up its slope instead of down.  Folds of the training texts give one
model each, and scores of the texts that it has not seen; the cut is that of least estimated zero-one risk on these scores.
The mean of the models is the classifier, and its score is 0.7 at the cut.

Marks (words and beginnings) enter the model if so many toxic texts hold them that, at their rate in unlabelled texts, less
than one mark in all would do so by chance.  Near copies in the sample count once.

Training takes a bounded sample of whole texts (at most ``max_positive`` and ``max_unlabelled``, about ``max_bytes``), drawn
by hashes; everything else covers all rows.  The class prior is the share of toxic among the labelled training rows, unless
it is given; clean labels have no other use.

Defined results.  A null or empty text has no mark and scores what the model gives to none.  A null label is none.  A null
id is no held-out row and meets no label; of several labels of an id the largest counts.  Repeated ids and rows stay.
Without toxic training rows all score 0.  Extra columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum, lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = re.compile(r"\w+").findall
#: A score at or above this predicts toxic.
PREDICTS = 0.7
#: Lengths of the beginnings of words that are marks.
BEGIN = (4, 5, 6, 7)


def words_of(text: str | None) -> set[str]:
    return set(WORDS(text.lower())) if text else set()


def rows_of(texts: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, their numbers text by text, cuts between texts) of lists of words."""
    lists = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    coded = lists.flatten().dictionary_encode()
    cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), cuts


def sketches(words: list[str], ids: np.ndarray, cuts: np.ndarray, bands: int = 4, rows: int = 4) -> np.ndarray:
    """Min-wise hashes of each text's words; near copies agree in one band of ``rows`` at least."""
    codes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    draw = np.random.default_rng(0)
    out = np.zeros((len(cuts) - 1, bands * rows), np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    for k, (a, b) in enumerate(draw.integers(1, 1 << 61, (bands * rows, 2), np.uint64)):
        if len(full):
            out[full, k] = np.minimum.reduceat((codes * (a | np.uint64(1)) + b >> np.uint64(24))[ids], cuts[full])
    return out


def firsts(signatures: np.ndarray, rows: int = 4) -> np.ndarray:
    """In the order of the signatures, the texts that share no band with an earlier one."""
    seen: set = set()
    keep = []
    for r in np.lexsort(signatures.T[::-1]):
        bands = {(k, *signatures[r, k : k + rows].tolist()) for k in range(0, signatures.shape[1], rows)}
        if not seen & bands:
            keep.append(r)
        seen |= bands
    return np.array(keep, np.int64)


def beginnings(word: str) -> list[str]:
    return ["^" + word[:k] for k in BEGIN if len(word) >= k]


@dataclass
class Rows:
    """Texts as the numbers of their marks, one after the other; a number stands as often as its text has the mark."""

    ids: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), np.cumsum([0, *map(len, lists)]))

    def take(self, rows: np.ndarray) -> Rows:
        return Rows.of([self.ids[self.cuts[r] : self.cuts[r + 1]] for r in rows])

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.ids])])
        return sums[self.cuts[1:]] - sums[self.cuts[:-1]] + bias

    def spread(self, slope: np.ndarray, size: int) -> np.ndarray:
        """Sum of a slope per text over the texts that hold each word."""
        return np.bincount(self.ids, np.repeat(slope, np.diff(self.cuts)), size)

    def __len__(self) -> int:
        return len(self.cuts) - 1


def sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk on toxic texts, estimated risk on clean ones) of scores under sigmoid loss; the second may fall below zero."""
    return prior * sigmoid(-positive).mean(), sigmoid(unlabelled).mean() - prior * sigmoid(positive).mean()


def train(positive: Rows, unlabelled: Rows, size: int, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, by Adam over all rows; few toxic texts hold the weights back more
    (``decay`` over their number)."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    decay /= n_p
    for t in range(1, rounds + 1):
        p, u = sigmoid(positive.scores(w[:-1], w[-1])), sigmoid(unlabelled.scores(w[:-1], w[-1]))
        s_p, s_u = prior * p * (1 - p) / n_p, u * (1 - u) / n_u
        if u.mean() - prior * p.mean() >= 0:
            a_p, a_u = -2 * s_p, s_u  # down both risks
        else:
            a_p, a_u = s_p, -s_u  # back up the risk on clean texts
        slope = np.append(positive.spread(a_p, size) + unlabelled.spread(a_u, size) + decay * w[:-1], a_p.sum() + a_u.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Cut of least estimated zero-one risk (missed toxic texts and clean ones hit); of equal ones the middle of the widest gap."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    mids = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    width = np.concatenate([[0.0], np.diff(at), [0.0]])
    p = 1 - np.searchsorted(np.sort(positive), mids) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), mids) / len(unlabelled)
    cost = u - 2 * prior * p
    least = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(mids[least[np.argmax(width[least])]])


def fit(positive: Rows, unlabelled: Rows, size: int, prior: float, folds: int = 3, **how) -> tuple[np.ndarray, float]:
    """Weights, and bias less cut, of the mean of the folds' models; the cut is taken from each fold's own scores of rows it has not seen."""
    weights, bias, unseen = np.zeros(size), 0.0, ([], [])
    for k in range(folds):
        models = [r.take(np.flatnonzero(np.arange(len(r)) % folds != k)) for r in (positive, unlabelled)]
        w, b = train(*models, size, prior, **how)
        for scores, r in zip(unseen, (positive, unlabelled)):
            scores.append(r.take(np.flatnonzero(np.arange(len(r)) % folds == k)).scores(w, b))
        weights, bias = weights + w / folds, bias + b / folds
    return weights, bias - best_cut(*map(np.concatenate, unseen), prior)


def chance(k: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
    """Probability of at least k among n at a rate, all far above it: the first term of the tail, bounded as a series."""
    places = np.array([lgamma(x + 1) for x in range(n + 1)])
    first = np.exp(places[n] - places[k] - places[n - k] + k * np.log(rate) + (n - k) * np.log1p(-rate))
    ratio = (n - k) / (k + 1) * rate / (1 - rate)
    return first / (1 - np.minimum(ratio, 0.999))


def learn(texts: pa.Table, prior: float, **how) -> tuple[dict[str, float], float]:
    """(weight of each mark, bias less cut) from a table (words, positive) of sampled texts."""
    words, ids, cuts = rows_of(texts["words"])
    signs = np.asarray(texts["positive"].to_numpy(), bool)
    signatures = sketches(words, ids, cuts)
    kinds = []
    for side in (True, False):
        rows = np.flatnonzero(signs == side)
        kinds.append(rows[firsts(signatures[rows])])
    if not len(kinds[0]) or not len(kinds[1]):
        return {}, -np.inf
    numbers: dict[str, int] = {}  # of all marks
    of_word = [[numbers.setdefault(m, len(numbers)) for m in (w, *beginnings(w))] for w in words]
    length = np.array([len(m) for m in of_word], np.int64)
    flat, begin = np.array([m for marks in of_word for m in marks], np.int64), np.concatenate([[0], np.cumsum(length)])

    def marks(row: int) -> np.ndarray:
        mine = ids[cuts[row] : cuts[row + 1]]
        many = length[mine]
        return flat[np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(mine) else mine

    held = [np.zeros(len(numbers), np.int64) for _ in kinds]
    for count, rows in zip(held, kinds):
        for r in rows:
            count[np.unique(marks(r))] += 1
    n_p, n_u = len(kinds[0]), len(kinds[1])
    asked = np.flatnonzero(held[0] >= 2)
    rate = (held[1][asked] + 1) / (n_u + 2)
    lifted = asked[held[0][asked] > 2 * n_p * rate]
    k, rate = held[0][lifted], (held[1][lifted] + 1) / (n_u + 2)
    chosen = lifted[chance(k, n_p, rate) * len(asked) <= 1]
    place = np.full(len(numbers), -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def kept(rows: np.ndarray) -> Rows:
        return Rows.of([x[x >= 0] for x in (place[marks(r)] for r in rows)])

    weights, bias = fit(kept(kinds[0]), kept(kinds[1]), len(chosen), prior, **how)
    names = list(numbers)
    return {names[m]: float(w) for m, w in zip(chosen, weights)}, bias


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, text: str, key: str, max_positive: int, max_unlabelled: int, max_bytes: int) -> tuple[pa.Table, float]:
    """((words, positive) of the sampled training texts, share of toxic among labelled training rows)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([pa.array([sorted(words_of(t.as_py())) for t in part.column(0)], pa.list_(pa.string())), part.column(1)], ["words", "positive"])

    marked = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias("_k")).agg(F.max("toxic").alias("_y"))
    known = marked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("y")).first()
    mine = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"), (~held_out(key)).alias("_train")).where("_train")
    there = mine.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_t")), F.lit(0)).alias("b")).first()
    by_bytes = max_bytes / max(1, there["b"] / max(1, there["n"]))  # texts of mean size

    def drawn(seed: int, most: int, of: int) -> Column:
        """About nine tenths of ``most`` rows, or all; a limit holds where ids repeat."""
        return F.xxhash64(F.col("_k"), F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1)) < int(min(1.0, 0.9 * min(most, by_bytes) / max(1, of)) * (1 << 40))

    toxic = marked.where((F.col("_y") == 1) & drawn(1, max_positive, known["y"])).select("_k").limit(max_positive)
    positive = mine.join(F.broadcast(toxic), "_k").select("_t", F.lit(True).alias("positive"))
    unlabelled = mine.where(drawn(2, max_unlabelled, there["n"])).select("_t", F.lit(False).alias("positive"))
    made = "words array<string>, positive boolean"
    rows = positive.mapInArrow(split, made).limit(max_positive).unionAll(unlabelled.mapInArrow(split, made).limit(max_unlabelled))
    return rows.toArrow(), (known["y"] / known["n"] if known["n"] else 0.0)


def scored(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", prior: float | None = None,
    max_positive: int = 4000, max_unlabelled: int = 12000, max_bytes: int = 64_000_000,
) -> DataFrame:
    """Row per row of ``docs``: key, held_out, score of its whole text.  Scoring is map-only."""
    texts, share = sample(docs, labels, text, key, max_positive, max_unlabelled, max_bytes)
    weights, bias = learn(texts, share if prior is None else prior)
    get, heads = weights.get, {k: {m[1:]: w for m, w in weights.items() if m[0] == "^" and len(m) == k + 1} for k in BEGIN}
    shift = bias + log(PREDICTS / (1 - PREDICTS))

    def score(t: str | None) -> float:
        words = words_of(t)
        found = [get(w) for w in words & weights.keys()]
        for k, marks in heads.items():
            found += [marks[w[:k]] for w in words if w[:k] in marks]
        return fsum(found)  # in any order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([score(t.as_py()) for t in batch.column(1)]) + shift
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sigmoid(z), pa.float64())], [key, "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text), held_out(key).alias("held_out")).mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double")


def op11_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scored(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return got.withColumn("predicted", (F.col("score") >= PREDICTS).cast("int"))
