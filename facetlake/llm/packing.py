"""Lexical retrieval packing: windows filled by the BM25 neighbours of their first document.

Documents are dealt into shards by what they say: four minima of weighted min-wise hashing over their terms make a
place, and documents are range-partitioned and sorted by it, so that texts which share rare terms lie side by side (two
texts agree in a minimum with the probability of their weighted Jaccard similarity).  A term weighs its number in the
vocabulary, where rarer ones come later: that needs no statistics, and it brings more neighbours together than idf does.  Rows of one place are
spread by hash, so repeated texts fill many partitions.  Each partition is cut into shards of bounded size in that
order.  A shard builds an inverted index over its own documents (terms are token ids, so the statistics of the whole
corpus are one vector of the vocabulary's size) and packs them: the first unused document is a window's seed, all of
its terms are looked up, the unused documents fill the window by score, best first, and the one that does not fit is
cut and its rest goes into the next window.  Documents that share no term with the seed follow in shard order.  A
window goes on from shard to shard, so only a partition's last one is padded.

A seed meets its own shard only: BM25 neighbours that lie elsewhere are not found (README has the measured recall).

Defined results.  Null text: the end id alone.  Null or repeated doc_id: each row is a document of its own.
An empty table gives no rows.  Other columns are ignored.  Equal scores: the earlier document of the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
VOCABULARY = 1 << 16
#: Terms in at least one of so many documents of a shard are kept as rows, which have at most so many numbers a posting.
FREQUENT = 8


class Index:
    """BM25 inverted index of one shard: frequent terms as rows of weights by document, others as postings sorted by term."""

    def __init__(self, docs: list[np.ndarray], frequency: np.ndarray, n_docs: int, mean_length: float):
        self.n = n = len(docs)
        lens = np.fromiter(map(len, docs), np.int64, n)
        kind, bits = (np.uint32, 16) if n <= 1 << 16 else (np.uint64, 32)  # short keys sort faster
        flat = np.concatenate([*docs, np.zeros(0, np.uint16)])
        key, tf = np.unique(flat.astype(kind) << kind(bits) | np.repeat(np.arange(n, dtype=kind), lens), return_counts=True)
        term, doc = (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64)
        idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
        norm = K1 * (1 - B + B * lens / max(mean_length, 1))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        held = np.bincount(term, minlength=VOCABULARY)
        frequent = held * FREQUENT >= max(n, 1)
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.rows = np.zeros((np.count_nonzero(frequent), n))
        row = self.row[term]
        at, rest = np.flatnonzero(row >= 0), row < 0
        self.rows[row[at], doc[at]] = weight[at]
        self.doc, self.weight = doc[rest], weight[rest]
        self.first = np.concatenate([[0], np.cumsum(np.where(frequent, 0, held))])
        order = np.argsort(doc.astype(np.uint16) if n <= 1 << 16 else doc, kind="stable")
        self.terms = np.split(term[order], np.cumsum(np.bincount(doc, minlength=n))[:-1])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of each document for the distinct terms of ``seed``."""
        t = self.terms[seed]
        row = self.row[t]
        t = t[row < 0]
        lens = self.first[t + 1] - self.first[t]
        at = np.repeat(self.first[t] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n) + np.add.reduce(self.rows.take(row[row >= 0], axis=0), axis=0)


class Packer:
    """Fills windows shard by shard; the open window goes on in the next shard."""

    def __init__(self, window: int):
        self.window, self.at, self.number = window, 0, 0

    def pack(self, docs: list[np.ndarray], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, window, offset) of each piece."""
        if not len(docs):
            return
        used = np.zeros(len(docs), bool)
        following = 0
        scores = np.zeros(len(docs))  # of unused documents for the window's seed
        while True:
            doc = int(scores.argmax())  # the first of equal ones
            if scores[doc] <= 0:
                while following < len(docs) and used[following]:
                    following += 1
                if following == len(docs):
                    return
                doc = following
            used[doc], scores[doc] = True, 0
            start = 0
            while start < len(docs[doc]):
                left = len(docs[doc]) - start
                if self.at == 0:  # this document, or its rest, opens a window; one that fills it needs no neighbours
                    scores = np.where(used, 0, index.scores(doc)) if left < self.window else np.zeros(len(docs))
                length = min(self.window - self.at, left)
                yield doc, start, length, self.number, self.at
                start, self.at = start + length, self.at + length
                if self.at == self.window:
                    self.at, self.number = 0, self.number + 1


def places(terms: list[np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """Place of each document: the least rank of its terms under each of four orders, as one number."""
    flat, lens = np.concatenate(terms), np.fromiter(map(len, terms), np.int64, len(terms))
    first = np.cumsum(lens) - lens
    out = np.zeros(len(terms), np.uint64)
    for r in ranks:
        out = out << np.uint64(16) | np.minimum.reduceat(r[flat], first).astype(np.uint64)
    return (out >> np.uint64(1)).view(np.int64)


def orders() -> np.ndarray:
    """Four orders of all terms, by exponential draws divided by the term's number: ranks of 16 bits."""
    draws = np.random.default_rng(5).exponential(size=(4, VOCABULARY)) / np.arange(1, VOCABULARY + 1)
    return np.argsort(np.argsort(draws, axis=1), axis=1).astype(np.uint16)


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1, window: int = 2048,
    shard_docs: int = 512, shard_bytes: int = 4 << 20, task_bytes: int = 16 << 20, task_docs: int = 2048,
) -> DataFrame:
    """Pieces of sequences: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint16)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc, end, ranks = encoder(tokenizer), np.array([end_id], np.uint16), orders()
        names = ["k", "place", "ids", "statistics"]
        frequency, tokens, n = np.zeros(VOCABULARY, np.int64), 0, 0
        key_type, last, steps = None, np.zeros(VOCABULARY, np.int32), np.zeros(0, np.int32)
        for batch in batches:
            key_type = batch.column(0).type
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [np.concatenate([x, end]) for x in enc.encode(part.column(1))]
                longest = max(map(len, ids))
                steps = np.arange(longest, dtype=np.int32) if longest > len(steps) else steps
                terms = []
                for x in ids:
                    own, step = x.astype(np.int64), steps[: len(x)]
                    last[own] = step
                    terms.append(own[last[own] == step])  # each term at its last place
                frequency += np.bincount(np.concatenate(terms), minlength=VOCABULARY)
                tokens, n = tokens + sum(map(len, ids)), n + len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(places(terms, ranks)), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if n:  # this task's share of the corpus statistics
            blob = np.concatenate([frequency, [tokens, n]]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([blob], pa.binary())], names)

    table = common.as_table(spark, docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(encode, f"k {kind}, place long, ids binary, statistics binary"), "packing-ids")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY + 2, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.frombuffer(blob, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    # one vector of fixed size from every task, added up in each partition and then here
    partial = table.where("statistics is not null").select(F.col("statistics").alias("blob")).mapInArrow(add, "blob binary")
    statistics = np.zeros(VOCABULARY + 2, np.int64)
    for row in partial.toLocalIterator():
        statistics += np.frombuffer(row["blob"], np.int64)
    frequency, tokens, n_docs = statistics[:VOCABULARY], int(statistics[-2]), int(statistics[-1])
    shared = spark.sparkContext.broadcast(frequency)  # 512 KB whatever the corpus

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = Packer(window), TaskContext.get().partitionId() << 40

        def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(parts).combine_chunks()
            ids = [np.frombuffer(x, np.uint16) for x in part.column("ids").to_pylist()]
            rows = packer.pack(ids, Index(ids, shared.value, n_docs, tokens / max(n_docs, 1)))
            doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*rows))
            pieces = [ids[d][s : s + m] for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist())]
            out = {
                "k": part.column("k").combine_chunks().take(pa.array(doc)), "start": start, "length": length, "ids_crc32": [zlib.crc32(p.astype("<u4").tobytes()) for p in pieces],
                "doc_tokens": np.fromiter(map(len, ids), np.int64, len(ids))[doc], "sequence_id": base + seq, "offset": offset, "ids": pa.array([p.tobytes() for p in pieces], pa.binary()),
            }
            return pa.record_batch({c: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for c, v in out.items()})

        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("ids")).to_numpy()
            lo = 0
            for n, own in enumerate(sizes.tolist()):
                if rows and (rows == shard_docs or size + own > shard_bytes):
                    yield shard([*held, batch.slice(lo, n - lo)])
                    held, rows, size, lo = [], 0, 0, n
                rows, size = rows + 1, size + own
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
        if rows:
            yield shard(held)
        pa.default_memory_pool().release_unused()

    # equal places (copies) are spread by hash
    placed = table.where("ids is not null").select("place", "k", "ids")
    tasks = max(1, -(-2 * tokens // task_bytes), -(-n_docs // task_docs))  # long texts lie together, so both are bounded
    placed = placed.withColumn("tie", F.xxhash64("k", "ids")).repartitionByRange(tasks, "place", "tie").sortWithinPartitions("place", "tie", "k").drop("tie")
    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(fill, schema).withColumnRenamed("k", key)


def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
