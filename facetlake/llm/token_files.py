"""Token-id files: one flat id array per file, document boundaries and ids as Elias-Fano sequences.

File: ids (little-endian uint16), the two Elias-Fano blocks, a footer.  A sequence of n values up to u takes
n * (2 + log2(u / n)) bits: low bits packed, high bits unary, and a 32-bit sample for every 256th value that
select() starts from.  There is no 64-bit offset table.

Defined results.  Null text: the end id alone.  Null doc_id: such rows come first.  Repeated ids keep a row each,
in text order.  An empty table gives no files and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 256
FOOTER = struct.Struct("<8sQQQQQq")
MAGIC = b"EFTOKEN1"


class EliasFano:
    """A non-decreasing sequence of integers from 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.cumsum(POP[high], dtype=np.int64)
        self.samples = np.searchsorted(ones, np.arange(0, n, SAMPLE), side="right").astype(np.uint32)  # byte that holds each
        self.before = np.concatenate([[0], ones])[self.samples].astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        k = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if k:
            bits = (v[:, None] >> np.arange(k, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little")
        where = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(where[-1]) // 8 + 1) if n else 0, np.uint8)
        np.bitwise_or.at(high, where // 8, (1 << (where % 8)).astype(np.uint8))
        return cls(n, k, low, high)

    def select(self, i: int) -> int:
        """The i-th value: from its sample, over the unary bits, to its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, left = int(self.samples[i // SAMPLE]), i - int(self.before[i // SAMPLE])
        while (c := int(POP[self.high[byte]])) <= left:
            left, byte = left - c, byte + 1
        bit = int(np.flatnonzero(self.high[byte] >> np.arange(8) & 1)[left])
        value = byte * 8 + bit - i << self.low_bits
        at = i * self.low_bits
        for b in range(self.low_bits):
            value |= int(self.low[(at + b) // 8] >> ((at + b) % 8) & 1) << b
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values start..stop-1, decoded together."""
        if start >= stop:
            return np.zeros(0, np.int64)
        byte, before = int(self.samples[start // SAMPLE]), int(self.before[start // SAMPLE])
        last = int(self.samples[(stop - 1) // SAMPLE])
        end = int(self.samples[(stop - 1) // SAMPLE + 1]) + 1 if (stop - 1) // SAMPLE + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte : max(end, last + 1)], bitorder="little")) + byte * 8
        i = np.arange(start, stop)
        value = ones[start - before : stop - before] - i << self.low_bits
        if k := self.low_bits:
            first = start * k // 8
            bits = np.unpackbits(self.low[first : (stop * k + 7) // 8], bitorder="little")[start * k - first * 8 :][: len(i) * k]
            value |= (bits.reshape(-1, k).astype(np.int64) << np.arange(k)).sum(1)
        return value

    def dump(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> "EliasFano":
        n, k, a, b = struct.unpack_from("<QQQQ", raw)
        return cls(n, k, np.frombuffer(raw, np.uint8, a, 32), np.frombuffer(raw, np.uint8, b, 32 + a))


POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


def open_at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, batches: Iterator[tuple[list, list[np.ndarray]]]) -> tuple[int, int]:
    """Documents in ascending id order (None first) and their ids; returns (documents, ids)."""
    system, path = open_at(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    keys: list = []
    ends = [np.zeros(1, np.int64)]
    total = 0
    with system.open_output_stream(path) as out:
        for some, arrays in batches:
            keys += some
            lens = np.fromiter(map(len, arrays), np.int64, len(arrays))
            ends.append(total + np.cumsum(lens))
            total = int(ends[-1][-1]) if len(lens) else total
            out.write(b"".join(a.astype("<u2", copy=False).tobytes() for a in arrays))
        known = [k for k in keys if k is not None]
        least = min(known, default=0)
        bounds = EliasFano.of(np.concatenate(ends)).dump()
        ids = EliasFano.of(np.array([k - least for k in known], np.uint64)).dump()
        out.write(bounds + ids + FOOTER.pack(MAGIC, len(keys), total, len(bounds), len(ids), len(keys) - len(known), least))
    return len(keys), total


def read_file(uri: str, at_once: int = 4 << 20) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Batches of (document ids, boundaries, token ids); boundaries count from the file's start."""
    system, path = open_at(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        f.seek(size - FOOTER.size)
        magic, docs, total, a, b, nulls, least = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        f.seek(size - FOOTER.size - a - b)
        bounds, keys = EliasFano.load(f.read(a)), EliasFano.load(f.read(b))
        at = 0
        while at < docs:
            first = bounds.select(at)
            end = at + 1
            while end < docs and end - at < 4096 and bounds.select(end + 1) - first <= at_once:
                end = min(docs, end + max(1, (end - at) // 2))
            cuts = bounds.slice(at, end + 1)
            f.seek(2 * first)
            ids = np.frombuffer(f.read(2 * int(cuts[-1] - first)), "<u2")
            names = [None] * max(0, min(end, nulls) - at) + (keys.slice(max(at, nulls) - nulls, end - nulls) + least).tolist()
            yield names, cuts, ids
            at = end


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1) -> DataFrame:
    """Write the token files of a range of ids per task and return their manifest (a table in the shared folder)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc, end = encoder(tokenizer), np.array([end_id], np.uint16)
        first = next(batches, None)
        if first is None:
            return

        def encoded() -> Iterator[tuple[list, list[np.ndarray]]]:
            nonlocal first
            batch = first
            first = None
            while batch is not None:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    ids = enc.encode(part.column(1))
                    yield part.column(0).to_pylist(), [np.concatenate([x, end]) for x in ids]
                batch = next(batches, None)

        part = TaskContext.get().partitionId()
        uri = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.eft"  # an attempt that fails leaves a file no manifest names
        n, total = write_file(uri, encoded())
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [uri], "n_docs": [n], "n_ids": [total]})

    spark = docs.sparkSession
    ranged = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    return common.as_table(spark, ranged.mapInArrow(run, "part long, file string, n_docs long, n_ids long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, base in zip(pdf["file"], pdf["base"]):
                for names, cuts, ids in read_file(uri):
                    wide = ids.astype("<u4")
                    local = cuts - cuts[0]
                    view = memoryview(wide).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(local[:-1].tolist(), local[1:].tolist())]
                    yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "start": cuts[:-1] + base, "n_tokens": np.diff(cuts), "ids_crc32": crc})

    files = manifest.withColumn("base", before).select("file", "base").repartition(max(1, manifest.count()))
    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_elias_fano_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents")
    return read(write(docs, common.new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")))
