"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A leaf holds ``rank << SHIFT | position`` of the pair that starts at a symbol, a node the smaller of its
children, so the root is the lowest-ranked pair and among equals the leftmost.  One merge rewrites three leaves
and their paths: a word of n symbols takes O(n log n) however long it is.  Words of up to 64 symbols run many
at a time as rows of NumPy arrays; longer ones run one by one on flat lists, by the same tree.

Defined results.  Null text: no tokens, empty decoded text.  Repeated rows: a row each.  Null ids pass through.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

SHIFT = 32
NONE = 1 << 62
CACHE = 250_000
_open: dict = {}


def byte_alphabet() -> list[str]:
    """Character of each byte: itself where printable, else the next free one from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(free)) for b in range(256)]


class Merges:
    """Ranks of symbol pairs as a sorted array."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array(made, np.int64)
        self.of = {k: r for r, k in enumerate(keys.tolist())}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE where the pair never merges; a negative symbol stands for the end of a word."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.ranks[at], NONE)

    def long(self, symbols: list[int]) -> list[int]:
        """One word of any length."""
        n = len(symbols)
        size = 1 << max(0, (n - 1).bit_length())
        of, made, sym = self.of, self.made, list(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [NONE] * (2 * size)

        def leaf(i: int) -> int:
            j = after[i]
            r = of.get(sym[i] << 32 | sym[j]) if j >= 0 else None
            return NONE if r is None else r << SHIFT | i

        tree[size : size + n] = map(leaf, range(n))
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    return
                tree[k] = low

        while tree[1] < NONE:
            i = tree[1] & ((1 << SHIFT) - 1)
            j = after[i]
            sym[i] = int(made[tree[1] >> SHIFT])
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            sym[j] = -1
            put(j, NONE)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [s for s in sym if s >= 0]

    def rows(self, words: list[list[int]]) -> list[list[int]]:
        """Words of the same power of two of symbols, together."""
        size = 1 << max(1, (max(map(len, words)) - 1).bit_length())
        sym = np.full((len(words), size + 1), -1, np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym[:, :size][np.arange(size) < lens[:, None]] = np.concatenate([np.asarray(w, np.int64) for w in words])
        pos = np.arange(size)
        after = np.where(pos + 1 < lens[:, None], pos + 1, size)
        before = np.broadcast_to(np.where(pos > 0, pos - 1, size), after.shape).copy()
        after = np.concatenate([after, np.full((len(words), 1), size)], 1)
        before = np.concatenate([before, np.full((len(words), 1), size)], 1)
        tree = np.full((len(words), 2 * size), NONE, np.int64)
        r = self.rank(sym[:, :-1], sym[:, 1:])
        tree[:, size:] = np.where((r < NONE) & (sym[:, :-1] >= 0), r << SHIFT | pos, NONE)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        width, span = size + 1, 2 * size
        fs, fa, fb, ft = sym.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            base, stem = live * width, live * span
            root = ft[stem + 1]
            i = root & ((1 << SHIFT) - 1)
            here = base + i
            j = fa[here]
            k, h = fa[base + j], fb[here]
            made = self.made[root >> SHIFT]
            fs[here] = made
            fs[base + j] = -1
            fa[here] = k
            fb[base + k] = i  # position `size` takes the writes of words that end here
            fs[base + size] = -1
            new = self.rank(np.concatenate([made, fs[base + h]]), np.concatenate([fs[base + k], made]))
            first = h == size
            value = np.where(new < NONE, new << SHIFT | np.concatenate([i, h]), NONE)
            value[len(live) :][first] = NONE
            node = np.concatenate([i, np.where(first, j, h), j]) + size
            stems = np.concatenate([stem, stem, stem])
            ft[stems + node] = np.concatenate([value, np.full(len(live), NONE)])
            level = size
            while level > 1:
                node >>= 1
                level >>= 1
                low = stems + 2 * node
                ft[stems + node] = np.minimum(ft[low], ft[low + 1])
            live = live[ft[stem + 1] < NONE]
        return [s[s >= 0].tolist() for s in sym[:, :size]]

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        out: list = [w for w in words]
        groups: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            if len(w) > 64:
                out[n] = self.long(w)
            elif len(w) > 1:
                groups.setdefault((len(w) - 1).bit_length(), []).append(n)
        for members in groups.values():
            for at in range(0, len(members), 1024):
                part = members[at : at + 1024]
                for n, ids in zip(part, self.rows([words[n] for n in part])):
                    out[n] = ids
        return out


class WordBpe:
    """A ``tokenizers`` BPE file: its normalizer, pre-tokens, merges and (space-joining) decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.end = spec["model"]["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        #: The library's white space; str.split() would also cut at the separators U+001C to U+001F.
        self.chunks = regex.compile(r"[^\s]+").findall
        self.odd = regex.compile("[\x1c-\x1f]").search
        self.known: dict[str, tuple[str, str]] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case of each character by itself (no final sigma)."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def symbols(self, pretoken: str) -> list[int]:
        raw = pretoken.encode("utf-8", "surrogatepass")
        return [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]

    def learn(self, new: list[str]) -> dict[str, tuple[str, str]]:
        """Decimal ids and decoded tokens of chunks, each as one string."""
        parts = [self.split(self.normal(c)) for c in new]
        words = list({w for p in parts for w in p})
        ids = dict(zip(words, self.merges.merge([self.symbols(w) for w in words])))
        out, names = {}, self.names
        for c, p in zip(new, parts):
            got = [i for w in p for i in ids[w]]
            out[c] = (" ".join(map(str, got)), " ".join([names[i] for i in got]))
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, decimal ids joined by a space, decoded text) per text."""
        pieces = []
        for t in texts:
            rows: list = []
            for k, piece in enumerate(self.cut.split(t) if self.cut else [t]):
                if k % 2:
                    rows.append(piece)
                else:
                    rows.extend(self.chunks(piece) if self.odd(piece) else piece.split())
            pieces.append(rows)
        known = self.known
        new = list({c for rows in pieces for c in rows if c not in known})
        learnt: dict[str, tuple[str, str]] = {}
        for at in range(0, len(new), 65536):
            learnt.update(self.learn([c for c in new[at : at + 65536] if c not in self.special]))
        learnt.update({s: (str(i), s) for s, i in self.special.items()})
        if len(known) + len(learnt) <= CACHE:
            known.update(learnt)
            learnt = known
        for rows in pieces:
            got = [known.get(c) or learnt[c] for c in rows]
            ids = " ".join([a for a, _ in got if a])
            yield (ids.count(" ") + 1 if ids else 0, ids, " ".join([b for a, b in got if a]))


def opened(path: str) -> WordBpe:
    if path not in _open:
        _open[path] = WordBpe(path)
    return _open[path]


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", batch_chars: int = 2_000_000) -> DataFrame:
    """Row per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256 of its whole text.  Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at, rows = 0, []
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_chars):
                    size += len(texts[end])
                    end += 1
                rows += [(n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for n, i, d in bpe.encode(texts[at:end])]
                at = end
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
