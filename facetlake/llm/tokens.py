"""Whole-text token ids of a ``tokenizers`` file, fast enough for one pass over a corpus.

Byte-level files are read by ``byte_level``.  For others: pre-tokens never cross the chunk borders used here, so a text's
ids are its chunks' ids in a row.  Each distinct chunk goes through the library once and is then remembered, up to ``CACHE``
chunks per Python worker.  Arrow splits a batch of texts and numbers its distinct chunks, so only these meet the dictionary.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import byte_level, common

CACHE = 500_000
#: Bytes of text that are gathered at once.
BATCH_BYTES = 2 << 20
#: Texts that have such go through the library whole: white space other than single spaces and one or two line feeds, and
#: control sign 1.
ODD = r"[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]|  | \n|\n |\n\n\n|\n\n\z| \z"
TAIL = ".,;:!?|*#$%&\""
_open: dict = common.memory()


def encoder(path: str) -> "Encoder":
    """One encoder per file and Python worker."""
    if path not in common.turn_to(_open):
        _open[path] = Encoder(path)
    return _open[path]


class Encoder:
    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.pieces = byte_level.Pieces(self.lib, spec) if byte_level.fits(spec) else None
        self.odd = "|".join([ODD, *(re.escape(x) for x in self.specials)]) if self.pieces or spec["normalizer"] else ""  # "": all
        #: Number of each chunk.
        self.known: dict[str, int] = {}
        #: Ids of all known chunks in a row, and where each chunk's begin.
        self.ids, self.first = np.zeros(0, np.uint16), np.zeros(1, np.int64)
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.covers = np.zeros(1 << 16, np.int64)
        for token, i in vocab.items():
            self.covers[i] = len(token.removesuffix("</w>") if len(token) > 4 else token)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids as uint16 arrays, the same as the library's encode(text, add_special_tokens=False)."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        for n in np.flatnonzero(odd).tolist():
            out[n] = np.array(self.lib.encode(texts[n].as_py(), add_special_tokens=False).ids, np.uint16)
        at = np.flatnonzero(~odd)
        if len(at):
            plain = texts.take(pa.array(at)) if len(at) < len(texts) else texts
            gather = self.pieces.gather if self.pieces else self.gather
            size = np.cumsum(pc.binary_length(plain).to_numpy()) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                for n, ids in zip(at[lo:hi].tolist(), gather(plain.slice(lo, hi - lo))):
                    out[n] = ids
            pa.default_memory_pool().release_unused()  # Arrow's pool would hold on to freed buffers
        return out

    def gather(self, texts: pa.Array) -> list[np.ndarray]:
        known, base = self.known, len(self.known)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        of = words.offsets.to_numpy()
        chunks = words.values.slice(of[0], of[-1] - of[0]).dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(base, base + len(new))
            self.extend([names[n] for n in new.tolist()])
        codes = number[chunks.indices.to_numpy()]
        lens = self.first[codes + 1] - self.first[codes]
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = self.ids[np.repeat(self.first[codes] - ends[:-1], lens) + np.arange(ends[-1])]
        cuts = ends[of - of[0]].tolist()
        if len(known) > CACHE:  # frequent chunks come first, so a full cache keeps the useful ones
            for c in list(islice(known, base, None)):
                del known[c]
            self.first = self.first[: base + 1]
            self.ids = self.ids[: self.first[-1]]
        return [flat[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]

    def extend(self, fresh: list[str]) -> None:
        """Number new chunks in their order and learn them."""
        known, base = self.known, len(self.known)
        known.update(zip(fresh, range(base, base + len(fresh))))
        halves: dict[int, tuple[int, int]] = {}

        def number_of(chunk: str) -> int:
            n = known.setdefault(chunk, len(known))
            if n == base + len(fresh):
                fresh.append(chunk)
            return n

        for n, c in enumerate(fresh):  # grows by new halves
            # punctuation after a letter or digit starts a pre-token, so "word," is "word" and ","
            core = c.rstrip(TAIL)
            if len(core) != len(c) and core[-1:].isalnum() and len(core[-1].lower()) == 1:
                halves[n] = number_of(core), number_of(c[len(core) :])
        want = [n for n in range(len(fresh)) if n not in halves]
        raw: list[bytes] = [b""] * len(fresh)
        for k in range(0, len(want), 4096):
            part = want[k : k + 4096]
            for n, ids in zip(part, self.learn([fresh[n] for n in part])):
                raw[n] = ids

        def ids_of(n: int) -> bytes:
            n -= base
            if n < 0:
                return self.ids[self.first[n + base] : self.first[n + base + 1]].tobytes()
            return b"".join(map(ids_of, halves[n])) if n in halves else raw[n]

        for n, two in halves.items():
            raw[n] = b"".join(map(ids_of, two))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), np.uint16)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(r) // 2 for r in raw])])

    def width(self, chunk: str) -> int:
        """Bytes that a chunk's tokens cover."""
        if chunk.isascii():
            return len(chunk)
        return len(unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3").lower().encode())

    def learn(self, new: list[str]) -> list[bytes]:
        """Encode many chunks in few calls: side by side they are a text whose pre-tokens end where the chunks do."""
        got: list[bytes | None] = [None] * len(new)
        self.together([n for n, c in enumerate(new) if c], new, got)
        return [np.array(self.lib.encode(c, add_special_tokens=False).ids, np.uint16).tobytes() if g is None else g for c, g in zip(new, got)]

    def together(self, rows: list[int], new: list[str], got: list[bytes | None]) -> None:
        """Fill in ``got`` for some chunks; all or none."""
        if not rows:
            return
        ids = np.array(self.lib.encode_batch_fast([" ".join(new[n] for n in rows)], add_special_tokens=False)[0].ids, np.uint16)
        covered = np.concatenate([[0], np.cumsum(self.covers[ids])])
        widths = np.fromiter((self.width(new[n]) for n in rows), np.int64, len(rows))
        starts = np.cumsum(widths) - widths
        lo, hi = np.searchsorted(covered, starts), np.searchsorted(covered, starts + widths)
        whole = covered[-1] == starts[-1] + widths[-1]
        if whole and np.array_equal(covered[lo], starts) and np.array_equal(covered[hi], starts + widths) and (lo[1:] == hi[:-1]).all():
            raw = ids.tobytes()
            for n, a, b in zip(rows, lo.tolist(), hi.tolist()):
                got[n] = raw[2 * a : 2 * b]
