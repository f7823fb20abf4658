"""Ids of a byte-level ``tokenizers`` file for whole buffers of text.

Classes of bytes give the borders of pre-tokens: runs of letters, of digits or of other ASCII signs, with the space before
them, and single line feeds.  A table by hash knows the pieces seen so far (all their bytes are compared).  New pieces are merged
side by side, in each round of every piece the pair of least rank, the first of equal ones, as the library does.
Pieces that the classes leave open (other scripts than Latin, an apostrophe before letters) or that are
long go through the library.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pieces of at most so many bytes are kept in the table, up to ``CACHE`` of them.
WIDTH = 32
CACHE = 1_000_000
#: Pieces that are merged side by side.
ROWS = 16384
SLOTS = 22
#: No merge: a rank above all, or no id: 0, as ids are kept one higher.
NONE = np.uint32(0xFFFF)
HALF = np.uint32(16)
#: Low bits of a table's entry that number the piece, one higher; the others are those of its hash.
NUMBER = np.uint64((1 << 20) - 1)
OPEN, LETTER, DIGIT, SIGN, QUOTE, SPACE, LINE = range(7)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xFF51AFD7ED558CCD)]
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def classes() -> np.ndarray:
    out = np.full(256, OPEN, np.uint8)
    out[:128] = SIGN
    for lo, hi, kind in ((b"A", b"Z", LETTER), (b"a", b"z", LETTER), (b"0", b"9", DIGIT), (b"'", b"'", QUOTE), (b" ", b" ", SPACE), (b"\n", b"\n", LINE)):
        out[lo[0] : hi[0] + 1] = kind
    return out


def pairs(rule) -> np.ndarray:
    """Whether a rule holds between a byte of one class and the next byte's, by 8 * class + next class."""
    return np.array([bool(rule(a, b)) for a in range(8) for b in range(8)])


CLASS = classes()
#: A piece ends between these; after an apostrophe letters may be its own.
ENDS = pairs(lambda a, b: b in (SPACE, LINE) or a == LINE or (a in (LETTER, DIGIT, SIGN) and b in (LETTER, DIGIT, SIGN, QUOTE) and a != b and (a, b) != (SIGN, QUOTE)))
#: A piece with these is left to the library.
UNSURE = pairs(lambda a, b: b == OPEN or (a == QUOTE and b in (LETTER, DIGIT)))
#: Both as bits 0 and 1, for ``bytes.translate``, which is several times as fast as a NumPy table of bytes.
BORDER = (ENDS + 2 * UNSURE).astype(np.uint8).tobytes().ljust(256, b"\0")
KIND = CLASS.tobytes()


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def fits(spec: dict) -> bool:
    """Whether a tokenizer's file is of the kind read here."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return bool(model["type"] == "BPE" and plain and split and spec["normalizer"] is None and all(x in model["vocab"] for x in byte_signs()) and max(model["vocab"].values()) < NONE and len(model["merges"]) < NONE)


class Merges:
    """Byte pair merges of many short pieces at once."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] + 1 for a, b in merges], np.uint32)
        byte = np.array([vocab[x] + 1 for x in byte_signs()], np.uint32)
        left, right = (np.array([vocab[m[side]] + 1 for m in merges], np.uint32) for side in (0, 1))
        keys = left << HALF | right
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.ranks = np.full(1 << self.bits, NONE, np.uint16)
        rank, slot = np.arange(len(keys), dtype=np.uint16), self.slot(keys)
        while len(rank):  # the next free slot of each
            free = self.keys[slot] == 0
            self.keys[slot[free]], self.ranks[slot[free]] = keys[rank[free]], rank[free]
            left_over = self.ranks[slot] != rank
            rank, slot = rank[left_over], (slot[left_over] + 1) & (len(self.keys) - 1)
        two = np.arange(1 << 16)
        #: Of a byte before another: rank of their merge and its own id in one number; of a piece's last byte.
        self.inner = self.number(self.rank(byte[two >> 8] << HALF | byte[two & 255]), 0, byte[two >> 8])
        self.last = self.number(np.full(256, NONE), 0, byte)

    @staticmethod
    def number(rank: np.ndarray, place, t: np.ndarray) -> np.ndarray:
        """Rank of an id's merge with the next one, its place and itself, as one number: the least one is to be merged."""
        return rank.astype(np.int64) << 24 | place << 16 | t

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, or NONE."""
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.full(len(keys), NONE, np.uint32)
        same = held == keys
        hit = np.flatnonzero(same)
        out[hit] = self.ranks[slot[hit]]
        at = np.flatnonzero((held != 0) > same)
        keys, slot = keys[at], slot[at]
        while len(at):
            slot = (slot + 1) & (len(self.keys) - 1)
            held = self.keys[slot]
            same = held == keys
            out[at[same]] = self.ranks[slot[same]]
            on = (held != 0) > same
            at, keys, slot = at[on], keys[on], slot[on]
        return out

    def ids(self, chars: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of ``chars`` in a row, and how many each has."""
        order = np.argsort(lens, kind="stable")
        counts, parts = np.zeros(len(lens), np.int64), []
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            flat, counts[rows] = self.block(chars[rows, : lens[rows[-1]]], lens[rows])
            parts.append(flat)
        flat = np.concatenate([*parts, np.zeros(0, np.uint16)])
        ends = np.cumsum(counts[order])
        first = np.empty(len(lens), np.int64)
        first[order] = ends - counts[order]
        return flat[spread(first, counts)], counts

    def block(self, chars: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = chars.shape[0], chars.shape[1] + 2  # a place without id before each piece and one after it
        rows, places = np.arange(n), np.arange(width)[:, None]
        held = np.full((width, n), int(NONE) << 24)  # a column for each piece
        across = np.ascontiguousarray(chars.T).astype(np.int64)
        held[1:-2] = self.inner[across[:-1] << 8 | across[1:]]
        held[places > lens] = int(NONE) << 24
        held[lens, rows] = self.last[chars[rows, lens - 1]]
        held |= places << 16
        done = np.zeros((width, n), np.uint16)
        while True:
            best = held.min(axis=0)
            on = best >> 24 < NONE
            if not on.all():
                off, on = np.flatnonzero(~on), np.flatnonzero(on)
                done[: len(held), rows[off]] = held.take(off, axis=1)  # the low 16 bits
                held, rows, best = held.take(on, axis=1), rows[on], best[on]
            if not len(rows):
                break
            place, made = best >> 16 & 255, self.made[best >> 24]
            # each piece loses the place after the merged one
            later = places[: len(held) - 1].astype(np.int8) > place.astype(np.int8)
            moved = held[1:] - (1 << 16)
            moved ^= held[:-1]
            moved &= -later.view(np.int8)
            moved ^= held[:-1]
            held, t = moved, moved.ravel()
            at = place * len(rows) + np.arange(len(rows))
            before, after = t[at - len(rows)], t[at + len(rows)]
            ranks = self.rank(np.concatenate([made << HALF | after.astype(np.uint16), before.astype(np.uint16) << HALF | made]))
            t[at] = self.number(ranks[: len(at)], place, made)
            t[at - len(rows)] = self.number(ranks[len(at) :], 0, before & 0xFFFFFF)
        done = np.ascontiguousarray(done.T)
        kept = done > 0
        return done[kept] - np.uint16(1), kept.sum(axis=1)


def spread(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places of many ranges in a row."""
    ends = np.cumsum(lens)
    return np.repeat(first - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` along its last axis."""
    if a.shape[-1] >= n:
        return a
    out = np.zeros((*a.shape[:-1], max(n, a.shape[-1] * 3 // 2)), a.dtype)
    out[..., : a.shape[-1]] = a
    return out


class Pieces:
    """Ids of texts without unusual white space (``tokens.ODD``), by the pieces they are made of."""

    def __init__(self, lib, spec: dict):
        self.lib, self.merges = lib, Merges(spec)
        self.table = np.zeros(1 << SLOTS, np.uint64)
        #: Of each known piece: bytes as four numbers, and where its ids begin, its length and how many ids it has in one number.
        self.n, room = 0, 1 << 16
        self.words, self.span = np.zeros((WIDTH // 8, room), np.uint64), np.zeros(room, np.int64)
        self.used, self.ids = 0, np.zeros(1 << 18, np.uint16)
        #: Ids of pieces that went through the library.
        self.others: dict[bytes, np.ndarray] = {}

    def gather(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string())
        of = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        n = int(of[-1] - of[0])
        if not n:
            return [np.zeros(0, np.uint16)] * len(texts)
        data = np.zeros(n + WIDTH, np.uint8)
        data[:n] = np.frombuffer(texts.buffers()[2], np.uint8)[of[0] : of[-1]]
        of = of - of[0]
        start, size, hard = self.cut(data[:n], of)
        eights = np.ndarray((n + WIDTH - 7,), "<u8", data, strides=(1,))
        easy = np.flatnonzero(~hard) if hard.any() else slice(None)
        begin, lens = start[easy], size[easy]
        word = eights[begin] & MASK[np.minimum(lens, 8)]
        mixed = lens.astype(np.uint64) * MIX[4] + word * MIX[0]
        long = np.flatnonzero(lens > 8)
        more = self.rest(eights, begin[long], lens[long])
        mixed[long] += sum(w * m for w, m in zip(more, MIX[1:]))
        mixed = (mixed ^ mixed >> np.uint64(32)) * MIX[5]
        code = self.find(mixed)
        base, used = self.n, self.used
        miss = np.flatnonzero(code < 0)
        if len(miss):
            _, at, number = np.unique(mixed[miss], return_index=True, return_inverse=True)
            code[miss] = base + number
            at = miss[at]
            fresh = mixed[at]
            self.learn([word[at], *self.rest(eights, begin[at], lens[at])], lens[at])
        span = self.span[code]
        same = (span >> 8 & 255 == lens) & (self.words[0][code] == word)
        for known, w in zip(self.words[1:], more):
            same[long] &= known[code[long]] == w
        first, count = span >> 16, span & 255
        if not isinstance(easy, slice) or not same.all():
            hard[np.arange(len(start))[easy][~same]] = True  # another piece of equal hash
            spans = np.zeros((2, len(start)), np.int64)
            spans[:, easy] = first, count
            first, count = spans
            at = np.flatnonzero(hard)
            first[at], count[at] = self.by_library([data[a:b].tobytes() for a, b in zip(start[at].tolist(), (start[at] + size[at]).tolist())])
        flat = self.ids[spread(first, count)]
        if self.n > CACHE:  # frequent pieces come first, so a full table keeps the useful ones
            self.n, self.used = base, used
        elif len(miss):
            self.enter(fresh, base)
        ends = np.concatenate([[0], np.cumsum(count)])
        cuts = ends[np.searchsorted(start, of)].tolist()
        return [flat[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]

    def rest(self, eights: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        """Bytes of pieces from the ninth on, as numbers."""
        return [eights[begin + 8 * k] & MASK[np.clip(lens - 8 * k, 0, 8)] for k in range(1, WIDTH // 8)]

    def cut(self, data: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin, their bytes, and which are left to the library."""
        kind = np.frombuffer(bytearray(data).translate(KIND), np.uint8)
        lead = np.flatnonzero(data == 0xC3)  # of U+00C0 to U+00FF all but two are letters
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        border = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(BORDER), np.uint8)
        begins = np.concatenate([[True], (border & 1).view(bool)])
        begins[of[:-1][of[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(data)))
        hard = size > WIDTH
        unsure = np.flatnonzero(border & 2) + 1
        if kind[0] == OPEN:
            unsure = np.append(unsure, 0)
        hard[np.searchsorted(start, unsure, side="right") - 1] = True
        return start, size, hard

    def find(self, mixed: np.ndarray) -> np.ndarray:
        """Number of each known piece by its hash, or -1."""
        slot = (mixed >> np.uint64(64 - SLOTS)).astype(np.int64)
        held = self.table[slot]
        at = np.flatnonzero((held != 0) & ((held ^ mixed) > NUMBER))
        while len(at):
            slot[at] = (slot[at] + 1) & (len(self.table) - 1)
            held[at] = self.table[slot[at]]
            at = at[(held[at] != 0) & ((held[at] ^ mixed[at]) > NUMBER)]
        return (held & NUMBER).astype(np.int64) - 1

    def learn(self, words: list[np.ndarray], lens: np.ndarray) -> None:
        """Number distinct new pieces."""
        lo, hi = self.n, self.n + len(lens)
        self.words, self.span = grown(self.words, hi), grown(self.span, hi)
        flat, count = self.merges.ids(np.stack(words, axis=1).astype("<u8").view(np.uint8), lens)
        for known, w in zip(self.words, words):
            known[lo:hi] = w
        self.span[lo:hi] = self.used + np.cumsum(count) - count << 16 | lens << 8 | count
        self.put(flat, self.used)
        self.n, self.used = hi, self.used + len(flat)

    def enter(self, mixed: np.ndarray, base: int) -> None:
        """Give new pieces their slots."""
        entry = mixed & ~NUMBER | np.arange(base + 1, self.n + 1, dtype=np.uint64)
        slot = (mixed >> np.uint64(64 - SLOTS)).astype(np.int64)
        while len(entry):
            free = self.table[slot] == 0
            self.table[slot[free]] = entry[free]
            left_over = self.table[slot] != entry
            entry, slot = entry[left_over], (slot[left_over] + 1) & (len(self.table) - 1)

    def put(self, flat: np.ndarray, at: int) -> None:
        self.ids = grown(self.ids, at + len(flat))
        self.ids[at : at + len(flat)] = flat

    def by_library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where ids of these begin and how many they are; they stay until the next call."""
        fresh = list(dict.fromkeys(p for p in pieces if p not in self.others))
        got = self.lib.encode_batch_fast([p.decode() for p in fresh], add_special_tokens=False)
        new = {p: np.array(e.ids, np.uint16) for p, e in zip(fresh, got)}
        ids = [new[p] if p in new else self.others[p] for p in pieces]
        if len(self.others) + len(new) <= CACHE // 10:
            self.others |= new
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.put(np.concatenate(ids), self.used)
        return self.used + np.cumsum(count) - count, count
