"""The byte-level encoder against the library."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tokenizers

from facetlake.llm import byte_level, tokens

PATH = P.path("byte_bpe_50k.json")
SIGNS = ["a", "B", "é", "ß", "×", "÷", "'", "'s", "'ll", "1", "42", ".", ",", "-", "\n", " ", "λ", "Σ", "日", "😀", "«", "²", "…", "́", "\x00", "\x01", "\x7f", "\xa0", "  ", "the", "***", "<|endoftext|>"]


def mixed_texts(n: int) -> list[str]:
    r = random.Random(3)
    words = lambda k: " ".join("".join(r.choices([x for x in SIGNS if x.strip() == x], k=r.randint(1, 6))) for _ in range(k))
    return ["".join(r.choices(SIGNS, k=r.randint(0, 12))) if k % 2 else words(r.randint(1, 9)) for k in range(n)]


def latin_texts(n: int) -> list[str]:
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeèñtionghsr", k=r.randint(1, 14))) + r.choice(["", "", ".", ",###"])
    return ["\n".join(" ".join(word() for _ in range(30)) for _ in range(3)) for _ in range(n)]


def same(enc: tokens.Encoder, texts: list[str | None]) -> None:
    lib = tokenizers.Tokenizer.from_file(PATH)
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert got.dtype == np.uint16 and got.tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_ids_equal_the_library():
    enc = tokens.Encoder(PATH)
    for texts in (mixed_texts(4000), latin_texts(50), ["'" * k + s for k in range(4) for s in ("", "s", " s", "1", "\n'll", "é", "'re'")], [None, "", "\n", "a" * 5000, "é" * 40, "x" * 32, "x" * 33, " " + "x" * 31, " " + "x" * 32], [None, ""], []):
        same(enc, texts)
        same(enc, texts)  # now known


def test_full_table_and_equal_hashes(monkeypatch):
    monkeypatch.setattr(byte_level, "CACHE", 50)
    enc = tokens.Encoder(PATH)
    for texts in (["a few words first"], latin_texts(20), mixed_texts(500), ["a few words more"]):
        same(enc, texts)
    assert 0 < enc.pieces.n <= 50
    monkeypatch.setattr(byte_level, "MIX", [np.uint64(0)] * 6)
    same(tokens.Encoder(PATH), latin_texts(5) + mixed_texts(200))


def test_new_latin_words_do_not_meet_the_library(monkeypatch):
    """Most of a growing corpus' distinct words are new; learning them in the library took half of the packing's CPU time."""
    texts = latin_texts(200)
    lib = tokenizers.Tokenizer.from_file(PATH)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]

    class Watched:
        def __init__(self, lib):
            self.lib, self.chars = lib, 0

        def __getattr__(self, name):
            return getattr(self.lib, name)

        def encode(self, text, **more):
            self.chars += len(text)
            return self.lib.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            self.chars += sum(map(len, texts))
            return self.lib.encode_batch_fast(texts, **more)

    class Opened:
        from_file = staticmethod(lambda path, f=tokenizers.Tokenizer.from_file: Watched(f(path)))

    monkeypatch.setattr(tokenizers, "Tokenizer", Opened)
    enc = tokens.Encoder(PATH)
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert enc.lib.chars == 0


def test_merges_look_up_ranks_once_a_round(monkeypatch):
    """Two look-ups for each of many small blocks took most of the time of new pieces."""
    import json

    with open(PATH, encoding="utf-8") as f:
        merges = byte_level.Merges(json.load(f))
    lib = tokenizers.Tokenizer.from_file(PATH)
    r = random.Random(6)
    words = [" " + "".join(r.choices("abcdeghilnorst", k=r.randint(0, 31))) for _ in range(9000)]
    calls = []
    rank = merges.rank
    monkeypatch.setattr(merges, "rank", lambda *a: calls.append(1) or rank(*a))
    chars = np.array([list(w.encode().ljust(32, b"\0")) for w in words], np.uint8)
    flat, counts = merges.ids(chars, np.array([len(w) for w in words]))
    ends = np.cumsum(counts)
    assert [flat[a:b].tolist() for a, b in zip(ends - counts, ends)] == [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert len(calls) <= 31  # merges of the longest piece


@pytest.mark.parametrize("change", [{"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}])
def test_other_kinds_of_files(change):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert byte_level.fits(spec) and not byte_level.fits(spec | change)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        assert not byte_level.fits(json.load(f))
