"""Word hashes against splitting, piece by piece."""

import random

import numpy as np

from tessella.llm import words


def test_bounds_and_hashes(monkeypatch):
    rng = random.Random(1)
    for piece in (4, 64, 1 << 20):
        monkeypatch.setattr(words, "PIECE", piece)
        text = b"".join(rng.choice([b"a", b"b", b" ", b"\t", b"\n\x0b", b"\xc3\xa9", b"\x1f", b"\r\x0c"]) for _ in range(3000))
        raw = np.frombuffer(text, np.uint8)
        start, stop = words.word_bounds(raw)
        found = [text[a:b] for a, b in zip(start, stop, strict=True)]
        assert found == text.split()
        hashes = words.word_hashes(raw, start, stop)
        by_word = dict(zip(found, hashes.tolist(), strict=True))
        assert [by_word[w] for w in found] == hashes.tolist()
        assert len(set(by_word.values())) == len(by_word)


def test_no_words():
    for text in (b"", b" \n"):
        raw = np.frombuffer(text, np.uint8)
        start, stop = words.word_bounds(raw)
        assert len(start) == len(stop) == len(words.word_hashes(raw, start, stop)) == 0
