import random

import numpy as np
import pytest
from termforge.llm import words as W

EDGE = bytes(i for i in range(128) if not chr(i).isalnum())


def made(seed, n):
    r = random.Random(seed)
    bits = ["a", "B", "é", "漢", "-", "'", ".", "0", " ", " ", "\t", "\n", "\x0b", "\0", "\x1c", " "]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 60))).encode() for _ in range(n)]


@pytest.mark.parametrize("edges", [False, True])
@pytest.mark.parametrize("size", [1 << 20, 64, 7])
def test_same_words_as_split_and_strip(monkeypatch, edges, size):
    monkeypatch.setattr(W, "SLICE", size)
    texts = [b"", *made(size, 400), b"x" * 500 + b" y", b" ", b"z"]
    found, sizes = W.hashed_words(texts, edges)
    split = [[w for x in t.split() if (w := x.strip(EDGE) if edges else x)] for t in texts]
    assert sizes.tolist() == list(map(len, split))
    flat = [w for x in split for w in x]
    by_word: dict[bytes, int] = {}
    for w, h in zip(flat, found.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_nothing():
    found, sizes = W.hashed_words([])
    assert not len(found) and not len(sizes) and found.dtype == np.uint64


def test_zero_bytes_and_order_tell_words_apart():
    texts = [b"\0a", b"a", b"a\0", b"ab", b"ba", b"\0\0"]
    assert len(set(W.hashed_words(texts)[0].tolist())) == len(texts)
