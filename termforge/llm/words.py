"""Hashes of all words of many texts at once, from arrays of bytes: no word is looked at on its own.

A word's hash is a polynomial of its bytes modulo 2^64, as a difference of prefix sums, then mixed with its length.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed together, about: memory is some fifty times that, or of the longest word.
SLICE = 1 << 20
_SPACE, _EDGE, _CORE = 0, 1, 2
_powers: list[np.ndarray] = []


def _classes(edges: bool) -> np.ndarray:
    out = np.full(256, _CORE, np.uint8)
    if edges:
        out[[i for i in range(128) if not chr(i).isalnum()]] = _EDGE
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    return out


_KINDS = {e: _classes(e) for e in (False, True)}


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each."""
    if not _powers or len(_powers[0]) < n:
        most = max(n, SLICE + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(most - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1]


def spans(raw: np.ndarray, edges: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; with `edges`, without marks at word ends, and no words of marks alone."""
    kind = _KINDS[edges].take(raw)
    core = np.zeros(len(raw) + 2, bool)
    core[1:-1] = kind == _CORE
    turn = np.flatnonzero(core[1:] != core[:-1])
    starts, ends = turn[::2], turn[1::2]
    if edges and len(starts):  # runs of one word are one
        word = np.cumsum(kind == _SPACE, dtype=np.int32).take(starts)
        new = np.diff(word, prepend=-1) != 0
        starts, ends = starts[new], ends[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    return starts, ends


def _hashes(raw: np.ndarray, edges: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = spans(raw, edges)
    up, down = _raised(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(up[:-1] * (raw.astype(np.uint64) + np.uint64(1)), out=total[1:])
    h = (total.take(ends) - total.take(starts)) * down.take(starts)
    return mixed(h + (ends - starts).astype(np.uint64)), starts, ends


def hashed_words(raws: list[bytes], edges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (between white space bytes) of the texts, in order, and the number of words of each text."""
    _, words, _, _, sizes = located_words(raws, edges)
    return words, sizes


def located_words(raws: list[bytes], edges: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each with a line feed after it; hashes, starts and ends there of all words; the number of words of each text."""
    raw = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    found, where, to, at = [], [], [], 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):  # cut at white space: before the limit, or else at the first beyond it
            space = np.flatnonzero(_KINDS[False].take(raw[at:end]) == _SPACE)
            if len(space):
                end = at + int(space[-1]) + 1
            else:
                while end < len(raw) and not len(space):
                    space = np.flatnonzero(_KINDS[False].take(raw[end : end + SLICE]) == _SPACE)
                    end = end + int(space[0]) + 1 if len(space) else min(len(raw), end + SLICE)
        h, starts, ends = _hashes(raw[at:end], edges)
        found.append(h)
        where.append(starts + at)
        to.append(ends + at)
        at = max(end, at + 1)
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    starts, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, to))
    return raw, words, starts, ends, np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
