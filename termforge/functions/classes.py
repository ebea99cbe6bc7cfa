"""Classes of characters as Java's patterns have them, in one table by code point for numpy and Python.

The ranges in data/classes.txt are those that Spark's own `rlike` gives for \\p{IsAlphabetic}, \\p{IsUppercase}, \\p{IsLowercase},
\\p{N} and (?U)\\s; a test holds them against it.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from termforge.resources import bundled

LETTER, UPPER, LOWER, NUMBER, SPACE, DIGIT = 1, 2, 4, 8, 16, 32
WORD = LETTER | NUMBER
_NAMES = {"letter": LETTER, "upper": UPPER, "lower": LOWER, "number": NUMBER, "space": SPACE}
#: Capitals that Spark's `lower` knows and Python's doesn't yet.
_NEW = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}


@cache
def table() -> np.ndarray:
    """A byte of classes for each code point."""
    out = np.zeros(0x110000, np.uint8)
    for line in bundled("classes.txt").splitlines():
        name, *ranges = line.split()
        for r in ranges:
            low, _, high = r.partition("-")
            out[int(low, 16) : int(high or low, 16) + 1] |= _NAMES[name]
    out[ord("0") : ord("9") + 1] |= DIGIT
    return out


@cache
def of_code() -> bytes:
    return table().tobytes()


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_NEW).lower()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)
