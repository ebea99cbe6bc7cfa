"""What is known of a token by itself: its lower-cased form, its shape, and whether the lists have it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from termforge.functions import classes
from termforge.functions.classes import DIGIT as _DIGIT
from termforge.functions.classes import LETTER as _LETTER
from termforge.functions.classes import LOWER as _LOWER
from termforge.functions.classes import UPPER as _UPPER
from termforge.functions.classes import WORD as _WORD
from termforge.operators import lexicon
from termforge.resources import Resources

#: Bits of a token's flags. SEGMENTS and LONG take two bits each: (segments - 1, at most 2), (12, 17 characters or less, more).
INNER, DIGIT, LETTER, CAPS, SHORT, TWO, LARGE, SMALL, COMMON, FREQUENT, STOP = (1 << i for i in range(11))
SEGMENTS, LONG = 11, 13
#: Tokens that a worker knows at once; then it forgets all.
MOST = 60_000
_APOSTROPHES = str.maketrans(dict.fromkeys("’ʼ＇", "'"))
_SEPARATORS = re.compile(r"[-_/.+]")
_LAST = frozenset("'sdgen")  # of endings that are undone
_AMERICAN = (("ise", "ize"), ("isation", "ization"), ("ised", "ized"), ("ising", "izing"))


@dataclass(frozen=True)
class Lists:
    """The lists of a configuration as sets: bounded, so they travel with the code."""

    common: frozenset[str]
    frequent: frozenset[str]
    stopwords: frozenset[str]
    irregular: frozenset[str]

    @classmethod
    def of(cls, resources: Resources) -> Lists:
        size, depth = resources.config.wordlist_size, resources.config.acronym_wordlist_depth
        if max(size, depth) > lexicon.MOST_WORDS:
            raise ValueError(f"word lists beyond {lexicon.MOST_WORDS} words are not broadcast")
        words = resources.words.where(F.col("rank") < max(size, depth)).select("word", "rank").collect()
        common = frozenset(w for w, r in words if r < size)
        irregular = frozenset(a for a, b in resources.lemmas.select("inflected", "lemma").collect() if b in common)
        return cls(common, frozenset(w for w, r in words if r < depth), frozenset(r["word"] for r in resources.stopwords.collect()), irregular)

    def has_common(self, form: str) -> bool:
        """Whether the form is listed, or one that undoing its ending leads to, or the lemma of an irregular form."""
        if form in self.common or form in self.irregular:
            return True
        return form[-1:] in _LAST and any(len(k) >= 2 and k in self.common for f in (form, *base_forms(form)) if len(f) >= 2 or f == form for k in (f, american(f)) if k)


NOTHING = Lists(frozenset(), frozenset(), frozenset(), frozenset())


def base_forms(w: str) -> list[str]:
    """Forms that an inflected word may come from; as `text.base_forms` in SQL."""
    out = [w[:-2]] if w.endswith("'s") else []
    if w.endswith("'"):
        out.append(w[:-1])
    if w.endswith("ies"):
        out.append(w[:-3] + "y")
    for suffix in ("es", "ed", "ing", "s"):
        if w.endswith(suffix):
            s = w[: -len(suffix)]
            out.append(s)
            if suffix != "s":
                out.append(s + "e")
            if len(s) >= 2 and s[-2] == s[-1] and s[-1] not in "aeiou" and classes.of_code()[ord(s[-1])] & _LETTER:
                out.append(s[:-1])
    return out


def american(w: str) -> str | None:
    return next((w[: -len(b)] + z for b, z in _AMERICAN if w.endswith(b)), None)


def shape(token: str) -> int:
    """Flags that need no list."""
    if token.isascii() and token.isalpha() and token[1:].islower():  # most words
        n = len(token)
        return TWO | LETTER | SMALL | (0 if token[0].islower() else LARGE) | (0 if n <= 12 else 1 if n <= 17 else 2) << LONG
    known = classes.of_code()
    kinds = [known[ord(c)] for c in token]
    every = inner = 0
    for k in kinds:
        every |= k
    for k in kinds[1:]:
        inner |= k
    n = len(token)
    flags = (INNER if inner & _UPPER and inner & _LOWER else 0) | (DIGIT if every & _DIGIT else 0) | (SMALL if every & _LOWER else 0) | (TWO if n >= 2 else 0)
    flags |= (LARGE if kinds and kinds[0] & _UPPER else 0) | (0 if n <= 12 else 1 if n <= 17 else 2) << LONG
    if every & _LETTER:
        flags |= LETTER
        if all(k & _UPPER or not k & _LETTER for k in kinds):
            flags |= CAPS | (SHORT if 2 <= n <= 6 else 0)
    if _SEPARATORS.search(token):
        parts = [p for p in _SEPARATORS.split(token) if p]
        if len(parts) > 1 and all(any(known[ord(c)] & _WORD for c in p) for p in parts):
            flags |= min(len(parts) - 1, 2) << SEGMENTS
    return flags


class Vocabulary(dict):
    """token -> (lower, flags), found when first asked for."""

    def __init__(self, lists: Lists) -> None:
        self.lists = lists
        self.lows: dict[str, int] = {}

    def __missing__(self, token: str) -> tuple[str, int]:
        low = classes.lowered(token)
        listed = self.lows.get(low)
        if listed is None:
            form = low if low.isascii() else low.translate(_APOSTROPHES)
            listed = (COMMON if self.lists.has_common(form) else 0) | (FREQUENT if low == form and low in self.lists.frequent else 0) | (STOP if form in self.lists.stopwords else 0)
            self.lows[low] = listed
        told = self[token] = (low, shape(token) | listed)
        return told


_KEPT: dict[Lists, Vocabulary] = {}


def of_worker(lists: Lists) -> Vocabulary:
    """The vocabulary that this worker keeps from batch to batch, for one set of lists at a time."""
    if lists not in _KEPT or len(_KEPT[lists]) > MOST:
        _KEPT.clear()
        _KEPT[lists] = Vocabulary(lists)
    return _KEPT[lists]
