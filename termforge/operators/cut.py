"""Many canonical texts cut into pieces, clauses and tokens at once, from arrays of their characters.

The rules are those of `tokenize`, which says them in SQL over flat frames. Here a document is never dealt out by its
tokens: whoever holds its text has all of it, so nothing is sorted, shuffled or spilled.
"""

from __future__ import annotations

import numpy as np

from termforge.functions import classes
from termforge.functions.classes import DIGIT, LOWER, SPACE, UPPER, WORD

_NEWLINE, _MARK = 10, 1


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def within(new: np.ndarray) -> np.ndarray:
    """Number of each row in its run, from 0."""
    at = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(at, np.diff(at, append=len(new)))


class Cut:
    """Columns of pieces (p_...) and tokens (t_...) of texts; spans are in bytes of their own text, `from` and `to` in characters of all."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        self.text = text = "".join(texts)
        codes = classes.codes(text)
        kind = classes.table()[codes]
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        first = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        newline, mark = codes == _NEWLINE, codes == _MARK
        size = (1 + (codes >= 0x80).view(np.int8) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int64)
        size[mark] = 0
        byte = np.concatenate([[0], np.cumsum(size)])
        byte = byte[:-1] - byte[first][doc]
        solid = np.flatnonzero(kind & SPACE == 0)

        # a piece ends after a line feed, and after a full stop before white space and a capital or digit; marks go
        after = newline.copy()
        stop = np.flatnonzero((codes == ord(".")) | (codes == ord("!")) | (codes == ord("?")))
        stop = stop[stop + 1 < len(codes)]
        stop = stop[kind[stop + 1] & SPACE != 0]
        then = np.searchsorted(solid, stop + 1)
        stop, then = stop[then < len(solid)], solid[then[then < len(solid)]]
        after[stop[(doc[then] == doc[stop]) & (kind[then] & (UPPER | DIGIT) != 0)]] = True
        ends = after | mark
        sent = np.concatenate([[0], np.cumsum(ends)])
        sent = sent[:-1] - sent[first][doc]
        live = np.flatnonzero(~mark)
        new = np.flatnonzero(firsts(doc[live], sent[live]))
        a, b = live[new], live[np.append(new[1:], len(live))[: len(new)] - 1]
        self.p_from, self.p_to, self.p_doc, self.p_sent = a, b + 1, doc[a], sent[a].astype(np.int32)
        self.p_start, self.p_end = byte[a], byte[b] + size[b]
        lines = np.concatenate([[0], np.cumsum(newline)])
        self.p_line = lines[a] - lines[first][self.p_doc]
        low, high = np.searchsorted(solid, a), np.searchsorted(solid, b, "right") - 1
        some = low <= high
        x, y = (solid[np.where(some, i, 0)] if len(solid) else np.zeros(len(a), np.int64) for i in (low, high))
        self.p_kept = some & (byte[y] + size[y] - byte[x] > 1)

        # a kept piece goes on with the last unless that one ended or it starts large
        k = np.flatnonzero(self.p_kept)
        ended = np.isin(codes[y[k]], [ord(c) for c in ".!?:;"])
        opens = firsts(self.p_doc[k])
        begins = opens | (kind[x[k]] & LOWER == 0)
        begins[1:] |= ended[:-1]
        clause = np.cumsum(begins)
        self.p_clause = np.full(len(a), -1, np.int64)
        self.p_clause[k] = clause - np.repeat(clause[opens], np.diff(np.flatnonzero(opens), append=len(k)))

        # a token goes from the first to the last letter or digit between white space
        parted = newline | mark | (codes == ord(" ")) | (codes == ord("\t"))
        parted[a] = True
        word = np.flatnonzero(kind & WORD)
        chunk = np.cumsum(parted)[word]
        # a separator that begins a piece parts nothing twice, and one that is itself no word can't join two chunks
        new = np.flatnonzero(firsts(chunk))
        s, e = word[new], word[np.append(new[1:], len(word))[: len(new)] - 1]
        self.t_from, self.t_to = s, e + 1
        piece = np.searchsorted(a, s, "right") - 1
        self.t_doc, self.t_line, self.t_clause = self.p_doc[piece], self.p_line[piece], self.p_clause[piece]
        self.t_start, self.t_end = byte[s], byte[e] + size[e]
        self.t_idx = within(firsts(self.t_doc))
        self.t_at = np.zeros(len(s), np.int64)
        for inside in (self.t_clause >= 0, self.t_clause < 0):
            i = np.flatnonzero(inside)
            self.t_at[i] = within(firsts(self.t_doc[i], self.t_clause[i]))

    def pieces(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.p_from.tolist(), self.p_to.tolist())]

    def tokens(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.t_from.tolist(), self.t_to.tolist())]

    def clauses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """doc, clause, start, end, text of each clause."""
        k = np.flatnonzero(self.p_kept)
        new = np.flatnonzero(firsts(self.p_doc[k], self.p_clause[k]))
        last = np.append(new[1:], len(k))[: len(new)]
        parts = [self.text[a:b] for a, b in zip(self.p_from[k].tolist(), self.p_to[k].tolist())]
        texts = [parts[i] if j == i + 1 else "".join(parts[i:j]) for i, j in zip(new.tolist(), last.tolist())]
        return self.p_doc[k[new]], self.p_clause[k[new]], self.p_start[k[new]], self.p_end[k[last - 1]], texts
