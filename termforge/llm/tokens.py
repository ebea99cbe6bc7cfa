"""Encoding of whole texts by a public tokenizer, one distinct space-separated piece at a time.

The tokenizer drops white space and no rule of it looks across it, so the ids of a text are the ids of
its space-separated pieces, in order. Pieces repeat; each is encoded once per worker and then looked up.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
from pyspark.sql import SparkSession

from termforge.llm.common import held

TOKENIZER = "word_bpe_49k.json"
#: A worker forgets what it has encoded, but pieces that came again, beyond this many pieces or characters, so its memory is bounded.
MOST_PIECES, MOST_CHARS = 500_000, 10_000_000
#: Words (pieces without case and marks, under 100 characters) have their own limit and outlive the pieces.
MOST_WORDS = 500_000
#: Texts are taken together up to this many characters.
BATCH_CHARS = 2_000_000


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts: few to an Arrow batch, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def gathered(rows: Iterable[tuple], chars: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Lists of (key, text) rows of about so many characters; a longer text is alone in its list."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        n = len(row[1])
        if held and size + n > chars:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


class _Known(dict):
    """Numbers of pieces in order of appearance; `new` holds those that are still to be encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


#: Letters that no normalisation but lower-casing changes, and marks that make one piece of their own after letters.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?%&*#$|"
_CLOSERS = "\"')]}»”’"
_STOPS = frozenset(".!?。！？")


def _byte_letters() -> dict[int, int]:
    """Byte values to the letters that stand for them in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class PieceEncoder:
    """Ids of lists of texts, as numpy arrays.

    A new piece of plain letters, with or without marks after them, is given to the tokenizer's model directly, letters
    and marks apart, which is what its rules come to for such pieces (`plain` says whether they are the rules of this
    tokenizer file); every other piece goes through the whole tokenizer.
    """

    def __init__(self, name: str = TOKENIZER) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.plain = name == TOKENIZER
        self.kind = "H" if self.width == 2 else "I"
        # ids are kept as bytes: smaller than lists of numbers, joined without a step an id, and nothing that is searched for cycles
        self.marks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.forget()

    @property
    def width(self) -> int:
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def forget(self) -> None:
        self.known = _Known()
        self.chars = 0
        self.flat = np.zeros(1 << 16, np.uint16 if self.width == 2 else np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int32)
        self.sizes = np.zeros(1 << 12, np.int32)
        self.ends = np.zeros(1 << 12, bool)
        self.uses = np.zeros(1 << 12, np.int64)

    def _trim(self) -> None:
        """At the limits, forget all pieces but those that came again since the last time, up to half of each limit."""
        if len(self.known) <= MOST_PIECES and self.chars <= MOST_CHARS:
            return
        again = np.flatnonzero(self.uses[: len(self.known)] > 1)[: MOST_PIECES // 2]
        names = list(self.known)
        chars = np.cumsum(np.fromiter((len(names[i]) for i in again.tolist()), np.int64, len(again)))
        again = again[: int(np.searchsorted(chars, MOST_CHARS // 2, "right"))]
        names = [names[i] for i in again.tolist()]
        sizes, ends = self.sizes[again], self.ends[again]
        ids = self.flat[np.arange(sizes.sum()) + np.repeat(self.starts[again] - np.cumsum(sizes) + sizes, sizes)]
        self.forget()
        self.known.update(zip(names, range(len(names))))
        self._keep(names, sizes, ids, ends)

    def _keep(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray, ends: np.ndarray | list[bool]) -> None:
        """Lay out what is kept of the last pieces known."""
        n, at = len(pieces), len(self.known) - len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.starts):
            self.starts, self.sizes, self.ends, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.ends, self.uses))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at : at + n] = sizes
        self.ends[at : at + n] = ends
        self.used += len(ids)
        self.chars += sum(map(len, pieces))

    def _ids(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        rest, kind, known, marked, tokenize = [], self.kind, self.words, self.marks, self.model.tokenize
        if len(known) > MOST_WORDS:
            known.clear()
        for i, piece in enumerate(pieces):
            word = piece.rstrip(_MARKS) if self.plain and len(piece) < 100 else ""
            if word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
                low = word.lower()
                if (ids := known.get(low)) is None:
                    shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                    known[low] = ids = array(kind, [t.id for t in tokenize(shown)]).tobytes()
                if len(word) < len(piece):
                    marks = piece[len(word) :]
                    if marks not in marked:
                        marked[marks] = array(kind, self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
                    ids += marked[marks]
                out[i] = ids
            else:
                rest.append(i)
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        for i, e in zip(rest, self.tokenizer.encode_batch([pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = array(kind, e.ids).tobytes()
        return out

    def _learn(self) -> None:
        new = self.known.new
        if not new:
            return
        self.known.new = []
        found = self._ids(new)
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // self.flat.itemsize
        ends = [x == "\n" or x[-1:] in _STOPS or x.rstrip(_CLOSERS)[-1:] in _STOPS for x in new]
        self._keep(new, sizes, np.frombuffer(b"".join(found), self.flat.dtype), ends)

    def encode(self, texts: list[str], sentences: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order; the number of ids of each text; where in the ids a sentence ends (lines count if asked for)."""
        with uncollected():
            return self._encoded(texts, sentences)

    def _encoded(self, texts: list[str], sentences: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        line = " \n " if sentences else " "
        split = [t.replace("\n", line).split(" ") for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self._trim()
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int32, int(counts.sum()))
        self._learn()
        self.uses[: len(self.known)] += np.bincount(at, minlength=len(self.known))
        sizes = self.sizes[at]
        after = np.cumsum(sizes, dtype=np.int64)
        total = int(after[-1]) if len(after) else 0
        source = np.repeat((self.starts[at] - after + sizes).astype(np.int32), sizes)
        source += np.arange(total, dtype=np.int32)
        ids = self.flat[source]
        last = np.cumsum(counts) - 1  # every text has a piece, if an empty one
        lengths = np.diff(after[last], prepend=0) if len(last) else np.zeros(0, np.int64)
        return ids, lengths, after[self.ends[at]]


def encoder_for(name: str) -> PieceEncoder:
    """One encoder for each tokenizer and worker process; later tasks of the process find its pieces known."""
    return held("pieces", name, lambda: PieceEncoder(name))


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for cycles, which what an encoder keeps has none of and which takes a fifth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by the end id; the new lengths."""
    after = np.cumsum(lengths + 1) - 1
    out = np.full(len(ids) + len(lengths), end, np.uint32)
    inner = np.ones(len(out), bool)
    inner[after] = False
    out[inner] = ids
    return out, lengths + 1
