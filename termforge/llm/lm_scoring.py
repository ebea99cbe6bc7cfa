"""Language-model scoring by logistic context mixing.

The text is what the contract calls tokens: lower-cased words, then one end; its bytes are those of the tokens, each
followed by a space. Each byte is eight binary decisions from the highest bit down. Every decision has CONTEXTS
predictors: the last 1, 2, 3 and 5 bytes, the word so far, and the word so far with the whole word before it. Byte contexts
run across spaces, up to HEAD bytes before the word. A predictor is a slot of a hashed table with the counts of
zeros and ones that all training tokens had there. Log-odds are mixed by weights from a set gated by how much the longer
contexts have seen and by the bit's place, and the mix is refined by an adaptive table of (bits so far, log-odds).
Weights and the adaptive table learn from every decision of all training tokens, in one pass after the counts, each decision
without its own count in the slots: sums of slopes and curvatures at START give the weights, one Newton step for
each set of them, and counts of zeros and ones by (bits so far, log-odds) the table. The sums are of whole numbers, so they are the same however
texts are dealt to tasks. The product of the bits is a token's probability p, known or not.

Last comes what the text itself has shown: after n tokens of it, k of them this word, the probability is
(k + PRIOR p) / (n + PRIOR). So scores are of distributions that sum to one at every token, and a text is read once, in order.

A token's bits depend on it and the word before it alone, so a block runs each distinct pair of words once; and all
contexts but the last are alike for bytes with the same HEAD bytes before them at a word's start, or further into a word, whatever came before.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.llm.common import documents, partitions, stored, table
from termforge.llm.tokens import small_batches
from termforge.llm.words import located_words

#: Bits of the number of slot groups of each context: last 1, 2, 3, 5 bytes, word, word and the one before it.
GROUP_BITS = (13, 15, 16, 16, 18, 16)
CONTEXTS = len(GROUP_BITS)
#: Contexts that the choice of weights looks at.
GATES = (2, 3, 5)
#: A group of slots covers four bits: 16 outcomes, or the 15 decisions that lead to them.
LEAVES = 16 * sum(1 << b for b in GROUP_BITS)
_FIRST = [sum(1 << b for b in GROUP_BITS[:c]) for c in range(CONTEXTS)]
#: Bytes before a word that its contexts see: the end of the word before it and a space.
HEAD = 5
#: Weights before anything is learned, in tenths; without the last context, what shares the others shares the mix.
START = (0, 2, 4, 3, 3, 0)
#: Characters of text in a block, about, the unit of work; a block's words are in memory together.
BLOCK_CHARS = 24_000_000
END = b"\0"
_CHUNKS = 64
#: Bytes that are scored at once, and characters that are counted at once.
_BYTES, _MOST_COUNTED = 16_384, 12_000_000
#: The part of a Newton step that weights go; what is added to its curvatures, and to the counts of each entry of the table.
_RATE, _RIDGE, _SHOWN = 1.0, 200.0, 2.0
#: Tokens of a text that weigh as much as all that was learned from others.
PRIOR = 1000.0
_BINS, _STEPS = 33, 14
#: Mixed log-odds are read in levels of 1 / _FINE between -_WIDE and _WIDE.
_WIDE, _FINE, _LEVEL_BITS = 16, 32, 10
_LEVELS = 1 << _LEVEL_BITS
#: Probabilities are summed in steps of 1 / _UNIT; mixed log-odds at START are below _FAR in their steps.
_UNIT, _FAR = 1 << 12, 128 * sum(START)
_SETS = 2 * 4 ** len(GATES)
#: Odds in a byte each, between those of no sign, and above 128; every second of them; bytes that are learned from at once.
_CENTRE, _LANES, _CELLS = np.uint32(0x80808080), np.uint32(0x00FF00FF), 8_192


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words, white space being space and 0x09 to 0x0D."""
    return text.encode("utf-8", "replace").lower().split()


def _numbered(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones in order of appearance, and which of them each is."""
    known = pa.array(found).dictionary_encode()
    return known.dictionary.to_numpy(), known.indices.to_numpy()


class Vocabulary:
    """Distinct words, END first, with what contexts need of a word that stands before another."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)  # a new word has the next number
        self.number[END]
        self.found: list[bytes] | None = None

    def __len__(self) -> int:
        return len(self.number) if self.found is None else len(self.found)

    def at(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of whole texts, and how many each has; the vocabulary is theirs. Words are told apart by hashes of 64 bits, as where they are counted."""
        raw, hashes, starts, ends, sizes = located_words([text.encode("utf-8", "replace").lower() for text in texts])
        _, which = _numbered(hashes)
        one = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))  # numbers are in order of appearance
        del hashes
        last = np.cumsum(sizes + 1) - 1
        word = np.ones(len(which) + len(sizes), bool)
        word[last] = False
        at = np.zeros(len(word), np.int64)
        at[word] = which + 1
        starts, lengths = starts[one], ends[one] - starts[one] + 1
        offsets = np.cumsum(lengths) - lengths
        flat = raw.take(np.arange(lengths.sum()) + np.repeat(starts - offsets, lengths))
        flat[offsets + lengths - 1] = ord(" ")
        self._lay(END + b" " + flat.tobytes())
        return at, sizes + 1

    def pairs(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For tokens `at` of texts of these sizes, a key of (word before, word); before the first is END."""
        before = np.concatenate([[0], at[:-1]]) if len(at) else at
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        return before * len(self) + at

    def counted(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of the texts and how often each comes; no word is added after that."""
        found = np.concatenate([np.zeros(0, np.int64), *parts])
        keys, times = np.unique(self.pairs(found, np.array([len(x) for x in parts], np.int64)), return_counts=True)
        self.close()
        return keys, times

    def close(self) -> None:
        self._lay(b" ".join(self.number) + b" ")

    def _lay(self, flat: bytes) -> None:
        self.found = flat[:-1].split(b" ")
        self.flat = np.frombuffer(flat, np.uint8)
        self.sizes = np.fromiter(map(len, self.found), np.int64, len(self.found)) + 1
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.fromiter(map(xxhash.xxh32_intdigest, self.found), np.uint32, len(self.found))
        at = np.arange(HEAD - 1)
        first = self.flat.take(self.offsets[:, None] + at, mode="clip") * (at < self.sizes[:, None])
        back = np.arange(1 - HEAD, 1) + self.sizes[:, None] - 1  # the last bytes of a word and its space, spaces before a short one
        self.heads = np.where(back < 0, np.uint8(ord(" ")), self.flat.take(self.offsets[:, None] + back, mode="clip"))
        self.first, self.last = (np.ascontiguousarray(x, np.uint8).view(np.uint32)[:, 0].astype(np.int64) for x in (first, self.heads[:, :-1]))

    def units(self, keys: np.ndarray, most: int = _BYTES) -> Iterator[tuple[int, int, Units]]:
        """The pairs in runs of about so many bytes: (from, to, their bytes and contexts)."""
        before, at = np.divmod(keys, len(self))
        ends = np.cumsum(self.sizes[at] + HEAD)
        a = 0
        while a < len(keys):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            x, y = before[a:b], at[a:b]
            sizes = self.sizes[y]
            starts = np.cumsum(sizes + HEAD) - sizes
            # heads are overwritten last: what stands there first is of no account
            raw = self.flat.take(np.arange(starts[-1] + sizes[-1]) + np.repeat(self.offsets[y] - starts, sizes + HEAD), mode="clip")
            raw[(starts - HEAD)[:, None] + np.arange(HEAD)] = self.heads[x]
            yield a, b, Units(raw, sizes, self.hashes[x])
            a = b

    def shared(self, keys: np.ndarray, most: int = 8 * _BYTES) -> Iterator[tuple[np.ndarray, Shared]]:
        """The pairs in runs of about so many bytes, by first bytes and word: (which, what they share)."""
        before, at = np.divmod(keys, len(self))
        order = np.argsort(self.first.astype(np.uint32).byteswap().astype(np.int64)[at] * len(self) + at)  # by the very first byte, then the next
        ends = np.cumsum(self.sizes[at[order]])
        a = 0
        while a < len(keys):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield order[a:b], Shared(self, before[order[a:b]], at[order[a:b]])
            a = b


class Units:
    """Words with the HEAD bytes before each: their bytes, each word's ended by a space, and slot groups of all contexts.

    Without hashes of the words before, these are words without their first HEAD - 1 bytes, which are the last of those before
    them, and there is no last context. Before them, `heads` are first bytes of words by place: each with the HEAD bytes before it in one number.
    """

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, before: np.ndarray | None, heads: list[np.ndarray] = []) -> None:  # noqa: B006
        self.starts = np.cumsum(sizes) - sizes
        first = np.cumsum(sizes + HEAD) - sizes
        where = np.arange(sizes.sum()) + np.repeat(first - self.starts, sizes)
        skipped = HEAD - 1 if before is None else 0
        place = np.arange(skipped, skipped + sizes.sum()) - np.repeat(self.starts, sizes)
        now, *last = (raw[where - k].astype(np.uint32) for k in range(HEAD + 1))
        # the word so far: a polynomial of its bytes, from sums that start anew at each word
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 2 * HEAD, 0x01000193, np.uint32), dtype=np.uint32)
        sums = np.cumsum((now + np.uint32(1)) * powers[place], dtype=np.uint32)
        sums = np.concatenate([np.zeros(1, np.uint32), sums[:-1]])
        skip = (raw[first[:, None] + np.arange(-skipped, 0)].astype(np.uint32) + np.uint32(1)) * powers[:skipped]
        word = _stirred(sums + np.repeat(skip.sum(1, dtype=np.uint32) - sums[self.starts], sizes) + place.astype(np.uint32))
        if heads:
            found = [[(x >> 8 * (HEAD - k) & 255).astype(np.uint32) for k in range(HEAD + 1)] for x in heads]
            so_far = [_stirred(sum(((x[p - i] + np.uint32(1)) * powers[i] for i in range(p)), np.full(len(x[0]), p, np.uint32))) for p, x in enumerate(found)]
            now, *last = (np.concatenate(x) for x in zip(*found, [now, *last]))
            word = np.concatenate([*so_far, word])
        self.bytes, self.word = now.astype(np.int64), word
        three = last[0] | last[1] << np.uint32(8) | last[2] << np.uint32(16)
        five = _stirred(three) ^ (last[3] | last[4] << np.uint32(8)) * np.uint32(0x9E3779B1)
        found = [last[0], last[0] | last[1] << np.uint32(8), three, five, word]
        if before is not None:
            found.append(word ^ np.repeat(before, sizes) * _BEFORE)
        high = (self.bytes >> 4).astype(np.uint32)
        self.nibbles = (self.bytes >> 4, self.bytes & 15)
        self.groups = [[self._group(c, h, half) for c, h in enumerate(found)] for half in (np.uint32(0), high + np.uint32(1))]

    @staticmethod
    def _group(c: int, h: np.ndarray, half: np.ndarray) -> np.ndarray:
        h = _stirred(h + (half * np.uint32(0x85EBCA6B) + np.uint32(c))) >> np.uint32(32 - GROUP_BITS[c])
        h += np.uint32(_FIRST[c])
        h <<= np.uint32(4)
        return h.astype(np.int64)

    def bits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Bit by bit: its place, the decision within its four bits, the bit, the slots' groups."""
        for k in range(8):
            nibble, j = self.nibbles[k // 4], k % 4
            yield k, (1 << j) | (nibble >> (4 - j)), (nibble >> (3 - j)) & 1, self.groups[k // 4]

    def so_far(self, k: int) -> np.ndarray:
        """The first k bits of each byte, with a one before them."""
        return (1 << k) | (self.bytes >> (8 - k))


class Shared:
    """Pairs of words, equal words together: a byte's contexts but the last are those of the byte `index` of `local`.

    `local` has each of the first HEAD - 1 bytes of a word once for what its contexts see, and the rest of a word once.
    """

    def __init__(self, vocabulary: Vocabulary, before: np.ndarray, at: np.ndarray) -> None:
        v, most, heads, n = vocabulary, HEAD - 1, [], 0
        sizes, last, first = v.sizes[at], v.last[before], v.first[at]
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        where = []
        for p in range(most):
            here = np.flatnonzero(sizes > p) if p > 1 else slice(None)  # a word has a byte and a space
            head = last[here] >> 8 * p | ord(" ") << 8 * (most - p) | (first[here] & ((256 << 8 * p) - 1)) << 8 * (HEAD - p)
            found, number = _numbered(head)
            where.append((self.starts[here] + p, number.astype(np.int64) + n))
            heads.append(found)
            n += len(found)
        new = np.diff(at, prepend=-1) != 0
        found = at[new]
        rest = v.sizes[found] > most
        longer = found[rest]
        lengths = v.sizes[longer] + 1
        starts = np.cumsum(lengths) - lengths
        raw = v.flat.take(np.arange(lengths.sum()) + np.repeat(v.offsets[longer] - 1 - starts, lengths), mode="clip")
        self.local = Units(raw, lengths - HEAD, None, heads)
        further = np.zeros(len(found), np.int64)
        further[rest] = self.local.starts + n - most
        self.index = np.arange(sizes.sum()) + np.repeat(further[np.cumsum(new) - 1] - self.starts, sizes)
        for x, number in where:
            self.index[x] = number
        self.bytes = self.local.bytes[self.index]
        h = self.local.word[self.index] ^ np.repeat(v.hashes[before] * _BEFORE, sizes)
        #: Slot groups of the last context, of the upper and the lower four bits.
        self.last = [Units._group(CONTEXTS - 1, h, half) for half in (np.uint32(0), (self.bytes >> 4).astype(np.uint32) + np.uint32(1))]

    def outcomes(self, half: int) -> np.ndarray:
        """Of the last context, the slots of the upper or the lower four bits."""
        return self.last[half] + ((self.bytes >> 4 * (1 - half)) & 15)


_BEFORE = np.uint32(0xC2B2AE35)


def _stirred(h: np.ndarray) -> np.ndarray:
    h = h * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x27D4EB2F)


def counted(texts: list[list[bytes]]) -> np.ndarray:
    """How often each outcome of four bits came in each group of slots, over the tokens of the texts."""
    vocabulary = Vocabulary()
    return _outcomes(vocabulary, *vocabulary.counted([vocabulary.at(t) for t in texts]))


def _outcomes(vocabulary: Vocabulary, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    out = np.zeros(LEAVES, np.int32)  # of tokens in memory: far below 2^31
    for which, shared in vocabulary.shared(keys):
        units = shared.local
        each = np.repeat(times[which], shared.sizes)
        together = np.bincount(shared.index, each, len(units.bytes)).astype(np.int32)
        each = each.astype(np.int32)
        for half, (nibble, groups) in enumerate(zip(units.nibbles, units.groups)):
            for group in groups:
                np.add.at(out, group + nibble, together)
            np.add.at(out, shared.outcomes(half), each)
    return out


def decisions(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones of every decision, from those of outcomes: decision v of a group is at 16 * group + v."""
    out = np.zeros((2, len(leaves) // 16, 16), np.int64)
    for j in range(4):
        halves = leaves.reshape(-1, 1 << j, 2, 8 >> j).sum(3)
        out[0, :, 1 << j : 2 << j], out[1, :, 1 << j : 2 << j] = halves[:, :, 0], halves[:, :, 1]
    return out[0].reshape(-1), out[1].reshape(-1)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds of a one in steps of 1 / _STEPS."""
    return np.rint(np.clip(np.log((ones + 0.05) / (zeros + 0.05)), -9, 9) * _STEPS).astype(np.int8)


def _paths(odds: np.ndarray) -> np.ndarray:
    """By outcome of four bits, the odds of the four decisions that lead to it, as one item; `odds` are by decision, or by decision and bit."""
    at, j = np.arange(16)[:, None], np.arange(4)
    decided = (1 << j) | (at >> (4 - j))
    if odds.ndim == 3:
        odds, decided = odds.reshape(len(odds), -1), 2 * decided + ((at >> (3 - j)) & 1)
    return odds.take(decided.reshape(-1), 1).view(np.uint32).reshape(-1)


def _seen(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.uint8) + (n > 3) + (n > 30)


def _decided(half: int) -> np.ndarray:
    """By byte, where the costs of its four decisions begin, as one item."""
    k, byte = 4 * half + np.arange(4), np.arange(256)[:, None]
    return (((2 << k) | (byte >> (7 - k))) << _LEVEL_BITS).astype(np.int32).view(np.complex128)[:, 0]


_DECIDED = [_decided(half) for half in (0, 1)]


class Mixer:
    """The learned model: odds of slots, how much each group has seen, gated weights, adaptive table."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.odds, self.seen = _odds(zeros, ones), _seen((zeros + ones)[1::16])
        self.paths = _paths(self.odds.reshape(-1, 16))
        self.weights = np.tile(np.array(START, np.float32)[:, None] / (10 * _STEPS), (1, _SETS))
        self.apm = np.tile(np.linspace(-8, 8, _BINS, dtype=np.float32), 256)
        self.close()

    def close(self) -> None:
        """Lay out what the adaptive table and the mean with it make of a decision: natural logarithms by (bits so far, bit, mixed log-odds)."""
        mixed = ((np.arange(_LEVELS) + 0.5) / _FINE - _WIDE).astype(np.float32)
        node = np.arange(256)[:, None]
        final = (mixed + self.refined(node, mixed[None, :])[0]).astype(np.float64) / 2
        self.costs = -np.logaddexp(0, np.stack([final, -final], 1)).astype(np.float32).reshape(-1)

    @staticmethod
    def gate(half: int, seen: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(seen[0]), half, np.int64)
        for i, x in enumerate(seen):
            out += x.astype(np.int64) << (1 + 2 * i)
        return out

    def refined(self, node: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.clip(mixed, -7.999, 7.999) + np.float32(8)) * np.float32((_BINS - 1) / 16)
        low = at.astype(np.int64)
        share = at - low.astype(np.float32)
        i = node * _BINS + low
        return self.apm[i] * (1 - share) + self.apm[i + 1] * share, i, share

    def learn(self, texts: list[list[bytes]], zeros: np.ndarray, ones: np.ndarray) -> float:
        """One step from all decisions of the texts, which the counts hold; returns the mean bits of a byte before it."""
        vocabulary = Vocabulary()
        parts = [vocabulary.at(text) for text in texts]
        keys, times = vocabulary.counted(parts)
        bits = -(self.log10(vocabulary, keys) * times).sum() * math.log2(10)
        sums = Sums(*without_own(zeros, ones))
        sums.add(vocabulary, keys, times)
        self.step(sums.all)
        return bits / max(1, sum(int(vocabulary.sizes[x].sum()) for x in parts))

    def step(self, sums: np.ndarray) -> None:
        """Weights and adaptive table from the sums over all that is to be learned from."""
        slopes, curves, shown = Sums.parts(sums.astype(np.float64))
        start = np.array(START) / (10 * _STEPS)
        for i in range(_SETS):
            self.weights[:, i] = start + _RATE * np.linalg.solve(curves[i] / _UNIT + _RIDGE * np.eye(CONTEXTS), slopes[i] / _UNIT)
        even = 1 / (1 + np.exp(-np.tile(np.linspace(-8, 8, _BINS), 256)))
        zeros, ones = shown + _SHOWN * np.stack([1 - even, even])
        self.apm = np.log(ones / zeros).astype(np.float32)
        self.close()

    def logs(self, units: Units) -> np.ndarray:
        """Natural logarithm of the probability of each byte."""
        n = len(units.bytes)
        total, rows = np.zeros(n, np.float32), self.odds.view(np.complex128)  # a group's 16 odds are fetched as one item
        own = np.arange(0, 16 * n, 16)
        for half, (nibble, groups) in enumerate(zip(units.nibbles, units.groups)):
            numbers = [g >> 4 for g in groups]
            gate = self.gate(half, [self.seen[numbers[c]] for c in GATES])
            at = [own + ((1 << j) | (nibble >> (4 - j))) for j in range(4)]
            mixed = [np.full(n, _WIDE, np.float32) for _ in at]
            for c, number in enumerate(numbers):
                odds, weights = rows.take(number).view(np.int8), self.weights[c].take(gate)
                for out, x in zip(mixed, at):
                    out += odds.take(x) * weights
            for j, out in enumerate(mixed):
                out *= np.float32(_FINE)
                np.clip(out, 0, _LEVELS - 1, out=out)
                decided = 2 * units.so_far(4 * half + j) + ((nibble >> (3 - j)) & 1)
                total += self.costs.take((decided << _LEVEL_BITS) + out.astype(np.int64))
        return total

    def shared_logs(self, shared: Shared) -> np.ndarray:
        """What `logs` gives for each pair, summed, with the mix of all contexts but the last made once where it is shared."""
        units, index = shared.local, shared.index
        n, total = len(units.bytes), np.zeros(len(shared.starts))
        for half, (nibble, groups) in enumerate(zip(units.nibbles, units.groups)):
            seen = self.seen.take(shared.last[half] >> 4)
            near = self.gate(half, [self.seen.take(groups[c] >> 4) for c in GATES[:-1]])
            kinds = np.flatnonzero(np.bincount(seen, minlength=4))
            mixed, last = np.full((len(kinds), 4 * n), _WIDE, np.float32), np.empty((len(kinds), n), np.float32)
            rows = [self.paths.take(group + nibble).view(np.int8) for group in groups]
            for i, kind in enumerate(kinds.tolist()):
                gate = near + (kind << (2 * len(GATES) - 1))
                alike = gate.min() == gate.max()
                for x, weights in zip(rows, self.weights):
                    mixed[i] += x * (weights[gate[0]] if alike else np.repeat(weights.take(gate), 4))
                last[i] = self.weights[-1].take(gate)
            cell = index
            if len(kinds) > 1:
                rank = np.zeros(4, np.int64)
                rank[kinds] = np.arange(len(kinds)) * n
                cell = rank.take(seen) + index
            out = mixed.reshape(-1).view(np.complex128).take(cell).view(np.float32)  # four bits are fetched as one item
            out += self.paths.take(shared.outcomes(half)).view(np.int8) * (last[0, 0] if (last == last[0, 0]).all() else np.repeat(last.reshape(-1).take(cell), 4))
            out *= np.float32(_FINE)
            np.clip(out, 0, _LEVELS - 1, out=out)
            decided = _DECIDED[half].take(shared.bytes).view(np.int32)
            decided += out.astype(np.int32)
            total += np.add.reduceat(self.costs.take(decided, mode="clip"), 4 * shared.starts, dtype=np.float64)
        return total

    def log10(self, vocabulary: Vocabulary, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the second word of each pair, with its space."""
        out = np.empty(len(keys))
        for which, shared in vocabulary.shared(keys):
            out[which] = self.shared_logs(shared) / math.log(10)
        return out


def without_own(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By outcome, the odds of each bit that led to it (not of a one) without one such bit, plus 128; how much a group has seen but one."""
    out = np.zeros((len(zeros) // 16, 16, 2), np.int8)
    out[:, :, 0] = -_odds(np.maximum(zeros - 1, 0), ones).reshape(-1, 16)
    out[:, :, 1] = _odds(zeros, np.maximum(ones - 1, 0)).reshape(-1, 16)
    return _paths(out) ^ _CENTRE, _seen((zeros + ones)[1::16] - 1)


class Sums:
    """What weights and adaptive table are learned from, in whole numbers, at the weights of START.

    Odds are those of the bit that came, so a decision and its mirror image are one: slopes and curvatures are alike for both.
    """

    SHAPES = ((_SETS, CONTEXTS), (_SETS, CONTEXTS, CONTEXTS), (2, 256 * _BINS))
    SIZE = sum(math.prod(x) for x in SHAPES)

    def __init__(self, paths: np.ndarray, seen: np.ndarray) -> None:
        self.paths, self.seen, self.all = paths, seen, np.zeros(self.SIZE, np.int64)
        self.slopes, self.curves, self.shown = self.parts(self.all)
        mixed = np.arange(-_FAR, _FAR) / (10 * _STEPS)
        p = 1 / (1 + np.exp(-mixed))
        self.slope = np.rint((1 - p) * _UNIT)  # by mixed log-odds
        self.curve = np.rint(p * (1 - p) * _UNIT)
        self.near = np.rint((np.clip(mixed, -8, 8) + 8) * ((_BINS - 1) / 16)).astype(np.int64)

    @classmethod
    def parts(cls, found: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([math.prod(x) for x in cls.SHAPES])
        return [x.reshape(shape) for x, shape in zip(np.split(found, cuts[:-1]), cls.SHAPES)]

    def add(self, vocabulary: Vocabulary, keys: np.ndarray, times: np.ndarray) -> None:
        """Add all decisions of the pairs; sums of a run are whole numbers below 2^53, so no order of adding rounds them."""
        shown = np.zeros((8, 256 * _BINS))  # by bit's place, byte and log-odds
        for which, shared in vocabulary.shared(keys):
            self._add(shared, np.repeat(times[which], shared.sizes).astype(np.float64), shown)
        for k, found in enumerate(shown.astype(np.int64)):
            found = found.reshape(1 << k, 2, -1, _BINS).sum(2)
            for bit, x in enumerate((found[:, 0, ::-1], found[:, 1])):
                self.shown[bit].reshape(256, _BINS)[1 << k : 2 << k] += x

    def _add(self, shared: Shared, times: np.ndarray, shown: np.ndarray) -> None:
        units, index, n = shared.local, shared.index, len(shared.local.bytes)
        for half, (nibble, groups) in enumerate(zip(units.nibbles, units.groups)):
            near = Mixer.gate(half, [self.seen.take(groups[c] >> 4) for c in GATES[:-1]])
            order = None if near.min() == near.max() else np.argsort(near.astype(np.uint8), kind="stable")
            slots = [group + nibble for group in groups]
            seen = self.seen.take(shared.last[half] >> 4)
            own = (self.paths.take(shared.outcomes(half)) ^ _CENTRE).view(np.int8).reshape(-1, 4)
            kinds = np.flatnonzero(np.bincount(seen, minlength=4)).tolist()
            for kind in kinds:
                this = slice(None) if len(kinds) == 1 else np.flatnonzero(seen == kind)
                cell, t, moments = index[this], times[this], np.empty((2, 4, n))
                for j in range(4):
                    o = own[this, j].astype(np.float64)
                    to = t * o
                    moments[0, j] = np.bincount(cell, to, n)
                    to *= o
                    moments[1, j] = np.bincount(cell, to, n)
                t = np.bincount(cell, t, n)
                kept = np.arange(n) if order is None else order
                if len(kinds) > 1:
                    kept = kept[t[kept] > 0]
                gates = near[kept]
                for gate in np.flatnonzero(np.bincount(gates)).tolist():
                    a, b = np.searchsorted(gates, [gate, gate + 1]).tolist()
                    for i in range(a, b, _CELLS):
                        x = kept[i : min(b, i + _CELLS)]
                        if order is None and len(kinds) == 1:
                            x = slice(i, i + len(x))
                        self._sum(half, gate + (kind << (2 * len(GATES) - 1)), [y[x] for y in slots], units.bytes[x], t[x], moments[:, :, x], shown)

    def _sum(self, half: int, gate: int, slots: list[np.ndarray], raw: np.ndarray, times: np.ndarray, moments: np.ndarray, shown: np.ndarray) -> None:
        """Add the decisions of bytes that have one set of weights; of the last context, the sums of its odds and of their squares."""
        rows = [self.paths.take(x) for x in slots]
        mixed = np.empty((4, len(raw)), np.int64)
        for j in (0, 1):  # two decisions in one number: their mixes are below 2^16
            both = sum((x >> np.uint32(8 * j) & _LANES) * np.uint32(w) for w, x in zip(START, rows) if w)
            mixed[j], mixed[j + 2] = both & np.uint32(0xFFFF), both >> np.uint32(16)
        row = raw * _BINS
        for j in range(4):
            shown[4 * half + j] += np.bincount(row + self.near.take(mixed[j], mode="clip"), times, 256 * _BINS)
        slope, curve = self.slope.take(mixed, mode="clip"), self.curve.take(mixed, mode="clip")
        x, y = np.empty((CONTEXTS - 1, 4, len(raw))), np.empty((CONTEXTS + 1, 4, len(raw)))
        for c, found in enumerate(rows):
            x[c] = (found ^ _CENTRE).view(np.int8).reshape(-1, 4).T
        self.slopes[gate, -1] += int(np.vdot(moments[0], slope))
        self.curves[gate, -1, -1] += int(np.vdot(moments[1], curve))
        np.multiply(moments[0], curve, out=y[-2])
        np.multiply(slope, times, out=y[-1])
        curve *= times
        np.multiply(x, curve, out=y[:-2])
        found = (x.reshape(len(x), -1) @ y.reshape(len(y), -1).T).astype(np.int64)
        self.curves[gate, :-1] += found[:, :-1]
        self.curves[gate, -1, :-1] += found[:, -2]
        self.slopes[gate, :-1] += found[:, -1]


def _hashed(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)


def _split(docs: DataFrame, held: int, of: int) -> DataFrame:
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of == held)


def _summed(tables: DataFrame, keys: list[str], kind: str = "<i8") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, data in zip(*(b[k].to_pylist() for k in [*keys, "data"])):
                found = np.frombuffer(data, kind).astype("<i8")
                held[tuple(key)] = held[tuple(key)] + found if tuple(key) in held else found
        for key, found in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([found.tobytes()], pa.binary())], names=[*keys, "data"])

    return tables.select(*keys, "data").mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", data binary")


def _training(docs: DataFrame, chars: int) -> DataFrame:
    """The training texts in as many partitions as there are cores, or more, of at most twice a block, about."""
    return docs.where("NOT held_out").select("text").coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // (2 * BLOCK_CHARS))))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Vocabulary, np.ndarray, np.ndarray]]:
    """The texts' pairs of words and how often each comes, over about _MOST_COUNTED characters together; what is summed over pairs may see a pair again."""

    def counted(texts: list[str]) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
        vocabulary = Vocabulary()
        keys = vocabulary.pairs(*vocabulary.read(texts))
        return vocabulary, *np.unique(keys, return_counts=True)

    texts, held = [], 0
    for b in batches:
        for text in b["text"].to_pylist():
            texts.append(text)
            held += len(text)
            if held > _MOST_COUNTED:
                yield counted(texts)
                texts, held = [], 0
    yield counted(texts)


def slot_counts(docs: DataFrame, chars: int = 0) -> np.ndarray:
    """Outcomes of all groups of slots over all tokens of all training documents, however they are dealt to tasks.

    Each task counts into a table of fixed size; tables are summed in two steps, by piece of the table and salt, then
    by piece, so no task gathers all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEAVES, np.int64)
        for found in _gathered(batches):
            counts += _outcomes(*found)
        for i, part in enumerate(np.split(counts, _CHUNKS)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary())], names=["chunk", "data"])

    tables = _training(docs, chars).mapInArrow(run, "chunk int, data binary")
    salted = tables.withColumn("salt", (F.spark_partition_id() / 16).cast("int"))
    pieces = _summed(_summed(salted.repartition("chunk", "salt"), ["chunk", "salt"], "<u4").repartition("chunk"), ["chunk"])
    out = np.zeros((_CHUNKS, LEAVES // _CHUNKS), np.int64)
    for row in pieces.collect():  # the table, of fixed size
        out[row["chunk"]] = np.frombuffer(row["data"], "<i8")
    return out.reshape(-1)


def learning_sums(docs: DataFrame, zeros: np.ndarray, ones: np.ndarray, chars: int = 0) -> np.ndarray:
    """Sums over all tokens of all training documents, however they are dealt to tasks; see Sums. Summed in two steps, as slots."""
    tables = docs.sparkSession.sparkContext.broadcast(without_own(zeros, ones))  # of fixed size: 4 LEAVES bytes and a 16th

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(*tables.value)
        for found in _gathered(batches):
            sums.add(*found)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sums.all.astype("<i8").tobytes()], pa.binary())], names=["chunk", "data"])

    found = _training(docs, chars).mapInArrow(run, "chunk int, data binary").withColumn("salt", (F.spark_partition_id() / 16).cast("int"))
    rows = _summed(_summed(found.repartition("chunk", "salt"), ["chunk", "salt"]).repartition("chunk"), ["chunk"]).collect()  # one
    return np.frombuffer(rows[0]["data"], "<i8") if rows else np.zeros(Sums.SIZE, np.int64)


def seen_before(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of the words `at` of texts of these sizes, how often its text had it before."""
    keys = np.repeat(np.arange(len(sizes)), sizes) * (int(at.max(initial=0)) + 1) + at
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=-1) != 0
    out = np.empty(len(at), np.int64)
    out[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return out


def score(docs: DataFrame, held: int = 0, of: int = 10) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null text is empty: its only token is the end. held_out: crc32(doc_id as text) mod `of` is `held`; a null doc_id counts
    as empty text there. Repeated rows are scored, and learned from, as often as they occur. Without training documents
    no token is known, N and V are 0, and the mixer predicts all bits alike. Extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = _split(documents(docs), held, of)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(partitions(spark), -(-chars // BLOCK_CHARS))
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def vocabulary(group: pa.Table) -> pa.Table:
        found = Vocabulary()
        at, sizes = found.read(group["text"].to_pylist())
        learned = np.repeat(~group["held_out"].to_numpy(), sizes)
        counts = np.bincount(at[learned], minlength=len(found))
        return pa.table({"block": pa.array(np.full(len(found), group["block"][0].as_py()), pa.int32()), "h": _hashed(found.found), "n": counts})

    local = blocked.select("block", "held_out", "text").groupBy("block").applyInArrow(vocabulary, "block int, h bigint, n bigint")
    same = Window.partitionBy("h")  # a row a block at most
    counts = stored(local.select("block", "h", F.sum("n").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("lead")), "words")
    n, v = counts.where("lead AND c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    zeros, ones = decisions(slot_counts(docs, chars))
    mixer = Mixer(zeros, ones)
    mixer.step(learning_sums(docs, zeros, ones, chars))
    shared = spark.sparkContext.broadcast(mixer)  # of fixed size: 5 LEAVES bytes, weights, tables of decisions

    def scored(texts: pa.Table, known: pa.Table) -> pa.Table:
        ids, held_out, vocabulary = texts["doc_id"], texts["held_out"], Vocabulary()
        at, sizes = vocabulary.read(texts["text"].to_pylist())
        pairs, which = _numbered(vocabulary.pairs(at, sizes))
        distinct, learned = vocabulary.found, shared.value.log10(vocabulary, pairs)
        h, c = known["h"].to_numpy(), known["c"].to_numpy()
        order = np.argsort(h)
        c = c[order][np.searchsorted(h[order], _hashed(distinct))] if len(at) else np.zeros(1)
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        lengths = vocabulary.sizes
        del vocabulary
        learned = learned[which]
        del which, pairs
        first = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        learned *= math.log(10)
        learned += math.log(PRIOR)
        with np.errstate(divide="ignore"):  # in logarithms: a long unknown word is less likely than the least double
            np.logaddexp(np.log(seen_before(at, sizes)), learned, out=learned)
        learned -= np.log(np.arange(len(at)) - np.repeat(first, sizes) + PRIOR)
        full = total(learned) / math.log(10)
        del learned
        return pa.table(
            {
                "doc_id": ids, "held_out": held_out, "n_tokens": sizes, "n_known": total((c > 0).astype(np.int64)[at]), "train_tokens": np.full(len(sizes), n, np.int64),
                "base_score": total(base[at]), "score": full, "bits_per_byte": -full * math.log2(10) / (total(lengths[at]) - 1),
            }
        )

    both = blocked.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(counts.select("block", "h", "c").groupBy("block"))
    return both.applyInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
