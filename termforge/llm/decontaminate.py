"""Benchmark decontamination by latent semantic retrieval, then word-order and answer checks.

1. Passages of STEP * 4 words are rows of a term-frequency matrix over 2^TERM_BITS hashed words. One distributed pass
   over all documents gives document frequencies and the sketch A'(A R) for a seeded random R; the driver, from these
   tables of fixed size, has the leading singular vectors of the TF-IDF matrix (single-pass randomised SVD, Nystrom).
2. An inverted index of each item's rarest words leaves out the passages that can't be leaks. A leak holds PARAPHRASE of
   the item's words, in order; so it holds HITS of any (1 - PARAPHRASE) n + HITS of its n words. The index has the rarest
   ones, and a stretch that holds fewer of them than that is passed over, without loss.
3. What is left is projected to the singular directions, which have equal weight: windows of an item's length, every half
   step, are compared with the item by cosine. Windows that reach COSINE are retrieved; the others stay candidates too,
   since the words that they share with the item could still make a leak: nothing is lost to the cosine, which a hit
   reports.
4. A candidate is a leak if the longest common subsequence of words with the item, in place, is LCS of the item; or
   PARAPHRASE of it, if the item's answer (its last sentence) is there too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.common import table
from termforge.llm.tokens import gathered, small_batches
from termforge.llm.words import hashed_words

#: RANK singular directions are used; MORE columns beyond them make the sketch of them accurate.
STEP, TERM_BITS, RANK, MORE = 8, 14, 32, 8
COSINE = 0.8
LCS, PARAPHRASE, ANSWER = 0.7, 0.5, 0.8
#: Characters of items, about, that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 8_000_000
#: Bits of the first look-up of a word in the index, and of the look-up of a word and an item.
INDEX_BITS, MEMBER_BITS = 20, 22
#: Words of stretches that are counted together.
COUNT_WORDS = 400_000
_CHUNKS = 16
_HITS = "doc_id bigint, item_id bigint, cosine double, common bigint, item_words bigint, answer_found boolean, start_word bigint, retrieved boolean"


def hashed_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, in order (lower-cased, marks at word ends dropped), and the number of each text's."""
    return hashed_words([t.lower().encode("utf-8", "replace") for t in texts], edges=True)


def hashed(text: str) -> np.ndarray:
    return hashed_texts([text])[0]


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TERM_BITS)).astype(np.int32)


def _random(seed: int = 13) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(1 << TERM_BITS, RANK + MORE)).astype(np.float32)


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for w in b:
        u = s & where.get(w, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _sketch(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Document frequency of every term over passages, A'(A R), and the number of passages.

    A task sends tables of fixed size, in pieces; pieces are summed by piece and salt, then by piece.
    """
    size, cols = 1 << TERM_BITS, RANK + MORE + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, width = _random(), STEP * 4
        out = np.zeros((cols, size))
        for group in gathered(((None, t) for b in batches for t in b["text"].to_pylist() if t), 600_000):
            terms, sizes = hashed_texts([t for _, t in group])
            terms, sizes = _terms(terms), sizes[sizes > 0]
            if not len(terms):
                continue
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(terms)) - np.repeat(first, sizes)
            starts = np.flatnonzero(place % width == 0)
            passage = np.cumsum(place % width == 0) - 1
            y = np.add.reduceat(omega.take(terms, 0), starts, 0)
            order = np.argsort(terms.astype(np.uint16), kind="stable")  # by term, and by passage within one
            term, passage = terms[order], passage[order]
            new = np.diff(term, prepend=-1) != 0
            begin = np.flatnonzero(new)
            out[: RANK + MORE, term[begin]] += np.add.reduceat(y.take(passage, 0), begin, 0).T
            new[1:] |= passage[1:] != passage[:-1]
            out[RANK + MORE] += np.bincount(term[new], minlength=size)
            out[RANK + MORE + 1, 0] += len(starts)
        for i, part in enumerate(np.split(out, _CHUNKS, 1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "data"])

    def add(keys: list[str]):
        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            for b in batches:
                for *key, data in zip(*(b[k].to_pylist() for k in [*keys, "data"])):
                    x = np.frombuffer(data)
                    held[tuple(key)] = held[tuple(key)] + x if tuple(key) in held else x
            for key, x in held.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([x.tobytes()], pa.binary())], names=[*keys, "data"])

        return total

    tables = docs.select("text").mapInArrow(run, "chunk int, data binary").withColumn("salt", (F.spark_partition_id() / 16).cast("int"))
    salted = tables.repartition("chunk", "salt").mapInArrow(add(["chunk", "salt"]), "chunk int, salt int, data binary")
    pieces = salted.select("chunk", "data").repartition("chunk").mapInArrow(add(["chunk"]), "chunk int, data binary")
    out = np.zeros((_CHUNKS, cols, size // _CHUNKS))
    for row in pieces.collect():  # tables of fixed size
        out[row["chunk"]] = np.frombuffer(row["data"]).reshape(cols, -1)
    out = np.concatenate(list(out), 1)
    return out[RANK + MORE], out[: RANK + MORE].T, int(out[RANK + MORE + 1, 0])


def directions(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A row for each term: its weight in the leading singular directions of TF-IDF, which have equal weight; and the
    number of passages that each term is in."""
    df, g, n = _sketch(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    omega = _random().astype(float)
    y, core = idf[:, None] * g, omega.T @ g
    core = (core + core.T) / 2
    shift = 1e-7 * max(1.0, np.linalg.norm(y))
    y, core = y + shift * omega / idf[:, None], core + shift * (omega / idf[:, None]).T @ (omega / idf[:, None])
    values, vectors = np.linalg.eigh(core)
    good = values > 1e-9 * max(values[-1], 1e-30)
    root = vectors[:, good] / np.sqrt(values[good])
    u, s, _ = np.linalg.svd(y @ root, full_matrices=False)
    k = min(RANK, int((s > 1e-6 * s[0]).sum())) if len(s) else 0
    return np.ascontiguousarray((idf[:, None] * u[:, :k] / np.maximum(s[:k], 1e-12)).astype(np.float32)), df


def _needed(n: int) -> int:
    """Words of an item of n that every leak of it holds."""
    return max(1, math.ceil(PARAPHRASE * n - 1e-9))


def _subsequence(matched: list[int], full: int) -> int:
    """Length of the longest common subsequence, from the places in the item, as bits, of each word of a stretch."""
    s = full
    for m in matched:
        u = s & m
        s = (s + u | s - u) & full
    return full.bit_length() - s.bit_count()


class Items:
    """Benchmark items and the index of their rarest words, for the search in documents."""

    def __init__(self, rows: list[tuple[int, str]], weights: np.ndarray, df: np.ndarray | None = None) -> None:
        self.ids, self.words, self.answers, self.weights = [], [], [], weights
        rare, owner = [], []
        for item, text in rows:
            h = hashed(text or "")
            if not len(h):
                continue
            last = [hashed(s) for s in re.split(r"(?<=[.!?])\s+", text.strip())]
            last = [s for s in last if len(s) >= 2]
            often = df[_terms(h)] if df is not None else np.zeros(len(h))
            places = np.lexsort((h, often))[: len(h) - _needed(len(h)) + self._hits(len(h))]
            found = np.unique(h[places])
            rare.append(found)
            owner.append(np.full(len(found), len(self.ids)))
            self.ids.append(item)
            self.words.append(h.tolist())
            self.answers.append(last[-1].tolist() if last else h.tolist())
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.hits = np.array([self._hits(n) for n in self.sizes.tolist()], np.int64)
        words, items = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (rare, owner))
        order = np.argsort(words, kind="stable")
        words, self.items = words[order], items[order].astype(np.int64)
        self.rare, self.first, self.many = np.unique(words, return_index=True, return_counts=True)
        self.flags = np.zeros(1 << INDEX_BITS, bool)
        self.flags[self.rare >> np.uint64(64 - INDEX_BITS)] = True
        self.members = np.zeros(1 << MEMBER_BITS, bool)
        if self.words:
            every = np.concatenate([np.array(w, np.uint64) for w in self.words])
            self.members[self._member(every, np.repeat(np.arange(len(self.words)), self.sizes))] = True
        self.places: dict[int, dict[int, int]] = {}

    @staticmethod
    def _member(words: np.ndarray, items: np.ndarray) -> np.ndarray:
        return (words ^ items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - MEMBER_BITS)

    @staticmethod
    def _hits(n: int) -> int:
        return max(1, _needed(n) // 3)

    def _stretches(self, words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of all stretches of one document's words where a leak of the item may lie."""
        at = np.flatnonzero(self.flags[words >> np.uint64(64 - INDEX_BITS)])
        if not len(at):
            return []
        row = np.minimum(np.searchsorted(self.rare, words[at]), len(self.rare) - 1)
        same = self.rare[row] == words[at]
        at, row = at[same], row[same]
        if not len(at):
            return []
        many = self.many[row]
        pos = np.repeat(at, many)
        item = self.items[np.repeat(self.first[row] - np.cumsum(many) + many, many) + np.arange(len(pos))]
        order = np.argsort(item * len(words) + pos)
        item, pos = item[order], pos[order]
        reach = self.sizes[item] + 2 * STEP
        last = np.arange(len(pos)) + self.hits[item] - 1
        good = last < len(pos)
        last = np.minimum(last, len(pos) - 1)
        end = pos[last]
        good &= (item[last] == item) & (end - pos < reach) & (owner[end] == owner[pos])
        item, low, high, reach = item[good], pos[good], end[good], reach[good]
        if not len(item):
            return []
        # every stretch as long as a leak that holds these words; those that overlap are one
        start, end = high - reach + 1, low + reach
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (owner[low[1:]] != owner[low[:-1]]) | (start[1:] > end[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(item)) - 1
        doc = owner[low[begin]]
        first, beyond = np.searchsorted(owner, doc), np.searchsorted(owner, doc, "right")
        item, start, end = item[begin], np.maximum(start[begin], first), np.minimum(end[stop], beyond)
        found = np.cumsum(end - start)
        cuts = [0, *np.searchsorted(found, np.arange(COUNT_WORDS, found[-1], COUNT_WORDS)).tolist(), len(item)]
        kept = np.concatenate([a + self._full(words, item[a:b], start[a:b], end[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b])
        return list(zip(item[kept].tolist(), start[kept].tolist(), end[kept].tolist()))

    def _full(self, words: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the stretches in which as many words as a leak needs are the item's, as close together as in one."""
        sizes = end - start
        of = np.repeat(np.arange(len(item)), sizes)
        pos = np.arange(len(of)) + np.repeat(start - np.cumsum(sizes) + sizes, sizes)
        held = np.flatnonzero(self.members[self._member(words[pos], item[of])])
        of, pos = of[held], pos[held]
        n = self.sizes[item[of]]
        last = np.arange(len(of)) + np.maximum(1, np.ceil(PARAPHRASE * n - 1e-9).astype(np.int64)) - 1
        good = last < len(of)
        last = np.minimum(last, len(of) - 1)
        good &= (of[last] == of) & (pos[last] - pos < n + 2 * STEP)
        return np.unique(of[good])

    def _cosine(self, item: int, terms: np.ndarray) -> float:
        """The highest cosine with the item of the windows of its length, every half step."""
        if not self.weights.shape[1]:
            return 0.0
        n = len(self.words[item])
        own = self.weights[_terms(np.array(self.words[item], np.uint64))].sum(0)
        sums = np.concatenate([np.zeros((1, len(own))), np.cumsum(self.weights.take(terms, 0), 0, np.float64)])
        a = np.arange(0, max(1, len(terms) - n + 1), STEP // 2)
        there = sums[np.minimum(a + n, len(terms))] - sums[a]
        return float((there @ own / np.maximum(np.linalg.norm(there, axis=1) * np.linalg.norm(own), 1e-12)).max())

    def _leak(self, item: int, words: np.ndarray) -> tuple | None:
        """(cosine, common, item words, answer found, start, retrieved) of the best leak in a stretch of words."""
        own = self.words[item]
        n, need = len(own), _needed(len(own))
        if item not in self.places:
            places: dict[int, int] = {}
            for i, w in enumerate(own):
                places[w] = places.get(w, 0) | 1 << i
            if len(self.places) > 10_000:
                self.places.clear()
            self.places[item] = places
        places = self.places[item]
        held = [(i, m) for i, w in enumerate(words.tolist()) if (m := places.get(w))]
        if len(held) < need:
            return None
        at, matched, full = [i for i, _ in held], [m for _, m in held], (1 << n) - 1
        if _subsequence(matched, full) < need:
            return None
        cosine = self._cosine(item, _terms(words))
        best, low, high, reach, text = None, 0, 0, n + 2 * STEP, None
        for low in range(len(at)):  # a window matters from each of the words in common
            while high < len(at) and at[high] < at[low] + reach:
                high += 1
            if high - low < max(need, best[0] + 1 if best else 0):
                continue
            common = _subsequence(matched[low:high], full)
            if common < need or best and common <= best[0]:
                continue
            text = words.tolist() if text is None else text
            begin = max(0, at[low])
            answer = common_words(self.answers[item], text[begin : begin + reach]) >= ANSWER * len(self.answers[item])
            if common >= LCS * n or answer:
                best = (common, bool(answer), begin)
            if common == n and answer:
                break
        return (cosine, best[0], n, best[1], best[2], cosine >= COSINE) if best else None

    def leaks(self, texts: list[str]) -> list[list[tuple]]:
        """For each text its hits: (item_id, cosine, common, item words, answer found, start word, retrieved)."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.words or not texts:
            return out
        words, sizes = hashed_texts(texts)
        owner, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
        best: dict[tuple[int, int], tuple] = {}
        for item, start, end in self._stretches(words, owner):
            doc = int(owner[start])
            hit = self._leak(item, words[start:end])
            if hit and ((doc, item) not in best or hit[1] > best[doc, item][1]):
                best[doc, item] = (*hit[:4], hit[4] + start - int(first[doc]), hit[5])
        for (doc, item), hit in sorted(best.items()):
            out[doc].append((self.ids[item], *hit))
        return out


def _blocks(benchmark: DataFrame, weights: np.ndarray, df: np.ndarray) -> Iterator[Items]:
    """Items in blocks of BLOCK_CHARS characters, about; twice that at most, but for a single item beyond it."""
    numbered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    chars, items, longest = numbered.agg(F.sum(F.length("text")), F.count("*"), F.max(F.length("text"))).first()
    blocks = -(-(chars or 0) // BLOCK_CHARS) if items else 0
    number = lambda: F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    while 1 < blocks < 4 * items:
        if numbered.groupBy(number().alias("b")).agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= max(2 * BLOCK_CHARS, longest):
            break
        blocks *= 2
    for i in range(blocks):
        rows = numbered.where(number() == i).collect()
        if rows:
            yield Items(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in rows), weights, df)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and the benchmark item that it contains: doc_id, item_id, cosine, common, item_words,
    answer_found, start_word, retrieved (the cosine alone would have found it).

    Null or empty texts and items have no leaks; items without item_id count as -1. Rows with one doc_id are searched
    each and give rows each. Every window of a whole text is searched. Extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    (weights, df), out = directions(docs), None
    for items in _blocks(benchmark, weights, df):
        shared = spark.sparkContext.broadcast(items)  # of a bounded size, see _blocks

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for group in gathered(((d, t) for b in batches for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) if t), 600_000):
                rows = [(d, *hit) for (d, _), hits in zip(group, shared.value.leaks([t for _, t in group])) for hit in hits]
                if rows:
                    d, item, cos, common, n, answer, at, retrieved = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64()), pa.array(item, pa.int64()), pa.array(cos, pa.float64()), pa.array(common, pa.int64()), pa.array(n, pa.int64()), pa.array(answer, pa.bool_()), pa.array(at, pa.int64()), pa.array(retrieved, pa.bool_())],
                        names=[x.split()[0] for x in _HITS.split(", ")],
                    )

        found = docs.mapInArrow(run, _HITS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], _HITS)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item, as they are; null texts stay."""
    spark = docs.sparkSession
    small_batches(spark)
    weights, df = directions(docs)
    for items in _blocks(benchmark, weights, df):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for group in gathered(((i, t) for i, t in enumerate(b["text"].to_pylist()) if t), 600_000):
                    for (i, _), hits in zip(group, shared.value.leaks([t for _, t in group])):
                        clean[i] = not hits
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
