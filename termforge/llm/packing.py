"""Order-preserving packing of token sequences by dynamic programming.

Documents, in ascending doc_id, form one stream of ids in each id range. The stream is cut into windows of at
most WINDOW ids. A cut costs nothing at a document's end, SENTENCE at a sentence's end and HARD elsewhere
(allowed every GRID ids of a sentence longer than that); a window of n ids costs its padding, WINDOW - n, or
nothing where n is a power of two. The least total is found by

    cost[j] = penalty[j] + min(min over windows (cost[i] + WINDOW - (at[j] - at[i])), min over i with at[j] - at[i] a power of two (cost[i]))

where the first minimum is over at[j] - at[i] <= WINDOW and comes from a monotone queue of cost[i] + at[i]:
every cut enters and leaves it once.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.common import documents, partitions, table
from termforge.llm.tokens import TOKENIZER, encoder_for, gathered, small_batches, with_end

WINDOW, END = 2048, 1
SENTENCE, HARD, GRID = 4, 24, 256
#: Ids that are planned together, about; the last window of each is planned again with the next ids.
BLOCK_IDS = 1 << 20
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def allowed_cuts(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions from 0 to total, and their penalties."""
    kind = np.full(total + 1, -1, np.int16)
    kind[sentence_ends] = SENTENCE
    kind[doc_ends] = 0
    kind[0] = kind[total] = 0
    at = np.flatnonzero(kind >= 0)
    wide = np.flatnonzero(np.diff(at) > GRID)
    for i in wide:
        kind[at[i] + GRID : at[i + 1] : GRID] = HARD
    at = np.flatnonzero(kind >= 0)
    return at, kind[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices into at of the cheapest cuts, the first and the last included."""
    powers = 1 << np.arange(window.bit_length(), dtype=np.int64)
    pairs = []
    for p in powers[powers <= window]:
        found = np.searchsorted(at, at - p)
        hit = np.flatnonzero((at >= p) & (at[np.minimum(found, len(at) - 1)] == at - p))
        pairs.append(np.stack([hit, found[hit]], 1))
    pairs = np.concatenate(pairs)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    first = np.searchsorted(pairs[:, 0], np.arange(len(at) + 1)).tolist()
    source, where, fee = pairs[:, 1].tolist(), at.tolist(), penalty.tolist()
    cost, back = [0] * len(where), [0] * len(where)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # cost[i] + at[i], i
    for j in range(1, len(where)):
        here = where[j]
        while where[queue[0][1]] < here - window:
            queue.popleft()
        least, i = queue[0]
        least += window - here
        for k in source[first[j] : first[j + 1]]:
            if cost[k] <= least:
                least, i = cost[k], k
        cost[j], back[j] = least + fee[j], i
        key = cost[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [len(where) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Packer:
    """Packs the documents of one id range; emits pieces as soon as their windows are settled."""

    def __init__(self, part: int, window: int = WINDOW) -> None:
        self.window, self.next = window, part << 32
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(0, np.int64)
        #: doc_id, its ids, and how many of them are settled, of the documents in hand
        self.docs: list[list] = []

    def add(self, names: list, ids: np.ndarray, lengths: np.ndarray, sentence_ends: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, sentence_ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.docs += [[name, n, 0] for name, n in zip(names, lengths.tolist())]

    def settle(self, last: bool = False) -> pa.RecordBatch | None:
        if not len(self.ids):
            return None
        left = np.array([n - done for _, n, done in self.docs])
        doc_ends = np.cumsum(left)
        at, penalty = allowed_cuts(len(self.ids), doc_ends, self.ends)
        cuts = at[best_cuts(at, penalty, self.window)]
        cuts = cuts if last else cuts[:-1]
        if len(cuts) < 2:
            return None
        stop = int(cuts[-1])
        edges = np.union1d(cuts, doc_ends[doc_ends < stop])
        begin, length = edges[:-1], np.diff(edges)
        doc, seq = np.searchsorted(doc_ends, begin, "right"), np.searchsorted(cuts, begin, "right") - 1
        done = np.array([d[2] for d in self.docs])
        raw = memoryview(self.ids.astype("<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        out = [
            pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
            pa.array(begin - (doc_ends - left)[doc] + done[doc]),
            pa.array(length),
            pa.array(crc, pa.int64()),
            pa.array(np.array([d[1] for d in self.docs])[doc]),
            pa.array(self.next + seq),
            pa.array(begin - cuts[seq]),
        ]
        self.next += len(cuts) - 1
        kept = int(np.searchsorted(doc_ends, stop, "right"))
        if kept < len(self.docs):
            self.docs[kept][2] += stop - int((doc_ends - left)[kept])
        self.docs, self.ids, self.ends = self.docs[kept:], self.ids[stop:], self.ends[self.ends > stop] - stop
        return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty: its document is the end id alone. Rows with one doc_id are packed as documents of
    their own, ordered by text; rows without doc_id come first. A text longer than a window is cut into
    several. An empty table gives no rows. Extra columns are ignored. Only the last window of an id range
    is left short.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_for(tokenizer), None
        rows = (((b["part"][0].as_py(), name), text) for b in batches if b.num_rows for name, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()))
        for group in gathered(rows):
            packer = packer or Packer(group[0][0][0], window)
            ids, lengths, ends = encoder.encode([t for _, t in group])
            cut_off = np.cumsum(lengths)
            ends = ends + np.searchsorted(cut_off, ends, "left")  # each text's ids are followed by one more
            packer.add([k[1] for k, _ in group], *with_end(ids, lengths, end), ends)
            if len(packer.ids) >= BLOCK_IDS and (out := packer.settle()) is not None:
                yield out
        if packer and (out := packer.settle(last=True)) is not None:
            yield out

    ranged = documents(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    return ranged.mapInArrow(run, _PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
