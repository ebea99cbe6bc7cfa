"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct word shingles, hashed to 64 bits. The hashes are dealt to 2^BUCKET_BITS buckets;
each keeps, of its least hash, the number of leading zeros and the next MANTISSA bits: 16 bits a register. Runs of
BAND registers are band keys, and documents with a key in common are candidates. The Jaccard similarity of
candidates is estimated from the registers, corrected for registers that agree by accident, and pairs within
reach of the threshold are confirmed on their full sets.

Small sets leave most registers empty, so for sets of at most SMALL shingles the hashes are kept (the sparse form of
the sketch) and dealt to one part more than the shingles by which a pair at the threshold can differ, and a few
to spare: a part in which the pair agrees is left. Empty parts have no key, so a set that fills no more parts than
it can differ by is dealt anew, with other hashes, until it fills more: then one that it fills agrees, and of a pair
the set that stops first meets the other there. Sets meet in the size class of the larger one.

Equal sets are one node of the graph of links, so copies are never paired. Pairs are never written out either:

1. Rows of one key are compared in place by a short form of their registers, and only a spanning forest of the pairs
   that may be links goes on. Its components are clusters: every link is inside one.
2. Members of a cluster are compared in place, by registers and then by full sets, unless links found before connect
   them already; a spanning forest of the confirmed links goes on. Its components are the result.

No task holds a key or cluster of many rows whole. First each of its rows is compared in one block only, another one for
every key or round, which connects a group of near copies at a cost in proportion to its rows. What is still apart after
that is compared in full: the rows beyond the most frequent component with all rows, or, if they are many, all pairs of
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.common import documents, stored, table
from termforge.llm.components import connected
from termforge.llm.tokens import gathered, small_batches
from termforge.llm.words import hashed_words, mixed

BUCKET_BITS, MANTISSA, BAND = 8, 10, 6
SMALL, SPARE = 128, 3
#: Ways at most in which a small set is dealt to parts.
DEALS = 16
#: Registers in the short form, a byte each.
BRIEF = 128
#: Standard errors below the threshold down to which an estimate is followed up.
ERRORS = 4.5
#: One key in so many is looked at first.
FIRST_KEYS = 6
#: Rows of a block of a key, and members and bytes of sets of a block of a cluster, about.
KEY_BLOCK, CLUSTER_BLOCK, CLUSTER_BYTES = 1024, 512, 8 << 20
#: Rounds of comparing the members of a large cluster in one block each.
ROUNDS = 2
#: Rows of a table of large groups (three numbers each) up to which it is broadcast; a longer one is joined by shuffle.
MOST_BROADCAST = 200_000
#: Bits of the filter of documents that have candidates; where more documents have some, more are read again.
FILTER_BITS = 24
EMPTY = 0xFFFF
_SKETCH = "doc_id bigint, text_id bigint, n_shingles bigint, node bigint, keys array<bigint>, brief binary"


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of `width` words (A-Z lower-cased).

    A text with fewer words has one shingle, of all of them; a text without words has none.
    """
    return _shingles(hashed_words([text.encode("utf-8", "replace").lower()])[0], width)


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    if not len(h):
        return h
    width = min(width, len(h))
    found = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        found = found * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    found = mixed(found + np.uint64(width))
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def all_shingles(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """`shingles` of each text; words of some texts are hashed together."""
    for group in gathered(((None, t) for t in texts), 500_000):
        h, sizes = hashed_words([t.encode("utf-8", "replace").lower() for _, t in group])
        yield from (_shingles(x, width) for x in np.split(h, np.cumsum(sizes)[:-1]))


def _node(hashes: np.ndarray) -> int | None:
    """A 64-bit hash of a whole set; of all pairs of n different sets, n^2 / 2^65 are expected to collide."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "big", signed=True) if len(hashes) else None


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of sorted hashes: leading zeros, then mantissa bits, of each bucket's least."""
    at = np.searchsorted(hashes, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
    least = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & (least >> np.uint64(64 - BUCKET_BITS) == np.arange(1 << BUCKET_BITS, dtype=np.uint64))
    rest = ((least << np.uint64(BUCKET_BITS)) >> np.uint64(11)).astype(np.float64)  # 53 bits: exact
    share, power = np.frexp(np.maximum(rest, 1))
    out = ((53 - power) << MANTISSA) | ((share * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(full, out, EMPTY).astype(np.uint16)


def brief(regs: np.ndarray) -> np.ndarray:
    """A byte for each of the first BRIEF registers: 0 if it is empty, else a hash from 1 to 255."""
    r = regs[:BRIEF].astype(np.uint64)
    return np.where(r == EMPTY, 0, 1 + mixed(r + np.uint64(1)) % np.uint64(255)).astype(np.uint8)


def size_classes(threshold: float) -> list[int]:
    """Upper sizes of the classes of small sets."""
    out = [1]
    while out[-1] < SMALL:
        out.append(min(SMALL, max(out[-1] + 1, int(out[-1] / threshold))))
    return out


def _key(parts: np.ndarray, *tags: np.ndarray | int) -> np.ndarray:
    for t in tags:
        parts = mixed(parts * np.uint64(0x9E3779B97F4A7C15) + np.asarray(t).astype(np.uint64))
    return parts


def band_keys(hashes: np.ndarray, regs: np.ndarray, threshold: float, classes: list[int]) -> np.ndarray:
    """The keys under which a set meets others of at least the threshold."""
    n, found = len(hashes), []
    reach, differ = int(n / threshold + 1e-9), int((1 - threshold) / threshold * n + 1e-9)
    for c, high in enumerate(classes):
        if high >= n and (not c or classes[c - 1] < reach):
            parts = int((1 - threshold) / threshold * high + 1e-9) + SPARE
            for deal in range(DEALS):
                dealt = mixed(hashes + np.uint64(deal)) if deal else hashes
                part = ((dealt >> np.uint64(20)) & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                part = part[order]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                found.append(_key(np.add.reduceat(mixed(hashes[order]), first), part[first], 1000 * (deal + 1) + c))
                if len(first) > differ:
                    break
    if reach > classes[-1]:
        bands = len(regs) // BAND
        rows = regs[: bands * BAND].reshape(bands, BAND).astype(np.uint64)
        full = np.flatnonzero((rows != EMPTY).any(1))
        keys = np.zeros(bands, np.uint64)
        for k in range(BAND):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        found.append(_key(keys, np.arange(bands), 1)[full])
    return np.concatenate(found)


def sketches(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, text_id (hash of the text), n_shingles, node (hash of the whole set; null without shingles), keys, brief registers."""
    classes = size_classes(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            sizes, nodes, keys, regs = [], [], [], []
            for h in all_shingles(b["text"].to_pylist(), width):
                sizes.append(len(h))
                if not len(h):
                    nodes.append(None), keys.append(None), regs.append(None)
                    continue
                r = registers(h)
                nodes.append(_node(h))
                keys.append(band_keys(h, r, threshold, classes).view(np.int64))
                regs.append(brief(r).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["text_id"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(regs, pa.binary())],
                names=["doc_id", "text_id", "n_shingles", "node", "keys", "brief"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")).mapInArrow(run, _SKETCH)


class _Forest:
    """Union-find that says whether a pair is new."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def _joined(rows: DataFrame, small: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """rows with the columns of a stored table of large groups, which is broadcast up to MOST_BROADCAST rows."""
    return rows.join(F.broadcast(small) if small.count() <= MOST_BROADCAST else small, by, how)


def _once(rows: DataFrame, by: str, salt: int = 0) -> DataFrame:
    """rows with `blocks` -> each in one block (i, i) of its group, another one for every group and salt."""
    own = F.pmod(F.xxhash64("node", by, F.lit(salt)), F.col("blocks"))
    return _sorted(rows.withColumns({"own": own, "i": own, "j": own}), by)


def _apart(rows: DataFrame, by: str, label: str, most: int) -> DataFrame:
    """rows with `blocks` and labels of what is connected -> so many pairs of blocks (i, j) that all rows of different labels
    of a group meet; groups of one label are left out.

    If at most `most` rows of a group are not of its most frequent label, these are in each of its blocks, and the others
    in one; else every row is in as many pairs of blocks as there are blocks.
    """
    labels = rows.groupBy(by, label).agg(F.count("*").alias("c")).groupBy(by)
    groups = labels.agg(F.count("*").alias("many"), F.sum("c").alias("rows"), F.max(F.struct("c", label)).alias("top")).where("many > 1")
    groups = stored(groups.select(by, F.col(f"top.{label}").alias("top"), (F.col("rows") - F.col("top.c") <= most).alias("few")), "apart")
    own, every = F.pmod(F.xxhash64("node"), F.col("blocks")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    rows = _joined(rows, groups, by).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.when(F.col("few") & (F.col(label) == F.col("top")), F.array("own")).otherwise(every)))
    rows = rows.withColumn("i", F.when(F.col("few"), F.col("other")).otherwise(F.least("own", "other")))
    return _sorted(rows.withColumn("j", F.when(F.col("few"), F.col("other")).otherwise(F.greatest("own", "other"))).drop("other", "top", "few"), by)


def _sorted(rows: DataFrame, by: str) -> DataFrame:
    return rows.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j", "node")


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of whole groups (by, i, j), about a batch at a time, and the last group in hand until it is whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b[c].to_numpy() for c in (by, "i", "j")])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
        if held and any(held[-1][c][-1].as_py() != b[c][0].as_py() for c in (by, "i", "j")):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
            b = b.slice(cut)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _groups(rows: pa.Table, by: str) -> np.ndarray:
    """Numbers of the groups (by, i, j) of sorted rows."""
    keys = np.stack([rows[c].to_numpy() for c in (by, "i", "j")])
    return np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))])


def candidate_forest(rows: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, own, label, n, brief), as dealt to blocks -> pairs (a, b) of labels that span, in each task, what may be linked under a common key.

    Nodes of one label are known to be in one cluster and aren't compared.
    """
    t = percent / 100
    rows = rows.select("key", "i", "j", "own", "label", "n", "brief")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for rows in _runs(batches, "key"):
            group, node, n, own = _groups(rows, "key"), rows["label"].to_numpy(), rows["n"].to_numpy(), rows["own"].to_numpy()
            regs = np.frombuffer(b"".join(rows["brief"].to_pylist()), np.uint8).reshape(-1, BRIEF)
            square = rows["i"].to_numpy() == rows["j"].to_numpy()
            at, a, b, lag = np.arange(len(node)), [], [], 1
            while len(at := at[: np.searchsorted(at, len(node) - lag)]) and len(at := at[group[at] == group[at + lag]]):
                x, y = at, at + lag
                fit = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (node[x] != node[y]) & (square[x] | (own[x] != own[y]))
                x, y = x[fit], y[fit]
                if len(x):
                    p, q = regs[x], regs[y]
                    used = ((p > 0) | (q > 0)).sum(1)
                    found = (((p == q) & (p > 0)).sum(1) / np.maximum(used, 1) - 1 / 255) / (1 - 1 / 255)
                    near = (used == 0) | (found >= t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(used, 1)))
                    a.append(node[x[near]])
                    b.append(node[y[near]])
                lag += 1
            if a:
                pairs = [(x, y) for x, y in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist()) if forest.join(x, y)]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])
            if len(forest.above) > 500_000:
                forest = _Forest()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each of 2^FILTER_BITS hashes of a doc_id: what goes to the driver has that fixed size at most."""
    h = F.xxhash64("doc_id").bitwiseAND((1 << FILTER_BITS) - 1)
    words = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits"))
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    found = words.toPandas()
    out[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def sets_of(clusters: DataFrame, docs: DataFrame, sketch: DataFrame, width: int) -> DataFrame:
    """(node, root) -> node, root, n, hashes: the full set of every node, from the text of its first document."""
    spark = docs.sparkSession
    needed = stored(sketch.join(clusters, "node").groupBy("node", "root").agg(F.min("doc_id").alias("doc_id")), "needed")
    bits = spark.sparkContext.broadcast(_filter_of(needed))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        words = bits.value
        for b in batches:
            h = b["h"].to_numpy().view(np.uint64)
            at = np.flatnonzero(words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1))
            if len(at):
                some = b.take(pa.array(at))
                found = list(all_shingles(some["text"].to_pylist(), width))
                nodes = [_node(h) for h in found]
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(nodes, pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["doc_id", "node", "n", "hashes"])

    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND((1 << FILTER_BITS) - 1).alias("h"))
    found = hashed.mapInArrow(sets, "doc_id bigint, node bigint, n bigint, hashes binary").join(needed, ["doc_id", "node"])
    return stored(found.dropDuplicates(["node"]).select("node", "root", "n", "hashes"), "sets")


def confirmed_links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root, n, hashes) -> links (a, b) with 100 * intersection >= percent * union that connect what such links connect."""
    sizes = sets.groupBy("root").agg(F.count("*").alias("k"), F.sum(8 * F.col("n")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("k") / CLUSTER_BLOCK), F.least(F.ceil(F.col("bytes") / CLUSTER_BYTES), F.col("k")))
    large = stored(sizes.select("root", blocks.alias("blocks")).where("blocks > 1"), "large")
    sets = _joined(sets, large, "root", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1).cast("long")), "label": F.col("node")})
    links = stored(confirmed_forest(_once(sets, "root"), percent), "links")
    if large.isEmpty():
        return links
    sets = sets.where("blocks > 1").drop("label")
    labelled = lambda: sets.join(connected(links).withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    for salt in range(1, ROUNDS):
        links = links.unionByName(stored(confirmed_forest(_once(labelled(), "root", salt), percent), "links"))
    return links.unionByName(stored(confirmed_forest(_apart(labelled(), "root", "label", CLUSTER_BLOCK), percent), "links"))


def confirmed_forest(rows: DataFrame, percent: int) -> DataFrame:
    """(root, i, j, own, node, label, n, hashes), as dealt to blocks -> links (a, b) of nodes that span those of each block.

    Nodes of one label are known to be connected and aren't compared.
    """
    t = percent / 100
    rows = rows.select("root", "i", "j", "own", "node", "label", "n", "hashes")

    def compare(node: list[int], label: np.ndarray, sets: list[np.ndarray], own: np.ndarray, square: bool) -> list[tuple[int, int]]:
        n = np.array(list(map(len, sets)))
        forest, out, known = _Forest(), [], label.tolist()
        regs = np.stack([registers(h) for h in sets]) if len(sets) > 2 else None
        for x in range(len(node)):
            y = np.arange(x + 1, len(node))
            y = y[(100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (square | (own[x] != own[y])) & (label[x] != label[y])]
            if regs is not None and len(y):
                used = (regs[x] != EMPTY) | (regs[y] != EMPTY)
                count = np.maximum(used.sum(1), 1)
                high, low = np.maximum(n[x], n[y]), np.minimum(n[x], n[y])
                chance = 0.1699194871597391 * 2 ** (BUCKET_BITS - MANTISSA) * (4 * high / low) / (1 + high / low) ** 2
                found = (((regs[x] == regs[y]) & used).sum(1) - chance) / count
                near = found >= t - ERRORS * np.sqrt(t * (1 - t) / count)
                y = y[near][np.argsort(-found[near], kind="stable")]
            for k in y.tolist():
                if forest.root(known[x]) == forest.root(known[k]):
                    continue
                both = np.concatenate([sets[x], sets[k]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common) and forest.join(known[x], known[k]):
                    out.append((node[x], node[k]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for rows in _runs(batches, "root"):
            group = _groups(rows, "root")
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist()
            node, label, own, square = rows["node"].to_pylist(), rows["label"].to_numpy(), rows["own"].to_numpy(), (rows["i"].to_numpy() == rows["j"].to_numpy())
            hashes = [np.frombuffer(h, np.uint64) for h in rows["hashes"].to_pylist()]
            links = [x for a, b in zip(starts, [*starts[1:], len(node)]) if b - a > 1 for x in compare(node[a:b], label[a:b], hashes[a:b], own[a:b], bool(square[a]))]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_id (hash of the text) for every row of docs.

    Rows with equal sets or linked sets share component_id, the least doc_id among them. Null text is empty; a
    document without words is linked with nothing. Rows that share a doc_id are rows of one document: each is
    linked by its own text. Rows without doc_id are linked with nothing and kept, with a null component_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    threshold = percent / 100
    docs = documents(docs)
    sketch = stored(sketches(docs, width, threshold), "sketch")
    named = sketch.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = stored(named.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("brief").alias("brief")), "nodes")
    bands = nodes.select(F.explode("keys").alias("key"), "node", "n")
    # Keys of one node only are left behind at once; only what remains carries registers and is compared.
    shared = stored(bands.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    large = stored(shared.where(F.col("k") > KEY_BLOCK).select("key", F.ceil(F.col("k") / KEY_BLOCK).alias("blocks")), "large")
    bands = _joined(bands, large, "key", "left")
    rest = bands.where("blocks IS NULL").join(shared.select("key"), "key").withColumn("blocks", F.lit(1).cast("long"))
    bands = stored(bands.where("blocks IS NOT NULL").unionByName(rest).join(nodes.select("node", "brief"), "node"), "bands")
    # A share of the keys connects most of what belongs together, so the others have little to say about it.
    first = F.pmod(F.xxhash64("key"), F.lit(FIRST_KEYS)) == 0
    forest = stored(candidate_forest(_once(bands.where(first).withColumn("label", F.col("node")), "key"), percent), "forest")
    labelled = bands.where(~first | (F.col("blocks") > 1)).join(connected(forest).withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    if not large.isEmpty():
        labelled = stored(labelled, "labelled")
    small = labelled.where("blocks = 1")
    apart = small.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    more = candidate_forest(_once(small.join(apart, "key"), "key"), percent)
    if not large.isEmpty():
        once = stored(candidate_forest(_once(labelled.where("blocks > 1"), "key"), percent), "forest")
        forest = forest.unionByName(once)
        wide = labelled.where("blocks > 1").drop("label").join(connected(forest).withColumnRenamed("root", "label"), "node", "left")
        wide = wide.withColumn("label", F.coalesce("label", "node"))
        more = more.unionByName(candidate_forest(_apart(wide, "key", "label", KEY_BLOCK), percent))
    clusters = connected(forest.unionByName(more))
    links = confirmed_links(sets_of(clusters, docs, sketch, width), percent)
    roots = connected(links)
    rooted = sketch.select("doc_id", "text_id", "n_shingles", "node").join(roots, "node", "left")
    rooted = stored(rooted.select("doc_id", "text_id", "n_shingles", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.where("root IS NOT NULL AND doc_id IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    linked = rooted.where("root IS NOT NULL AND doc_id IS NOT NULL").join(least, "root").select("doc_id", "n_shingles", F.col("least").alias("component_id"), "text_id")
    alone = rooted.where("root IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_id")
    found = linked.unionByName(alone)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept", "text_id")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), width=2, percent=80)
