import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from termforge.llm import components, near_dedup
from termforge.llm.common import stored
from termforge.llm.components import connected


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ")


def shingles(text, width):
    words = [w for w in words_of(text) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    """doc_id -> (n, component), comparing every pair of distinct sets."""
    sets = {d: shingles(t, width) for d, t in rows}
    distinct = list({s for s in sets.values() if s})
    above = list(range(len(distinct)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    above[root(i)] = root(j)
    number = {s: root(i) for i, s in enumerate(distinct)}
    least = {}
    for d, s in sets.items():
        if s:
            least[number[s]] = min(least.get(number[s], d), d)
    return {d: (len(s), least[number[s]] if s else d) for d, s in sets.items()}


def check(spark, rows, width, percent=80):
    found = near_dedup.near_components(spark.createDataFrame(rows, "doc_id bigint, text string"), width, percent).collect()
    want = brute(rows, width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found) and len(found) == len(rows)


@pytest.mark.parametrize("width", [2, 5])
def test_whole_table_against_brute_force(spark, small, width):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(spark, rows, width)


def planted(seed=3):
    """Chains, copies and pairs on both sides of the threshold, at many sizes."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(5000)]
    texts = []
    for size in [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 30, 45, 64, 90, 120, 128, 129, 131, 160, 200, 300, 600, 2000]:
        for _ in range(3):
            base = [r.choice(vocabulary) for _ in range(size)]
            texts.append(base)
            for changes in {0, 1, 2, max(1, size // 40), max(1, size // 22), max(1, size // 18), max(1, size // 15)}:
                other = list(base)
                for _ in range(changes):
                    k = r.randrange(len(other))
                    if r.random() < 0.5 or len(other) < 2:
                        other[k] = r.choice(vocabulary)
                    else:
                        del other[k]
                texts.append(other)
            texts.append(base[: max(1, int(size * 0.81))])
            texts.append(base[: max(1, int(size * 0.79))])
    hot = [r.choice(vocabulary) for _ in range(150)]
    for _ in range(400):  # a large group of near copies
        other = list(hot)
        other[r.randrange(150)] = r.choice(vocabulary)
        texts.append(other)
    r.shuffle(texts)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width", [2, 5])
def test_planted_against_brute_force(spark, width):
    check(spark, planted(), width)


def test_blocks_of_hot_groups(spark, monkeypatch):
    """Keys and clusters that are dealt out as pairs of blocks give the same groups."""
    monkeypatch.setattr(near_dedup, "KEY_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 16)
    check(spark, planted(5), 2)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Word"), (5, "word"), (6, "a b"), (7, "A  B\n"), (8, "a b c"), (9, " "), (10, "É b"), (11, "é b"), (12, "x " * 100_000), (13, "X\x0bx " * 3)]
    check(spark, rows, 2)
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (None, "a b c"), (2, "a b c"), (2, "a b c")], "doc_id bigint, text string").withColumns({"component_id": F.lit("z"), "kept": F.lit(1), "keys": F.lit(2)})
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_components(docs, 2, 80).collect()), key=str)
    assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (None, None, True)]
    assert near_dedup.near_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_components_of_a_long_chain(spark):
    r = random.Random(2)
    names = r.sample(range(10_000), 300)
    links = [(names[i], names[i + 1]) for i in range(299) if i != 150] + [(7, 7)]
    found = {x["node"]: x["root"] for x in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {n: min(names[:151] if i <= 150 else names[151:]) for i, n in enumerate(names)}


@pytest.mark.parametrize("most, tables", [(0, 3), (1000, 1)])
def test_components_of_few_links_take_no_steps(spark, monkeypatch, most, tables):
    """Steps and the driver give the same; with few links only the links are written."""
    r, written = random.Random(3), []
    links = [(r.choice((-1, 1)) * r.randrange(600), r.randrange(600)) for _ in range(400)]
    least = {x: x for pair in links for x in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    monkeypatch.setattr(components, "MOST_LOCAL", most)
    monkeypatch.setattr(components, "stored", lambda df, label: written.append(label) or stored(df, label))
    found = connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert {x["node"]: x["root"] for x in found} == {n: m for n, m in least.items() if n not in alone} and len(found) == len(least) - len(alone)
    assert len(written) >= tables and (most == 0 or len(written) == 1)


def test_registers_estimate():
    """Share of equal registers, corrected for accidents, is near the similarity."""
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.9):
        both = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2)
        n = int(len(both) * share)
        rest = (len(both) - n) // 2
        a, b = np.unique(both[: n + rest]), np.unique(np.concatenate([both[:n], both[n + rest :]]))
        x, y = near_dedup.registers(a), near_dedup.registers(b)
        assert abs((x == y).mean() - share) < 0.12


@pytest.mark.parametrize("common, more, others", [(4, 0, 1), (5, 0, 1), (6, 0, 1), (8, 1, 1), (8, 0, 2), (100, 12, 13)])
def test_small_sets_at_the_threshold_always_share_a_key(common, more, others):
    """Also when the parts in which they agree are empty."""
    rng, classes = np.random.default_rng(3), near_dedup.size_classes(0.8)
    hashes = rng.integers(0, 1 << 64, (4000, common + more + others), np.uint64)
    regs = np.full(1 << near_dedup.BUCKET_BITS, near_dedup.EMPTY, np.uint16)
    keys = lambda h: near_dedup.band_keys(np.sort(h), regs, 0.8, classes)
    for h in hashes:
        assert np.isin(keys(h[: common + more]), keys(np.delete(h, np.s_[common : common + more]))).any()
