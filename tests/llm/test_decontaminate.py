import random

import numpy as np
import pytest
from termforge.llm import decontaminate as D

#: ASCII characters that are neither letters nor digits.
EDGE = bytes(i for i in range(128) if not chr(i).isalnum())


def grams(words, n=8):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain(text):
    return [w for w in (x.encode().strip(EDGE).decode("utf-8", "replace") for x in (text or "").lower().split()) if w]


def holds(words, item, where):
    """Brute force: the longest common subsequence with the item of any window of its length and a step more at both ends."""
    best = 0
    for start in range(0, max(1, len(words)), 4):
        window = words[max(0, start - D.STEP) : start + len(item) + D.STEP]
        best = max(best, D.common_words(item, window))
    return best


@pytest.fixture(scope="module")
def tables(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    return docs, items, D.op2_decontamination(spark, small).collect()


def test_copied_items_are_found_and_clean_documents_left_alone(tables):
    docs, items, found = tables
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    words = {i: plain(t) for i, t in items.items()}
    for d, text in docs.items():
        own = plain(text)
        joined = f" {' '.join(own)} "
        for i, w in words.items():
            if f" {' '.join(w)} " in joined:
                assert (d, i) in pairs, (d, i)
    for r in found:
        own, item = plain(docs[r["doc_id"]]), words[r["item_id"]]
        assert holds(own, item, r["start_word"]) >= min(D.LCS, D.PARAPHRASE) * len(item) * 0.95


def test_against_brute_force(tables):
    """Every document and item whose windows share enough words in order, compared without retrieval."""
    docs, items, found = tables
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    words = {i: plain(t) for i, t in items.items()}
    missed = total = 0
    for d, text in docs.items():
        own = plain(text)
        bag = set(own)
        for i, w in words.items():
            if len(bag & set(w)) >= 0.85 * len(set(w)) and len(w) >= 8 and holds(own, w, None) >= 0.85 * len(w):
                total += 1
                missed += (d, i) not in pairs
    assert total and missed <= 0.02 * total


def word_maker(seed):
    r = random.Random(seed)
    return r, lambda: "".join(r.choice(("ba", "ce", "di", "fo", "gu", "ly", "mar", "nin", "or", "pes")) for _ in range(r.randint(1, 4)))


def corpus(seed=1, n=150):
    r, word = word_maker(seed)
    common = [word() for _ in range(1500)]
    text = lambda k: " ".join(r.choice(common) for _ in range(k))
    items = [(i, f"{text(r.randint(25, 60)).capitalize()}. {text(r.randint(5, 9)).capitalize()}.") for i in range(60)]
    docs, want = [], set()
    for d in range(n):
        body = [text(r.randint(20, 400)), text(r.randint(20, 400))]
        if d % 3 == 0:
            i = r.randrange(60)
            own = items[i][1].split()
            if d % 2:  # a paraphrase: every eighth word replaced
                own = [word() if k % 8 == 3 else w for k, w in enumerate(own)]
            if d % 5 == 0:
                own = [w.upper() + "," if k % 7 == 0 else w for k, w in enumerate(own)]
            body.insert(1, " ".join(own))
            want.add((d, i))
        docs.append((d, " ".join(body)))
    return docs, items, want


def test_planted_passages_and_paraphrases(spark):
    docs, items, want = corpus()
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(frame, bench).collect()}
    assert len(want - found) <= 1 and not found - want
    kept = {r["doc_id"] for r in D.without_leaks(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs, items, _ = corpus(2, 60)
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    once = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(frame, bench).collect()}
    monkeypatch.setattr(D, "BLOCK_CHARS", 4000)
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(frame, bench).collect()} == once


def test_directions_span_the_leading_subspace(spark):
    """The sketch's directions agree with a dense decomposition of the same matrix."""
    docs, _, _ = corpus(3, 80)
    got, df = D.directions(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert got.shape[0] == 1 << D.TERM_BITS and 1 <= got.shape[1] <= D.RANK and np.isfinite(got).all()
    rows = []
    for _, t in docs:
        terms = D._terms(D.hashed(t))
        for a in range(0, len(terms), 4 * D.STEP):
            rows.append(np.bincount(terms[a : a + 4 * D.STEP], minlength=1 << D.TERM_BITS))
    a = np.stack(rows).astype(float)
    idf = np.log((len(a) + 1) / ((a > 0).sum(0) + 1)) + 0.1
    first = np.linalg.svd(a * idf, full_matrices=False)[2][0]
    mine = np.linalg.qr(got / idf[:, None])[0]
    assert np.linalg.norm(mine.T @ first) > 0.9


def test_common_words():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 15))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert D.common_words(a, b) == t[-1][-1]


def test_edges(spark):
    item = "One two three four five six seven eight nine ten eleven. The answer is forty two."
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "filler word " * 100_000 + item), (5, "...")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "'c' AS cosine")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "..."), (7, item)], "item_id bigint, text string").selectExpr("*", "5 AS doc_id")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in D.find_leaks(docs, bench).collect()) == [(0, 7), (3, 7), (3, 7), (4, 7)]
    assert sorted(r["doc_id"] for r in D.without_leaks(docs, bench).collect()) == [1, 2, 5]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_leaks(docs, none).collect() == [] and D.without_leaks(docs, none).count() == 7
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert D.find_leaks(empty, bench).collect() == [] and D.without_leaks(empty, bench).collect() == []


def is_leak(words, own, answer):
    """Brute force: the rule at every place of a text."""
    for at in range(len(words)):
        near = words[max(0, at - D.STEP) : at + len(own) + D.STEP]
        common = D.common_words(own, near)
        if common >= D.LCS * len(own) or common >= D.PARAPHRASE * len(own) and D.common_words(answer, near) >= D.ANSWER * len(answer):
            return True
    return False


@pytest.mark.parametrize("columns", [24, 0])
def test_every_leak_is_found_whatever_its_cosine(columns):
    r, word = word_maker(7)
    common = [word() for _ in range(300)]
    text = lambda k: [r.choice(common) for _ in range(k)]
    rows = [(i, f"{' '.join(text(k)).capitalize()}. {' '.join(text(5)).capitalize()}.") for i, k in enumerate([10, 12, 15, 20, 33, 50, 130, 300])]
    docs = []
    for n in range(96):
        own = [w if r.random() > n % 6 / 10 else word() for w in rows[n % 8][1].split()]
        if n % 5 == 0:
            own = [w for w in own if r.random() > 0.2]
        docs.append(" ".join([*text(r.randint(0, 60)), *own, *text(r.randint(0, 60))]))
    weights = np.random.default_rng(1).normal(size=(1 << D.TERM_BITS, columns)).astype(np.float32)
    items = D.Items(rows, weights)
    found = {(d, hit[0]) for d, hits in enumerate(items.leaks(docs)) for hit in hits}
    want = {(d, i) for d, t in enumerate(docs) for i in range(8) if is_leak(D.hashed(t).tolist(), items.words[i], items.answers[i])}
    assert len(want) > 40 and found == want  # from half of the words in common upwards


def test_one_word_many_times():
    """Counts have no ceiling: an item of 700 times one word is found in its copy, and in half of it with its answer."""
    items = D.Items([(1, "tick " * 700)], np.zeros((1 << D.TERM_BITS, 0), np.float32))
    assert [h[0] for h in items.leaks(["tick " * 700])[0]] == [1]
    assert items.leaks(["tick " * 340])[0] == []
