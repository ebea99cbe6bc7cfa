import hashlib
import re

import xxhash
from termforge.llm import winnowing
from termforge.llm.winnowing import K, W

SOLID = "぀-ヿ㐀-鿿가-힯"
TOKEN = re.compile(rf"[{SOLID}]|[^ \t\n\x0b\f\r{SOLID}]{{1,32}}")
FULL = (1 << 64) - 1


def winnowed(text):
    """hash:position pairs by the definition: every window, its least hash, the rightmost on ties."""
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in TOKEN.findall(text.lower())]
    rot = lambda x, k: ((x << k) | (x >> (64 - k))) & FULL if k else x
    grams = []
    for i in range(max(len(h) - K + 1, min(1, len(h)))):
        g = 0
        for j in range(K):
            g ^= rot(h[i + j] if i + j < len(h) else 0, K - 1 - j)
        grams.append(g >> 33)
    out = []
    for i in range(max(len(grams) - W + 1, min(1, len(grams)))):
        window = range(i, min(i + W, len(grams)))
        at = min(window, key=lambda p: (grams[p], -p))
        if (grams[at], at) not in out:
            out.append((grams[at], at))
    return out


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """rows: distinct (doc_id, text)."""
    rows = sorted(rows, reverse=True)
    out = {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        own, other, nxt = winnowed(text), winnowed(edited), winnowed(after)
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, nxt))
    return out


def compare(frame, rows):
    found = {r["doc_id"]: r for r in frame.collect()}
    want = expected(rows)
    assert set(found) == set(want)
    shown = lambda pairs: ",".join(f"{h:X}:{p}" for h, p in pairs)
    for doc, (n, sha, own, other, a, b) in want.items():
        r = found[doc]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, shown(own), shown(other)), doc
        assert abs(r["near_edited"] - a) < 1e-12 and abs(r["near_next"] - b) < 1e-12


def test_whole_table_against_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r["text"] or "") < 6000]
    compare(winnowing.compare_with_next(spark.createDataFrame(rows, "doc_id bigint, text string")), rows)


def test_edge_texts(spark):
    texts = ["", "one", "one two three", "a b c d", "a b c d e f g h i j k", "same " * 60, "日本語のテキストです" * 4, "x" * 1000, "\U0001f600 é b", "word " * 20_000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([*rows, (0, "zzz"), (None, "left out"), (20, None)], "doc_id bigint, text string").selectExpr("*", "1 AS fingerprint", "2 AS head", "3 AS n_chars")
    compare(winnowing.compare_with_next(docs), [*rows, (20, "")])


def test_match_guarantee(spark):
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(40):
        shared = [word() for _ in range(K + W - 1)]
        for j in range(2):
            rows.append((2 * i + j, " ".join([*(word() for _ in range(r.randint(0, 30))), *shared, *(word() for _ in range(r.randint(0, 30)))])))
    found = {r["doc_id"]: {v >> 32 for v in r["fingerprint"]} for r in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[2 * i] & found[2 * i + 1] for i in range(40))
    assert sum(bool(found[2 * i] & found[2 * i + 3]) for i in range(39)) == 0


def test_empty_table(spark):
    assert winnowing.compare_with_next(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_tokens_of_all_kinds_of_runs(spark):
    solid = "日本語テキスト한글"
    texts = ["\t\n\x0b\f\r a b c d\u0085e ", "x" * 32, "x" * 33, "é" * 65 + "日" + "\U0001f600" * 40, f"a{solid}b{solid * 9} {'y' * 100}\t{solid}", "İ" * 40, " ", "", "$1 \\ $0", "a  b"]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").selectExpr("i", f"{winnowing.tokens_sql('text')} AS t").collect()
    lowered = lambda text: text.replace("İ", "i̇").lower()
    assert {r["i"]: r["t"] for r in found} == {i: TOKEN.findall(lowered(t)) for i, t in enumerate(texts)}


def test_texts_are_dealt_and_fingerprinted_once(spark, small):
    found = winnowing.op7_winnowing(spark, small)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange shufflepartitionidpassthrough") == 1 and executed.count("Exchange hashpartitioning") == 0
    assert plan.count("FileScan") == 1 and plan.count("split(") == 2  # one for the text, one for the edited text


def test_next_documents_across_ranges(spark):
    rows = [(doc, f"text {doc} " + "w " * (abs(doc) % 13)) for doc in [-(1 << 63), -5, 0, 1, 2, 3, 1000, 1001, (1 << 63) - 1]]
    for n in (1, 2, 9):
        docs = spark.createDataFrame(rows * 2, "doc_id bigint, text string").repartition(n)
        compare(winnowing.compare_with_next(docs), rows)
    compare(winnowing.compare_with_next(spark.createDataFrame(rows[:1], "doc_id bigint, text string")), rows[:1])
