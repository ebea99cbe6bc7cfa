import random
import zlib

import numpy as np
import public_tokenizers
from termforge.llm import packing
from tokenizers import Tokenizer

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def covered(rows, texts, window):
    """rows: pieces; texts: distinct doc_id -> text. Every id lies in one piece; sequences are gapless and in order."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(texts)
    for doc, pieces in docs.items():
        ids = np.array([*WHOLE.encode(texts[doc] or "", add_special_tokens=False).ids, packing.END], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    order = []
    for _, pieces in sorted(sequences.items()):
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
            order.append((p["doc_id"] if p["doc_id"] is not None else -1, p["start"]))
        assert at <= window
    assert order == sorted(order)
    return [sum(p["length"] for p in s) for s in sequences.values()]


def padding(sizes, window):
    return sum(0 if n & (n - 1) == 0 else window - n for n in sizes)


def test_whole_table(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sizes = covered(packing.op10_packing(spark, small).collect(), texts, 2048)
    assert padding(sizes, 2048) <= 0.02 * sum(sizes) + 4 * 2048


def cheapest(at, penalty, window):
    cost = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = int(at[j] - at[i])
            if n <= window and cost[i] is not None:
                c = cost[i] + int(penalty[j]) + (0 if n & (n - 1) == 0 else window - n)
                cost[j] = c if cost[j] is None else min(cost[j], c)
    return cost[-1]


def test_cuts_are_the_cheapest():
    r = random.Random(6)
    for _ in range(300):
        window = r.choice((8, 16, 32, 64))
        at = np.cumsum([0, *(r.randint(1, window // 2) for _ in range(r.randint(1, 40)))])
        penalty = np.array([0, *(r.choice((0, 4, 24)) for _ in range(len(at) - 2)), 0])
        cuts = packing.best_cuts(at, penalty, window)
        sizes = np.diff(at[cuts])
        assert sizes.max() <= window and cuts[0] == 0 and cuts[-1] == len(at) - 1
        assert padding(sizes.tolist(), window) + int(penalty[cuts[1:]].sum()) == cheapest(at, penalty, window)


def test_blocks_are_joined(spark, monkeypatch):
    """Planning in blocks leaves one short window at the end of an id range, not one a block."""
    monkeypatch.setattr(packing, "BLOCK_IDS", 2000)
    monkeypatch.setattr(packing, "gathered", lambda rows: ([r] for r in rows))
    r = random.Random(8)
    texts = [" ".join(r.choice(("alpha", "beta", "gamma.", "delta")) for _ in range(r.randint(0, 900))) for _ in range(60)]
    packer, found = packing.Packer(0, 128), []
    from termforge.llm.tokens import TOKENIZER, encoder_for, with_end

    for i, t in enumerate(texts):
        ids, lengths, ends = encoder_for(TOKENIZER).encode([t])
        packer.add([i], *with_end(ids, lengths, packing.END), ends)
        if len(packer.ids) >= 2000 and (out := packer.settle()) is not None:
            found += out.to_pylist()
    found += packer.settle(last=True).to_pylist()
    sizes = covered(found, dict(enumerate(texts)), 128)
    assert padding(sizes, 128) <= 0.1 * sum(sizes)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word. " * 30_000), (4, "w" * 50_000), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS length", "'q' AS offset", "2 AS part")
    covered(packing.pack(docs).collect(), dict(rows), 2048)
    same = packing.pack(spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "doc_id bigint, text string")).collect()
    assert len(same) == 3 and all(r["start"] == 0 for r in same)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
