import zlib

import numpy as np
import pytest
from termforge.llm import language_id as L


@pytest.fixture(scope="module")
def predicted(spark, small):
    return L.op8_language_id(spark, small).collect()


def test_held_out_accuracy(spark, small, predicted):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r["doc_id"] for r in predicted} == set(docs) and len(predicted) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in predicted)
    held = [r for r in predicted if r["held_out"] and docs[r["doc_id"]]["lang"] and docs[r["doc_id"]]["text"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.93


def test_prediction_reads_the_text_alone(spark, small, predicted):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = L.train(docs)
    changed = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'other' AS source")
    found = {r["doc_id"] - 1_000_000: r["lang_pred"] for r in L.predict(changed, model).collect()}
    assert found == {r["doc_id"]: r["lang_pred"] for r in predicted}


def test_held_out_rows_are_not_learned_from(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = {r["doc_id"] for r in L.training_rows(docs).collect()}
    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)


def test_gradients_against_differences():
    model = L.ByteGru(["a", "b", "c"], hidden=4, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(90, 100, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    grads = model.gradients(x, y)[1]
    for name, p in model.p.items():
        flat, g = p.reshape(-1), grads[name].reshape(-1)
        for k in np.argsort(-np.abs(g))[:4]:
            was = flat[k]
            flat[k] = was + 1e-3
            up = model.gradients(x, y)[0]
            flat[k] = was - 1e-3
            down = model.gradients(x, y)[0]
            flat[k] = was
            assert abs((up - down) / 2e-3 - g[k]) < 2e-3 * max(1, abs(g[k])), name


def test_labels_of_a_text_are_the_mean_over_its_positions():
    model = L.ByteGru(["a", "b"], seed=3)
    text = "Über den Fluss 123 und " + "x" * 60
    rows = [np.frombuffer(f, np.uint8)[None] for s in L.segments(text) if L.has_letter(s) for f in L.framed(s)]
    every = np.concatenate([model.label(r)[:, 0] for r in rows])
    assert np.allclose(L.SegmentLabels(model).pooled([text])[0], every.mean(0), atol=1e-5)


def test_edges(spark):
    model = L.train(spark.createDataFrame([(i, "der und die nicht " * 3 if i % 2 else "the and of with " * 3, "de" if i % 2 else "en") for i in range(60)], "doc_id bigint, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 -- 45"), (4, "und die"), (4, "und die"), (None, "the with"), (5, "日本"), (6, "the and " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'z' AS lang_pred", "7 AS score", "8 AS extra")
    found = sorted(((r["doc_id"] or 0, r["lang_pred"], r["extra"]) for r in L.predict(docs, model).collect()))
    assert [x for x in found if x[0] != 5] == [(0, "en", 8), (1, "und", 8), (2, "und", 8), (3, "und", 8), (4, "de", 8), (4, "de", 8), (6, "en", 8)]
    nothing = L.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert {r["lang_pred"] for r in L.predict(docs, nothing).collect()} == {"und"}
    assert L.predict(spark.createDataFrame([], "doc_id bigint, text string"), model).collect() == []


def plain_pass(model, raw):
    """The network for one segment, a position and a unit at a time, from its equations alone."""
    n, states = model.hidden, []
    for d, order in (("forward", range(len(raw))), ("backward", range(len(raw) - 1, -1, -1))):
        h, found = [0.0] * n, {}
        for t in order:
            wx, wh, b = (model.p[f"{d}.{k}"].astype(float) for k in "xhb")
            fed = [wx[raw[t]][j] + b[j] for j in range(3 * n)]
            rec = [sum(h[i] * wh[i][j] for i in range(n)) for j in range(3 * n)]
            s = lambda v: 1 / (1 + np.exp(-v))
            z = [s(fed[j] + rec[j]) for j in range(n)]
            r = [s(fed[n + j] + rec[n + j]) for j in range(n)]
            c = [np.tanh(fed[2 * n + j] + r[j] * rec[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(n)]
            found[t] = h
        states.append(found)
    out = []
    for t in range(len(raw)):
        logits = np.array(states[0][t] + states[1][t]) @ model.p["out"] + model.p["bias"]
        out.append(np.exp(logits) / np.exp(logits).sum())
    return np.array(out)


def test_the_pass_against_its_equations():
    model = L.ByteGru(["a", "b", "c"], hidden=5, seed=9)
    raw = np.frombuffer(" straße 日 ".encode(), np.uint8)
    assert np.allclose(model.label(raw[None])[:, 0], plain_pass(model, raw), atol=1e-5)


def test_segments_are_cut_between_characters():
    for text in ("日本語" * 40, "x" * 200, "é" * 49, "a" + "\U0001f600" * 30):
        found = L.framed(text)
        assert b"".join(f[1:-1] for f in found).decode() == text and all(f[1:-1].decode() and len(f) <= L.SEGMENT + 2 for f in found)


def test_every_language_is_learned_and_the_sample_is_bounded(spark, monkeypatch):
    names = [f"l{i:03}" for i in range(90)]
    rows = [(i, f"{chr(97 + i % 9)}{chr(97 + i % 10)}{chr(97 + i % 11)} word", names[i % 90]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(L, "EPOCHS", 1)
    assert L.train(docs).languages == names
    monkeypatch.setattr(L, "SAMPLE_ROWS", 180)
    held = L.training_rows(docs).collect()
    assert len(held) <= 180 and {r["lang"] for r in held} == set(names)
