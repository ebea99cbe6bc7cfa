import corpus_pipeline as P
from termforge.llm import decontaminate, language_id, pii

from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import covered


def test_every_stage_on_its_own_input(spark, small, tmp_path):
    """The stages as the driver runs them: each one's rows are written and read again, and held against its rule."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r for r in out.collect()}
        if k < len(P.STAGES) - 1:
            assert tuple(out.columns) == P.COLUMNS and out.count() == len(after) and set(after) <= set(before)
        unchanged = all(after[d] == before[d].__class__(*(before[d][c] for c in P.COLUMNS)) or tuple(after[d]) == tuple(before[d][c] for c in P.COLUMNS) for d in after) if k < 3 else True
        assert unchanged, name
        if name == "language ID":
            readable = {d for d, r in before.items() if r["text"] and language_id.has_letter(r["text"])}
            assert set(after) <= readable and len(after) >= 0.97 * len(readable)
        elif name == "near-dedup":
            want = brute([(d, r["text"]) for d, r in before.items()], 5, 80)
            assert set(after) == {d for d, (_, c) in want.items() if c == d}
        elif name == "decontamination":
            leaky = {r["doc_id"] for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - leaky
        elif name == "PII":
            m = pii.model()
            assert set(after) == set(before)
            for d, r in after.items():
                assert r["text"] == pii.redacted(before[d]["text"], m.spans(before[d]["text"])[1]) and r["n_chars"] == len(r["text"])
        else:
            covered(out.collect(), {d: r["text"] for d, r in before.items()}, 2048)
        docs = out


def test_run_gives_the_last_stage(spark, small):
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(P.run(spark, small).columns)


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls, repeats, one doc_id for two texts, clashing columns and empty tables."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    item = "What is the tallest of all the hills that stand behind the old town? It is the green one."
    rows = [
        (1, near, "en"), (1, near, "en"), (2, near, "en"), (2, "something else that shares a number with a copy", None), (3, None, "en"), (4, "", None),
        (None, near, "en"), (5, "write to a@b.cd about it", "en"), (6, f"so: {item} and so on", "en"), (7, "und die der nicht mit ein auch", "de"), (7, "und die der nicht mit ein auch", "de"),
    ]
    wide = "doc_id bigint, text string, lang string"
    docs = spark.createDataFrame(rows, wide).selectExpr("*", "'s' AS source", "length(text) AS n_chars", "1 AS key", "'x' AS component_id", "0 AS score")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {name: [tuple(r)[:2] for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in P.STAGES[:-1]}
    order = lambda x: sorted(x, key=str)
    assert {(3, None), (4, "")}.isdisjoint(found["language ID"])
    assert order(found["near-dedup"]) == order([(1, near), (2, rows[3][1]), (3, None), (4, ""), (None, near), (5, rows[7][1]), (6, rows[8][1]), (7, rows[9][1])])
    assert order(found["decontamination"]) == order(r[:2] for r in rows if r[0] != 6)
    assert order(found["PII"]) == order((d, "write to [EMAIL] about it" if d == 5 else t) for d, t, _ in rows)
    assert sum(1 for r in P.pack_sequences(spark, docs, "").collect()) >= len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
