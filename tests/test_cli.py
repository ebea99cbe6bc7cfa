"""The command line, the forms of its output, and streams."""

import csv
import io
import json

import pytest
from termforge import cli
from termforge.config import Config
from termforge.plans import injection, render
from termforge.resources import Resources
from termforge.streaming import micro

NOTE = "Note of the batch DS-2291 and the value.\nWe used MabSelect SuRe for it by SOP-114, and that is the Standard Operating Procedure (SOP) of it."


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.txt").write_text(NOTE)
    (d / "b.txt").write_text("tiny")
    (d / "broken.docx").write_bytes(b"%PDF-1.7 x")
    return d


def run(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main([str(a) for a in argv], spark, out, err)
    return code, out.getvalue(), err.getvalue()


def test_json_lines_and_tally(spark, folder):
    code, out, err = run(spark, "extract", folder)
    rows = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and [r["status"] for r in rows] == ["Ok", "TooShort", "NoTextLayer"]
    assert "ds-2291" in [k["normalised"] for k in rows[0]["keywords"]] and len(rows[0]["hash_exact"]) == 64
    assert "3 documents: 1 NoTextLayer, 1 Ok, 1 TooShort" in err and "stamp:" in err


def test_csv_keeps_documents_without_keywords(spark, folder):
    code, out, err = run(spark, "extract", folder, "--format", "csv", "--quiet", "--strict")
    rows = list(csv.DictReader(io.StringIO(out)))
    assert code == 2 and tuple(rows[0]) == render.CSV_COLUMNS and "stamp:" not in err
    assert [r["kind"] for r in rows if r["status"] == "TooShort"] == [""] and all(len(r["score"].split(".")[1]) == 4 for r in rows if r["score"])
    assert any(r["expansion"] == "Standard Operating Procedure" for r in rows)


def test_views_keep_ranks(spark, folder):
    _, out, _ = run(spark, "extract", folder / "a.txt", "--format", "json", "--kind", "identifier", "--top", 1, "--features")
    [r] = json.loads(out)
    assert [(k["kind"], k["rank"]) for k in r["keywords"]] == [("Identifier", 0)] and r["features"]["ds-2291"]


def test_table_says_why(spark, folder):
    _, out, _ = run(spark, "extract", folder, "--format", "table")
    assert "Topical: none (not counted:" in out and "no keywords: its text is too short" in out and "definition = Standard Operating Procedure" in out


def test_written_in_parallel(spark, folder, tmp_path):
    assert run(spark, "extract", folder, "--format", "csv", "--output", tmp_path / "c")[0] == 0
    assert spark.read.csv(str(tmp_path / "c"), header=True).where("status = 'Ok'").count() >= 4


def test_missing_path(spark, folder):
    code, out, err = run(spark, "extract", folder / "nowhere")
    assert code == 1 and "cannot read" in err and not out


def test_explain(spark, folder):
    code, out, _ = run(spark, "explain", folder / "a.txt", "--near-misses")
    assert code == 0 and "digit_letter_mix 1 x 0.25 = 0.250" in out and "below the thresholds:" in out


def test_config_and_version(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"min_content_length": 3}')
    _, out, err = run(spark, "config", "--config-file", tmp_path / "c.json", "--threshold-technical", "0.5")
    assert json.loads(out)["min_content_length"] == 3 and json.loads(out)["thresholds"]["technical"] == 0.5 and len(err.strip()) == 64
    assert "stamp" in run(spark, "version")[1]


def test_exit_codes():
    assert [render.exit_code(*x) for x in (({"Ok": 2}, 0, True), ({"Ok": 1, "TooShort": 1}, 0, False), ({"Ok": 1, "TooShort": 1}, 0, True), ({"Ok": 1}, 1, True))] == [0, 0, 2, 1]


def test_stream_gives_the_rows_of_a_batch(spark, folder, tmp_path):
    resources = Resources.of(spark, Config())
    micro.extract_stream(micro.file_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check"), Config(), resources, prepare=micro.from_files).awaitTermination()
    (folder / "later.txt").write_text("A later note of QX-991 in the folder.")
    micro.extract_stream(micro.file_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check"), Config(), resources, prepare=micro.from_files).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 4 and len({r["doc_id"] for r in rows}) == 4 and {r["batch"] for r in rows} == {0, 1}
    assert sorted(r["status"] for r in rows) == ["NoTextLayer", "Ok", "Ok", "TooShort"]


def test_planted_terms_are_found(spark):
    """Easy plants are all found, dates and telephone numbers never, and two plain rules do worse on them."""
    from termforge.operators import analysis, canonical, lexicon, shape, tokenize

    plants = [(f"{a}-{b}", "code") for a in ("DS", "QX", "MZK") for b in (2291, 114, 98765)] + [("HEK293T", "cell"), ("v9B-77/c2", "part")]
    dates = [(f"20{a}-0{b}-1{b}", "date") for a in (19, 21, 24) for b in (1, 5, 8)] + [(f"+44 20{i}9460", "phone") for i in range(9)]
    docs, truth = injection.corpus(spark, 11, 24, plants, dates)
    assert docs.collect() == injection.corpus(spark, 11, 24, plants, dates)[0].collect()
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    rows = truth.collect()
    assert all(texts[r["doc_id"]][r["start"] : r["end"]].decode() == r["surface"] for r in rows)
    common = " ".join(injection.CARRIERS.values()).replace("{", " ").replace("}", " ")
    words = "\n".join(sorted({w.strip(".,").lower() for w in common.split()}))
    resources = Resources.of(spark, Config(), wordlist=words)
    tokens = lexicon.with_lexicon(tokenize.tokenised(canonical.canonicalise(docs))[1], resources)
    found = shape.candidates(tokens, Config())
    grid = spark.createDataFrame([(0, 0.55, 0.38), (1, 1.5, 1.5)], "point bigint, identifier double, technical double")
    tiered = truth.selectExpr("*", "'Easy' AS tier")
    report = {r["point"]: r for r in injection.report(tiered.where("scheme <> 'acronym'"), found, grid, tokens.count()).collect()}
    assert report[0]["Easy"] == 1.0 and 1 not in report
    emitted = analysis.emissions(found, grid)
    touched = emitted.join(truth.where("is_distractor").select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_semi")
    baseline = analysis.digit_baseline(tokens).join(truth.where("is_distractor").select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_semi")
    assert touched.count() == 0 and baseline.count() > 0


def test_draws_are_uniform():
    s = injection.Stream(1, "x")
    found = [s.below(6) for _ in range(6000)]
    assert set(found) == set(range(6)) and max(map(found.count, range(6))) < 1150
    assert sorted(s.shuffled(range(20))) == list(range(20))
