"""Plans of the registered queries: what grew faster than the documents must not come back."""

import pytest
from termforge.plans import registry

#: Queries whose tokens stay in their document: no window sorts them.
IN_PLACE = [
    "ngram_candidates",
    "topical_dedup",
    "topical_scored",
    "keyword_union",
    "results",
    "top_per_kind",
    "without_repeats",
    "term_statistics",
    "term_scores",
    "shape_unigrams",
    "near_misses",
    "explain_components",
    "shape_ranked",
    "token_spans",
    "baselines",
    "resolved_spans",
    "prose_verdict",
    "prose_measures",
    "sweep_grid",
    "clauses",
    "sentences",
    "caps_runs",
    "span_scoring",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", IN_PLACE)
def test_no_token_is_sorted(spark, small, name):
    assert "Window" not in plan_of(registry.QUERIES[name](spark, small))


def test_files_are_dealt_out(spark, small):
    """One small file of parts makes work for all cores."""
    assert registry.QUERIES["parsed_files"](spark, small).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_texts_that_stay_do_not_go_to_python(spark):
    """The text of a stable row is null where Python reads it."""
    from termforge.operators import canonical

    plan = plan_of(canonical.canonicalise(spark.createDataFrame([(1, "é")], "doc_id bigint, text string")))
    assert "octet_length(translate" in plan and "ArrowEvalPython" in plan


def test_stable_characters_are_stable(spark):
    """Texts that don't reach Python are those that NFKC doesn't change, whatever stands beside what."""
    import unicodedata

    from termforge.operators import canonical

    every = [*map(chr, range(128)), *canonical.STABLE]
    assert all(unicodedata.normalize("NFKC", a + c) == a + c and not unicodedata.combining(c) for a in (*"aA1 ", *canonical.STABLE) for c in every)
    texts = ["plain", "é “x” – €", "ﬁ", "e\u0301", "x²", None, "Ａ" * 300_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical.nfkc("t").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_word_sets_are_made_in_their_row(spark, small):
    plan = plan_of(registry.QUERIES["jaccard"](spark, small))
    assert "explode" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("name", ["canonical_text", "canonical_rules"])
def test_canonical_texts_pass_by_pandas(spark, small, name):
    """NFKC reads Arrow arrays in small parts, over documents that are dealt out."""
    df = registry.QUERIES[name](spark, small)
    assert "translate(" in plan_of(df) and df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
