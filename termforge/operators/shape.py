"""Terms by their shape: identifiers, acronyms, unusual words, and phrases of capitalised words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.config import Config
from termforge.functions import text as X

FEATURES = ("internal_caps", "digit_letter_mix", "separator_segments", "unusual_length", "absent_from_wordlist", "short_all_caps", "in_document_frequency")


def with_acronyms(tokens: DataFrame) -> DataFrame:
    """tokens plus caps (all capitals, two characters or more) and acronym: short all-caps, not frequent, in a run of one or two."""
    rows = tokens.withColumn("caps", F.expr(f"{X.all_caps('token')} AND length(token) >= 2"))
    rows = rows.withColumn("island", F.col("idx") - F.row_number().over(Window.partitionBy("doc_id", "caps").orderBy("idx")))
    run = F.count("*").over(Window.partitionBy("doc_id", "caps", "island"))
    return rows.withColumn("run", F.when(F.col("caps"), run).otherwise(0)).withColumn("acronym", F.expr(f"caps AND run < 3 AND {X.short_all_caps('token')} AND NOT is_frequent")).drop("island")


CANDIDATE = f"length(token) >= 2 AND NOT is_stopword AND {X.has_letter('token')} AND (acronym OR NOT is_common OR {X.has_internal_caps('token')} OR {X.has_digit('token')} OR {X.segments('token')} > 1 OR {X.short_all_caps('token')})"


def unigrams(tokens: DataFrame) -> DataFrame:
    """Candidates of one token: the first form in the document, all spans, how often."""
    rows = tokens.where(CANDIDATE).groupBy("doc_id", "lower")
    return rows.agg(
        F.min_by("token", "idx").alias("surface"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("offsets"), F.bool_or("acronym").alias("acronym"), F.count("*").alias("frequency"), F.first("is_common").alias("common"),
    ).withColumnRenamed("lower", "normalised")


def phrases(tokens: DataFrame) -> DataFrame:
    """Two or three capitalised unusual tokens of a line, one of them with inner capitals; greedy from the left, without overlap.

    Runs of tokens that may be in one phrase are found first; only within a run, never a document, are tokens folded.
    """
    able = f"NOT {X.has_digit('token')} AND token rlike '^{X.UPPER}' AND ({X.has_internal_caps('token')} OR NOT is_common)"
    rows = tokens.withColumn("tail", F.expr(able)).withColumn("head", F.expr("tail AND length(token) >= 2")).withColumn("inner", F.expr(X.has_internal_caps("token")))
    run = Window.partitionBy("doc_id", "line", "tail").orderBy("idx")
    rows = rows.withColumn("island", F.col("idx") - F.row_number().over(run)).where("tail")
    runs = rows.groupBy("doc_id", "line", "island").agg(F.sort_array(F.collect_list(F.struct("idx", "token", "start", "end", "head", "inner"))).alias("t")).where("size(t) >= 2 AND exists(t, x -> x.inner)")
    # state: next = first token not used yet; out = (first, length) of phrases
    step = """
    CASE WHEN i < s.next OR NOT t[i].head THEN s
         WHEN size(t) - i >= 3 AND (t[i].inner OR t[i + 1].inner OR t[i + 2].inner) THEN named_struct('next', i + 3, 'out', concat(s.out, array(named_struct('a', i, 'n', 3))))
         WHEN size(t) - i = 2 AND (t[i].inner OR t[i + 1].inner) THEN named_struct('next', i + 2, 'out', concat(s.out, array(named_struct('a', i, 'n', 2))))
         ELSE s END"""
    start = "named_struct('next', 0, 'out', cast(array() AS array<struct<a: int, n: int>>))"
    found = runs.selectExpr("doc_id", "t", f"explode(aggregate(sequence(0, size(t) - 1), {start}, (s, i) -> {step}).out) AS p")
    found = found.selectExpr("doc_id", "array_join(transform(slice(t, p.a + 1, p.n), x -> x.token), ' ') AS surface", "t[p.a].idx AS idx", "t[p.a].start AS start", "t[p.a + p.n - 1].end AS end")
    grouped = found.groupBy("doc_id", F.lower("surface").alias("normalised"))
    return grouped.agg(F.min_by("surface", "idx").alias("surface"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("offsets"), F.lit(False).alias("acronym"), F.count("*").alias("frequency"), F.lit(False).alias("common"))


def scored(candidates: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidates plus the seven features, kind and score."""
    s = "surface"
    features = {
        "internal_caps": f"cast({X.has_internal_caps(s)} AS double)",
        "digit_letter_mix": f"cast({X.has_digit(s)} AND {X.has_letter(s)} AS double)",
        "separator_segments": f"CASE {X.segments(s)} WHEN 1 THEN 0D WHEN 2 THEN 0.6D ELSE 1D END",
        "unusual_length": f"CASE WHEN length({s}) <= 12 THEN 0D WHEN length({s}) <= 17 THEN 0.5D ELSE 1D END",
        "absent_from_wordlist": "cast(acronym OR NOT common AS double)",
        "short_all_caps": f"cast({X.short_all_caps(s)} AS double)",
        "in_document_frequency": "least((frequency - 1) / 3D, 1D)",
    }
    rows = candidates.selectExpr("*", *(f"{v} AS {k}" for k, v in features.items()))
    weights = config.shape_weights
    total = " + ".join(f"{k} * {getattr(weights, k)}D" for k in FEATURES)
    kind = f"CASE WHEN {X.has_digit(s)} AND ({X.has_letter(s)} OR {X.segments(s)} > 1) THEN 'Identifier' ELSE 'Technical' END"
    return rows.selectExpr("*", f"{total} AS score", f"{kind} AS kind")


def candidates(tokens: DataFrame, config: Config = Config()) -> DataFrame:
    """All scored candidates of tokens with lexicon flags, whatever their score."""
    marked = with_acronyms(tokens)
    return scored(unigrams(marked).unionByName(phrases(marked)), config)


def threshold(config: Config) -> str:
    return f"CASE kind WHEN 'Identifier' THEN {config.thresholds.identifier}D ELSE {config.thresholds.technical}D END"


def keywords(found: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidates that reach the threshold of their kind (to nine digits), in the common keyword columns."""
    return found.where(f"round(score, 9) >= {threshold(config)}").selectExpr(
        "doc_id", "surface AS original_keyword", "normalised", "kind", "'Shape' AS origin", "score", "frequency", "offsets", "cast(null AS string) AS expansion"
    )
