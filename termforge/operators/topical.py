"""Topical phrases by local term statistics: case, position, spread and neighbours within one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from termforge.config import Config
from termforge.functions import text as X

COUNTABLE = f"length(token) >= 2 AND NOT is_stopword AND {X.has_letter('token')}"


def _clause() -> WindowSpec:
    return Window.partitionBy("doc_id", "clause").orderBy("at")


def _distinct(column: str) -> F.Column:
    """A distinct count that needs no shuffle of its own: a document's rows are in one place already."""
    return F.size(F.collect_set(column)).cast("long")


def term_statistics(tokens: DataFrame) -> DataFrame:
    """doc_id, lower, tf, uppercase, acronym, n_clauses, median_clause, n_left, n_right of countable terms; neighbours may be any token of the clause."""
    rows = tokens.where("clause IS NOT NULL").withColumns({"before": F.lag("lower").over(_clause()), "after": F.lead("lower").over(_clause())}).where(COUNTABLE)
    upper, acronym = F.expr(f"token rlike '^{X.UPPER}' AND at > 0"), F.expr(f"length(token) > 1 AND NOT token rlike '{X.LOWER}'")
    return rows.groupBy("doc_id", "lower").agg(
        F.count("*").alias("tf"), F.sum(upper.cast("long")).alias("uppercase"), F.sum(acronym.cast("long")).alias("acronym"), _distinct("clause").alias("n_clauses"),
        F.median("clause").alias("median_clause"), _distinct("before").alias("n_left"), _distinct("after").alias("n_right"),
    )


def term_scores(stats: DataFrame, clauses: DataFrame) -> DataFrame:
    """stats plus score: lower is better. clauses: doc_id, total."""
    doc = Window.partitionBy("doc_id")
    rows = stats.join(clauses, "doc_id").withColumns({"mean_tf": F.avg("tf").over(doc), "std_tf": F.stddev_pop("tf").over(doc), "max_tf": F.max("tf").over(doc)})
    rows = rows.selectExpr(
        "*", "greatest(uppercase, acronym) / (1 + ln(tf)) AS t_case", "ln(ln(3 + median_clause)) AS t_pos", "tf / greatest(mean_tf + std_tf, 1) AS t_norm",
        "1 + (n_left / tf + n_right / tf) * (tf / max_tf) AS t_rel", "n_clauses / total AS t_sent",
    )
    return rows.withColumn("score", F.expr("greatest(t_rel * t_pos / (t_case + t_norm / t_rel + t_sent / t_rel), 0D)"))


def phrases(tokens: DataFrame, scores: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, normalised, surface, raw, frequency, offsets of runs of countable tokens that only single spaces part."""
    longest = max(config.yake_ngram_max, 1)
    rows = tokens.where("clause IS NOT NULL").withColumn("ok", F.expr(COUNTABLE)).join(scores.select("doc_id", "lower", F.col("score").alias("s")), ["doc_id", "lower"], "left")
    parts = F.struct("token", "start", "end", "lower", "s", "ok", "line")
    ahead = [F.lead(parts, k).over(_clause()).alias(f"n{k}") for k in range(1, longest)]
    rows = rows.select("doc_id", "idx", "ok", parts.alias("n0"), *ahead).where("ok")
    whole, forms = "true", []
    for k in range(longest):
        if k:
            whole += f" AND coalesce(n{k}.ok, false) AND n{k}.start = n{k - 1}.end + 1 AND n{k}.line = n0.line"
        forms.append(f"CASE WHEN {whole} THEN array({', '.join(f'n{j}' for j in range(k + 1))}) END")
    found = rows.selectExpr("doc_id", "idx", f"explode(array_compact(array({', '.join(forms)}))) AS p")
    found = found.selectExpr(
        "doc_id", "idx", "array_join(transform(p, x -> x.token), ' ') AS surface", "array_join(transform(p, x -> x.lower), ' ') AS normalised", "named_struct('start', p[0].start, 'end', element_at(p, -1).end) AS span",
        "aggregate(p, 1D, (a, x) -> a * x.s) AS product", "aggregate(p, 0D, (a, x) -> a + x.s) AS total",
    )
    grouped = found.groupBy("doc_id", "normalised").agg(F.min_by("surface", "idx").alias("surface"), F.sort_array(F.collect_list("span")).alias("offsets"), F.count("*").alias("frequency"), F.first("product").alias("product"), F.first("total").alias("total"))
    raw = F.greatest(F.col("product") / (F.col("frequency") * (1 + F.col("total"))), F.lit(0.0))
    return grouped.withColumn("raw", F.round(raw, 12)).drop("product", "total").where("NOT isnan(raw)")


def deduplicated(found: DataFrame, config: Config = Config()) -> DataFrame:
    """Phrases at or below the topical threshold, best first, without those nearly equal to a better one."""
    near = "levenshtein(k.normalised, x.normalised) <= 0.2D * greatest(length(k.normalised), length(x.normalised)) + 1e-9"
    rows = found.where(f"raw <= {config.thresholds.topical}D").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("raw", "normalised", "surface", "frequency", "offsets"))).alias("t"))
    kind = rows.schema["t"].dataType.simpleString()
    return rows.selectExpr("doc_id", f"inline(aggregate(t, cast(array() AS {kind}), (acc, x) -> CASE WHEN exists(acc, k -> {near}) THEN acc ELSE concat(acc, array(x)) END))")


def keywords(kept: DataFrame) -> DataFrame:
    return kept.selectExpr("doc_id", "surface AS original_keyword", "normalised", "'Topical' AS kind", "'Statistic' AS origin", "1 / (1 + greatest(raw, 0D)) AS score", "frequency", "offsets", "cast(null AS string) AS expansion")
