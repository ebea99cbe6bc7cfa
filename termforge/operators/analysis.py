"""Explaining, sweeping and scoring of extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.config import Config
from termforge.functions import text as X
from termforge.operators import shape


def near_misses(candidates: DataFrame, config: Config = Config(), most: int | None = None) -> DataFrame:
    """Candidates below their threshold, best first in each document, with place from 0."""
    by = Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "normalised", "surface")
    rows = candidates.where(f"round(score, 9) < {shape.threshold(config)}").withColumn("place", F.row_number().over(by) - 1)
    return rows if most is None else rows.where(F.col("place") < most)


def components(candidates: DataFrame, config: Config = Config()) -> DataFrame:
    """A row for each feature of a candidate that is not zero: name, value, weight, contribution."""
    w = config.shape_weights
    parts = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(getattr(w, n)).alias("weight")) for n in shape.FEATURES))
    rows = candidates.select("doc_id", "normalised", "surface", F.explode(F.filter(parts, lambda p: p["value"] != 0)).alias("p"))
    return rows.select("doc_id", "normalised", "surface", "p.*", (F.col("p.value") * F.col("p.weight")).alias("contribution"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, similarity of the token sets of two token tables; 0 where neither has tokens."""
    sets = lambda t: t.groupBy("doc_id").agg(F.collect_set("lower").alias("tokens"))
    return jaccard_of_sets(sets(a), sets(b))


def jaccard_of_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """As `jaccard`, of tables with a row (doc_id, tokens) a document, whose tokens are distinct."""
    both = a.select("doc_id", F.col("tokens").alias("a")).join(b.select("doc_id", F.col("tokens").alias("b")), "doc_id", "full")
    none = F.array().cast("array<string>")
    both = both.select("doc_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("doc_id", F.coalesce(F.try_divide(shared, F.size("a") + F.size("b") - shared), F.lit(0.0)).alias("similarity"))


def tiers(surfaces: DataFrame) -> DataFrame:
    """(surface, frequent, shallow, full) -> tier. frequent, shallow and full say whether the lower-cased surface is a
    frequent word, and a common one at the small and the large depth."""
    s = "surface"
    marked = f"exists(split({s}, ' '), w -> {X.has_digit('w')} OR {X.has_internal_caps('w')})"
    return surfaces.withColumn("tier", F.expr(f"""CASE
        WHEN NOT {X.has_letter(s)} THEN 'Unreachable'
        WHEN {X.short_all_caps(s)} THEN CASE WHEN frequent THEN 'Unreachable' ELSE 'Easy' END
        WHEN {marked} OR {X.segments(s)} > 1 THEN 'Easy'
        WHEN shallow THEN 'Unreachable'
        WHEN contains({s}, ' ') OR NOT full THEN 'Medium'
        ELSE 'HardReachable' END"""))  # fmt: skip


def emissions(candidates: DataFrame, grid: DataFrame) -> DataFrame:
    """Spans that each point of a grid (point, identifier, technical) would emit; candidates are scored once. The grid is small."""
    spans = candidates.select("doc_id", "kind", "score", F.explode("offsets").alias("o")).select("doc_id", "kind", "score", F.col("o.start").alias("start"), F.col("o.end").alias("end"))
    passes = F.expr("round(score, 9) >= CASE kind WHEN 'Identifier' THEN identifier ELSE technical END")
    return spans.join(F.broadcast(grid), passes).select("point", "doc_id", "start", "end", "kind", "score")


def recalled(plants: DataFrame, emitted: DataFrame) -> DataFrame:
    """plants (doc_id, start, end, ...) at each point, with found: an emitted span is equal or covers it."""
    points = emitted.select("point").distinct()
    covered = plants.alias("p").join(emitted.alias("e"), (F.col("p.doc_id") == F.col("e.doc_id")) & (F.col("e.start") <= F.col("p.start")) & (F.col("e.end") >= F.col("p.end")))
    hits = covered.select("e.point", "p.doc_id", "p.start", "p.end").distinct().withColumn("found", F.lit(True))
    every = plants.crossJoin(F.broadcast(points))  # a few points
    return every.join(hits, ["point", "doc_id", "start", "end"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def false_emissions(plants: DataFrame, emitted: DataFrame) -> DataFrame:
    """Emitted spans that neither cover a plant nor lie in one."""
    touch = (F.col("p.doc_id") == F.col("e.doc_id")) & (((F.col("e.start") <= F.col("p.start")) & (F.col("e.end") >= F.col("p.end"))) | ((F.col("p.start") <= F.col("e.start")) & (F.col("p.end") >= F.col("e.end"))))
    return emitted.alias("e").join(plants.alias("p"), touch, "left_anti")


def rates(found: DataFrame, wrong: DataFrame, tokens: int) -> DataFrame:
    """A row a point: recall of each tier (null where nothing was planted) and false emissions per 1,000 tokens."""
    recall = found.where("NOT is_distractor").groupBy("point").pivot("tier", ["Easy", "Medium", "HardReachable", "Unreachable"]).agg(F.avg(F.col("found").cast("double")))
    return recall.join(wrong.groupBy("point").agg((F.count("*") * 1000 / max(1, tokens)).alias("false_per_1k")), "point", "left").fillna(0.0, ["false_per_1k"])


def frontier(points: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each budget of false emissions the point with the best hard recall within it (least false, then least point, on ties)."""
    order = F.struct(F.coalesce("HardReachable", F.lit(0.0)), -F.col("false_per_1k"), -F.col("point"))
    return points.join(F.broadcast(budgets), F.col("false_per_1k") <= F.col("budget")).groupBy("budget").agg(F.max_by("point", order).alias("point"), F.max(F.coalesce("HardReachable", F.lit(0.0))).alias("recall"))


def digit_baseline(tokens: DataFrame) -> DataFrame:
    return tokens.where(X.has_digit("token")).select("doc_id", "start", "end")


def absent_baseline(tokens: DataFrame) -> DataFrame:
    return tokens.where("NOT is_stopword AND NOT is_common").select("doc_id", "start", "end")


def tally(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("documents"))
