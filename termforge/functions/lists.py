"""Word lists from raw sources: frequency lists, stopword lists, exception files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wordlist(lines: DataFrame, depth: int = 80_000) -> DataFrame:
    """(n, line) of `word count` lines in order -> word, rank of the first `depth` words of letters a to z."""
    words = lines.select("n", F.regexp_extract("line", r"^([a-z]+)(?:\s|$)", 1).alias("word")).where("word <> ''").orderBy("n").limit(depth)
    return words.withColumn("rank", F.row_number().over(Window.orderBy("n")) - 1).select("word", "rank")  # depth rows at most


def stopwords(words: DataFrame, added: list[str], clitics: list[str]) -> DataFrame:
    """Distinct lower-cased words, without clitics and without e where e't is listed, and the added ones."""
    words = words.select(F.lower("word").alias("word")).distinct()
    cut = words.where("endswith(word, '''t')").selectExpr("left(word, length(word) - 2) AS word")
    extra = words.sparkSession.createDataFrame([(w,) for w in added], "word string")
    return words.join(cut, "word", "left_anti").where(~F.col("word").isin(*clitics)).union(extra).distinct()


def lemmas(lines: DataFrame) -> DataFrame:
    """(line) of `inflected lemma ...` -> inflected, sorted distinct lemmas; only lines of a-z words; none is its own lemma."""
    rows = lines.select(F.split(F.lower(F.trim("line")), r"\s+").alias("f")).where("forall(f, x -> x rlike '^[a-z]+$')")
    pairs = rows.select(F.col("f")[0].alias("inflected"), F.explode(F.expr("slice(f, 2, size(f))")).alias("lemma")).where("inflected <> lemma").distinct()
    return pairs.groupBy("inflected").agg(F.sort_array(F.collect_set("lemma")).alias("lemmas"))


def every(words: DataFrame, stride: int = 500, low: int = 20_001, high: int = 79_999) -> DataFrame:
    return words.where((F.col("rank") >= low) & (F.col("rank") <= high) & (F.col("rank") % stride == 0))


def dates(spark, first: str = "2015-01-01", last: str = "2025-12-31", step: int = 37) -> DataFrame:
    return spark.sql(f"SELECT date_format(d, 'yyyy-MM-dd') AS surface FROM (SELECT explode(sequence(date'{first}', date'{last}', interval {step} days)) AS d)")
