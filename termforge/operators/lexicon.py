"""Lexicon predicates without a shuffle of tokens.

The rules undo endings of a token and look what is left up in a list. Here they are turned round once: every listed
word is spelled out in all forms that the rules would lead back to it. The result has some twenty rows a listed word,
and lists have a bounded depth, so it is broadcast and each token needs one lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.functions import text as X
from termforge.resources import Resources

#: Lists beyond this are refused: the expanded lexicon would no longer be small enough for every executor.
MOST_WORDS = 250_000


def inflections(w: str) -> str:
    """SQL array of forms that have w as a base form."""
    doubled = f"(right({w}, 1) rlike '^{X.LETTER}$' AND right({w}, 1) NOT IN ('a', 'e', 'i', 'o', 'u'))"
    forms = [f"{w} || '''s'", f"{w} || ''''", f"{w} || 's'", f"CASE WHEN right({w}, 1) = 'y' THEN left({w}, length({w}) - 1) || 'ies' END", f"CASE WHEN {doubled} THEN {w} || right({w}, 1) || 's' END"]
    for suffix in ("es", "ed", "ing"):
        forms += [f"{w} || '{suffix}'", f"CASE WHEN right({w}, 1) = 'e' THEN left({w}, length({w}) - 1) || '{suffix}' END", f"CASE WHEN {doubled} THEN {w} || right({w}, 1) || '{suffix}' END"]
    return f"CASE WHEN length({w}) >= 2 THEN array_compact(array({', '.join(forms)})) ELSE cast(array() AS array<string>) END"


def british(w: str) -> str:
    cases = " ".join(f"WHEN right({w}, {len(z)}) = '{z}' THEN left({w}, length({w}) - {len(z)}) || '{b}'" for b, z in (("ise", "ize"), ("isation", "ization"), ("ised", "ized"), ("ising", "izing")))
    return f"CASE {cases} END"


def lexicon(resources: Resources) -> DataFrame:
    """form, is_common, is_frequent, is_stopword: every form for which one of them holds."""
    size, depth = resources.config.wordlist_size, resources.config.acronym_wordlist_depth
    if max(size, depth) > MOST_WORDS:
        raise ValueError(f"word lists beyond {MOST_WORDS} words are not broadcast")
    words = resources.words.where(F.col("rank") < max(size, depth)).withColumn("f", F.expr(british("word")))
    forms = F.expr(f"concat(array(word), {inflections('word')}, CASE WHEN length(f) >= 2 THEN concat(array(f), {inflections('f')}) ELSE cast(array() AS array<string>) END)")
    spelled = words.select(F.explode(F.array_distinct(forms)).alias("form"), (F.col("rank") < size).alias("c"), ((F.col("rank") < depth)).alias("near"), "word")
    spelled = spelled.select("form", "c", (F.col("near") & (F.col("form") == F.col("word"))).alias("q"), F.lit(False).alias("s"))
    lemmas = resources.lemmas.join(resources.common(), F.col("lemma") == F.col("word"), "left_semi").select(F.col("inflected").alias("form"), F.lit(True).alias("c"), F.lit(False).alias("q"), F.lit(False).alias("s"))
    stops = resources.stopwords.select(F.col("word").alias("form"), F.lit(False).alias("c"), F.lit(False).alias("q"), F.lit(True).alias("s"))
    every = spelled.unionByName(lemmas).unionByName(stops)
    return every.groupBy("form").agg(F.bool_or("c").alias("is_common"), F.bool_or("q").alias("is_frequent"), F.bool_or("s").alias("is_stopword"))


def with_lexicon(tokens: DataFrame, resources: Resources) -> DataFrame:
    """tokens plus is_common, is_frequent, is_stopword.

    Typographic apostrophes are folded for common words and stopwords; frequent words are taken as they stand.
    """
    flagged = tokens.withColumn("form", F.expr(X.folded_apostrophes("lower"))).join(F.broadcast(lexicon(resources)), "form", "left")
    frequent = F.coalesce(F.col("is_frequent") & (F.col("form") == F.col("lower")), F.lit(False))
    return flagged.withColumns({"is_common": F.coalesce("is_common", F.lit(False)), "is_frequent": frequent, "is_stopword": F.coalesce("is_stopword", F.lit(False))}).drop("form")


def vocabulary(tokens: DataFrame, resources: Resources) -> DataFrame:
    """Each distinct lower-cased token of the collection with its flags."""
    return with_lexicon(tokens.select("lower").distinct(), resources)
