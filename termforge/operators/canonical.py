"""Canonical text: the string that all offsets refer to."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termforge.config import Config
from termforge.functions import text as X
from termforge.functions.arrow import slices

#: Characters beyond ASCII that NFKC leaves as they are wherever they stand, most of the Latin ones; texts without others don't go to Python.
STABLE = "".join(chr(c) for low, high in ("¡§", "©©", "«®", "°±", "¶·", "»»", "¿ı", "Ĵľ", "Łň", "Ŋž", "–—", "‘‘", "’’", "“”", "€€") for c in range(ord(low), ord(high) + 1))


@F.arrow_udf(StringType())
def normalised(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.concat_arrays([pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in s.to_pylist()], pa.string()) for s in slices(b)] or [b])


def nfkc(column: str) -> Column:
    text = F.col(column)
    left = F.translate(text, STABLE, "")
    return F.coalesce(normalised(F.when(F.octet_length(left) > F.length(left), text)), text)


def unquoted(lines: Column) -> Column:
    """Lines of a mail up to its signature, without quoted lines and attributions."""
    left = lambda x: F.regexp_replace(x, r"(?U)^\s+", "")
    marks = F.transform(lines, lambda x: left(x).isin("--", "-- "))
    first = F.array_position(marks, True)
    body = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    attributed = lambda x: F.lower(F.trim(x)).rlike(r"^(?:(?:on|at) .*)?.*\bwrote:$") & F.lower(F.trim(x)).rlike(r"(?:^(?:on|at) | wrote:)")
    return F.filter(body, lambda x: ~left(x).startswith(">") & ~attributed(x))


def canonicalise(docs: DataFrame, config: Config = Config(), text: str = "text", source: str | None = None) -> DataFrame:
    """docs plus `canonical`. source names the column of source kinds; only `Email` rows are stripped of quotes.

    One pass is final: a second one may join what the first has brought together.
    """
    docs = docs.withColumn("canonical", F.expr(X.newlines(f"`{text}`")))
    if source and config.strip_quoted_blocks:
        mail = F.array_join(unquoted(F.split("canonical", "\n", -1)), "\n")
        docs = docs.withColumn("canonical", F.when(F.col(source) == "Email", mail).otherwise(F.col("canonical")))
    docs = docs.withColumn("canonical", nfkc("canonical"))
    for step in (X.folded_characters, X.joined_hyphens, X.collapsed):
        docs = docs.withColumn("canonical", F.expr(step("canonical")))
    return docs
