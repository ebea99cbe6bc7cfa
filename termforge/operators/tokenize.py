"""Sentences, clauses and tokens with byte offsets into the canonical text.

Documents are dealt out by doc_id once, before their text is cut up; every window and grouping after that has doc_id
first and finds its rows in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from termforge.functions import text as X


def _before() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)


def placed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "canonical").repartition("doc_id")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent, piece, start, end (bytes), kept: pieces that end at a line feed or at a full stop before a capital or digit.

    Pieces of one byte or less, white space aside, are not kept, but their bytes and tokens count.
    """
    marked = rf"regexp_replace(regexp_replace(canonical, '(?U)([.!?])(?=\\s\\s*[{X.UPPER}0-9])', '$1\u0001'), '\n', '\n\u0001')"
    pieces = docs.selectExpr("doc_id", f"posexplode(split({marked}, '\u0001')) AS (sent, piece)").where("piece <> ''")
    start = F.coalesce(F.sum(F.octet_length("piece")).over(_before()), F.lit(0))
    return pieces.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.octet_length("piece")).withColumn("kept", F.expr(r"octet_length(regexp_replace(piece, '(?U)^\\s+|\\s+$', '')) > 1"))


def with_clauses(pieces: DataFrame) -> DataFrame:
    """sentences plus clause (null where not kept), line: a kept piece goes on with the last unless that one ended or it starts large."""
    kept = Window.partitionBy("doc_id", "kept").orderBy("sent")
    ended = F.expr(r"regexp_replace(piece, '(?U)\\s+$', '') rlike '[.!?:;]$'")
    small = F.expr(rf"regexp_replace(piece, '(?U)^\\s+', '') rlike '^{X.LOWER}'")
    begins = F.when(F.coalesce(F.lag(ended).over(kept), F.lit(True)) | ~small, 1).otherwise(0)
    lines = F.coalesce(F.sum(F.expr(r"cast(piece LIKE '%\n' AS int)")).over(_before()), F.lit(0))
    out = pieces.withColumn("begins", begins)
    return out.withColumn("clause", F.when(F.col("kept"), F.sum("begins").over(kept) - 1)).withColumn("line", lines).drop("begins")


def clauses(pieces: DataFrame) -> DataFrame:
    """doc_id, clause, start, end, text of each clause."""
    rows = pieces.where("kept").groupBy("doc_id", "clause").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("sent", "piece"))).alias("p"))
    return rows.select("doc_id", "clause", "start", "end", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("text"))


def tokens(pieces: DataFrame) -> DataFrame:
    """doc_id, idx, token, lower, start, end, line, clause, at (number in its clause): runs without white space, marks at their ends cut off."""
    cut = pieces.selectExpr("doc_id", "sent", "start AS base", "line", "clause", "posexplode(split(piece, '[ \n\t]')) AS (pos, chunk)")
    inside = Window.partitionBy("doc_id", "sent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("chunk_at", F.coalesce(F.sum(F.octet_length("chunk") + 1).over(inside), F.lit(0)) + F.col("base"))
    cut = cut.withColumn("token", F.expr(f"regexp_extract(chunk, '{X.TOKEN}', 0)")).where("token <> ''")
    cut = cut.withColumn("start", F.expr(f"chunk_at + octet_length(regexp_extract(chunk, '^[^{X.LETTER}\\\\p{{N}}]*', 0))"))
    order = Window.partitionBy("doc_id").orderBy("sent", "pos")
    in_clause = Window.partitionBy("doc_id", "clause").orderBy("sent", "pos")
    return cut.select(
        "doc_id", (F.row_number().over(order) - 1).cast("int").alias("idx"), "token", F.lower("token").alias("lower"), F.col("start").cast("long"),
        (F.col("start") + F.octet_length("token")).cast("long").alias("end"), "line", "clause", (F.row_number().over(in_clause) - 1).cast("int").alias("at"),
    )


def tokenised(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with clauses, tokens) of documents with canonical text."""
    pieces = with_clauses(sentences(placed(docs)))
    return pieces, tokens(pieces)
