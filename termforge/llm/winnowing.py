"""Document fingerprints by winnowing, from DataFrame and SQL functions only.

A text is lower-cased and cut into tokens: runs of non-space characters of at most 32, or single
characters of scripts that are written without spaces. Every run of K tokens has a cyclic-polynomial
rolling hash; each window of W consecutive hashes keeps its smallest, the rightmost on ties. Positions
(token numbers from 0) stay with the hashes. Any passage of K + W - 1 = 11 tokens that two texts share
leaves a common hash in both fingerprints; nothing shorter than K = 4 tokens can match.

The rolling hash and the window minimum are evaluated by doubling (2, 4, 8 elements), so a position
costs a fixed number of steps, whatever the length of the text; no array is rebuilt per position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.llm.common import documents, partitions, table

K, W = 4, 8
_SOLID = r"\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af"
_LONGEST = 32
_LAST = (1 << 32) - 1


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _paired(array: str, step: int, body: str) -> str:
    return f"zip_with({array}, slice({array}, {step + 1}, size({array})), (a, b) -> {body})"


def _rotated(value: str, by: int) -> str:
    return f"(shiftleft({value}, {by}) | shiftrightunsigned({value}, {64 - by}))"


def tokens_sql(column: str) -> str:
    """SQL for the array of tokens. Texts are split at spaces; only what needs a pattern (characters of scripts without
    spaces, runs that are too long) is given to one."""
    spaced = f"lower({column})"
    for c in (9, 10, 11, 12, 13):
        spaced = f"replace({spaced}, chr({c}), ' ')"
    apart = _let(spaced, "t", f"CASE WHEN octet_length(t) = length(t) THEN t ELSE regexp_replace(t, '([{_SOLID}])', ' $1 ') END")
    cut = f"transform(u, w -> CASE WHEN length(w) > {_LONGEST} THEN regexp_extract_all(w, '(?s).{{1,{_LONGEST}}}', 0) ELSE array(w) END)"
    return _let(f"filter(split({apart}, ' '), w -> w <> '')", "u", f"CASE WHEN exists(u, w -> length(w) > {_LONGEST}) THEN flatten({cut}) ELSE u END")


def winnowed_sql(column: str) -> str:
    """SQL for an array of longs: 31 hash bits, then 32 bits of (2^32 - 1 - position), by position.

    With the position stored downwards the least of two equal hashes is the rightmost one. A text of
    fewer than K tokens has one hash over what there is; a text without tokens has none.
    """
    grams = _let(
        f"transform({tokens_sql(column)}, w -> xxhash64(w))",
        "h",
        _let(_paired("h", 1, f"{_rotated('a', 1)} ^ coalesce(b, 0L)"), "g", f"slice({_paired('g', 2, f'{_rotated("a", 2)} ^ coalesce(b, 0L)')}, 1, greatest(size(h) - {K - 1}, least(size(h), 1)))"),
    )
    packed = f"transform({grams}, (x, i) -> shiftleft(shiftrightunsigned(x, 33), 32) + ({_LAST}L - i))"
    halves = _let(_paired("p", 1, "least(a, b)"), "m", _let(_paired("m", 2, "least(a, b)"), "q", _paired("q", 4, "least(a, b)")))
    return _let(packed, "p", f"array_distinct(slice({halves}, 1, greatest(size(p) - {W - 1}, least(size(p), 1))))")


def shown_sql(column: str) -> str:
    """`hash:position` pairs, hash in hexadecimal, joined by commas."""
    return f"array_join(transform({column}, v -> concat(hex(shiftrightunsigned(v, 32)), ':', {_LAST}L - (v & {_LAST}L))), ',')"


def hashes_sql(column: str) -> str:
    return f"array_distinct(transform({column}, v -> cast(shiftrightunsigned(v, 32) AS int)))"


def likeness_sql(a: str, b: str) -> str:
    """Jaccard similarity of two hash arrays without repeats; two empty ones are alike."""
    return _let(f"size(array_intersect({a}, {b}))", "n", f"CASE WHEN size({a}) + size({b}) = 0 THEN 1D ELSE n / (size({a}) + size({b}) - n) END")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (see winnowed_sql). Null text is empty; rows stay as they are."""
    return documents(docs).selectExpr("doc_id", f"{winnowed_sql('text')} AS fingerprint")


def _ranges(ids: DataFrame) -> tuple[Column, DataFrame]:
    """For a table with doc_id: the number of a row's id range; and (doc_id, to) of the last document of each range,
    which the first one above it needs: `to` is the range with rows that comes next, and after the last the first.
    """
    n = partitions(ids.sparkSession)
    shares = F.array(*(F.lit(i / n) for i in range(1, n))) if n > 1 else F.array(F.lit(1.0))
    found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n)).alias("bounds")).first()["bounds"] or []
    bounds = F.array(*(F.lit(x).cast("long") for x in sorted(set(found))))  # any bounds are right; these share the rows alike
    part = F.size(F.filter(bounds, lambda x: x < F.col("doc_id")))
    lasts = sorted(ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("doc_id")).collect())  # a row a range
    to = [(r["doc_id"], lasts[(i + 1) % len(lasts)]["part"]) for i, r in enumerate(lasts)]
    return part, ids.sparkSession.createDataFrame(to, "doc_id bigint, to int")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, text, own (see winnowed_sql), and next_text, next_own of the document next below; after the lowest, the highest.

    Rows are dealt once, by id range, and the next document is the row before in a range. The last document of each range
    goes to the range above it as well, as its first row. So every text is moved and fingerprinted once.
    """
    docs = documents(docs).where("doc_id IS NOT NULL")
    part, lasts = _ranges(docs.select("doc_id"))
    dealt = docs.join(F.broadcast(lasts), "doc_id", "left")
    here, above = F.struct(part.alias("part"), F.lit(1).alias("place")), F.struct(F.col("to").alias("part"), F.lit(0).alias("place"))
    dealt = dealt.select("doc_id", "text", F.inline(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, above))))
    whole = dealt.repartitionById(partitions(docs.sparkSession), "part").groupBy("part", "place", "doc_id").agg(F.min("text").alias("text"))
    before = Window.partitionBy("part").orderBy("place", "doc_id")
    return (
        whole.withColumn("own", F.expr(winnowed_sql("text")))
        .withColumns({"next_text": F.lag("text").over(before), "next_own": F.lag("own").over(before)})
        .where("place = 1")
        .select("doc_id", "text", "own", "next_text", "next_own")
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, whose second half is the start of the next document.

    The next document is the one with the next lower doc_id; after the lowest comes the highest. Rows
    with one doc_id count as one document, with the least of their texts; rows without doc_id have no
    place in the order and are left out. Null text is empty. Two empty fingerprints have likeness 1.
    """
    return (
        with_next(docs)
        .selectExpr("doc_id", "length(text) AS n", "text", "own", "next_text", "next_own")
        .selectExpr("doc_id", "n", "concat(left(text, n - n div 2), left(next_text, n div 2)) AS edited", "own", f"{hashes_sql('next_own')} AS next_hashes")
        .selectExpr("doc_id", "n", "sha2(cast(edited AS binary), 256) AS edited_sha256", "own", f"{winnowed_sql('edited')} AS other", "next_hashes")
        .selectExpr("*", f"{hashes_sql('own')} AS own_hashes", f"{hashes_sql('other')} AS other_hashes")
        .selectExpr(
            "doc_id",
            "cast(n AS bigint) AS n_chars",
            "edited_sha256",
            f"{shown_sql('own')} AS fingerprint",
            f"{shown_sql('other')} AS edited_fingerprint",
            f"{likeness_sql('own_hashes', 'other_hashes')} AS near_edited",
            f"{likeness_sql('own_hashes', 'next_hashes')} AS near_next",
        )
    )


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
