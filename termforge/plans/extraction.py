"""From documents to ranked keywords."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.config import Config
from termforge.operators import canonical, gates, inplace
from termforge.operators.vocabulary import Lists
from termforge.resources import Resources

KINDS = {"Identifier": 0, "Technical": 1, "Topical": 2}
ORIGINS = {"Shape": 0, "Definition": 1, "Statistic": 2}


def ordinal(column: str, order: dict[str, int]) -> F.Column:
    return F.coalesce(*(F.when(F.col(column) == k, i) for k, i in order.items()))


def ranked(keywords: DataFrame) -> DataFrame:
    """keywords plus rank: dense from 0 within document and kind, by score, then form, then origin."""
    by = Window.partitionBy("doc_id", "kind").orderBy(F.round("score", 9).desc(), "normalised", ordinal("origin", ORIGINS), "original_keyword")
    return keywords.withColumn("rank", (F.row_number().over(by) - 1).cast("int"))


def top_per_kind(keywords: DataFrame, n: int) -> DataFrame:
    """The first n of each kind; ranks keep their meaning."""
    return keywords.where(F.col("rank") < n)


def of_kinds(keywords: DataFrame, *kinds: str) -> DataFrame:
    return keywords.where(F.col("kind").isin(*kinds))


def without_repeats(keywords: DataFrame) -> DataFrame:
    """One row for each form and kind of a document: a definition if there is one."""
    first = F.when(F.col("origin") == "Definition", 0).otherwise(1 + ordinal("origin", ORIGINS))
    by = Window.partitionBy("doc_id", "normalised", "kind").orderBy(first, F.col("score").desc(), "original_keyword")
    return keywords.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")


@dataclass
class Extraction:
    """The frames of one run; each is lazy, and none needs another's rows."""

    documents: DataFrame
    config: Config
    resources: Resources
    lists: Lists

    @cached_property
    def alive(self) -> DataFrame:
        return self.documents.where("status = 'Ok'")

    @property
    def pieces(self) -> DataFrame:
        return inplace.pieces(self.alive)

    @property
    def tokens(self) -> DataFrame:
        return inplace.tokens(self.alive, self.lists)

    @property
    def clauses(self) -> DataFrame:
        return inplace.clauses(self.alive)

    @property
    def candidates(self) -> DataFrame:
        return inplace.candidates(self.alive, self.lists, self.config)

    @cached_property
    def verdicts(self) -> DataFrame:
        rows = self.alive.select("doc_id", "canonical", (F.col("source") == "Spreadsheet").alias("tabular"))
        return gates.verdict(inplace.measures(rows, self.lists), self.config)

    def whole(self, *kept: str) -> DataFrame:
        """One row a document: doc_id, the columns to be kept, prose measures, and keywords with whether they repeat one."""
        return inplace.extracted(self.documents, self.lists, self.config, list(kept))

    @cached_property
    def keywords(self) -> DataFrame:
        return self.whole().selectExpr("doc_id", "inline(keywords)").drop("repeated")

    @cached_property
    def unrepeated(self) -> DataFrame:
        """As `without_repeats` of the keywords, from rows of whole documents."""
        return self.whole().selectExpr("doc_id", "inline(keywords)").where("NOT repeated").drop("repeated")

    def results(self) -> DataFrame:
        """One row a document: status, stamp, digests, length, language, verdict, keywords (ranked, by kind)."""
        columns = ["kind", "rank", "original_keyword", "normalised", "origin", "score", "frequency", "offsets", "expansion"]
        docs = self.whole("status", "message", "hash_exact", "hash_canonical", "own_content_length", "source")
        docs = gates.verdict(docs.withColumn("tabular", F.col("source") == "Spreadsheet"), self.config)
        ok = F.col("status") == "Ok"
        return docs.select(
            "doc_id", "status", "message", F.lit(self.config.stamp(self.resources.digests)).alias("version"), "hash_exact", "hash_canonical", "own_content_length",
            F.when(ok & F.col("language").isNotNull(), F.struct(F.col("language").alias("code"), "fully_supported")).alias("language"), "confidence",
            F.when(ok, F.struct("is_prose", "reason", "mean_sentence_len", "stopword_ratio", "table_line_ratio", "tokens")).alias("prose"), F.transform("keywords", lambda k: F.struct(*(k[c].alias(c) for c in columns))).alias("keywords"),
        )


def gated(docs: DataFrame, config: Config) -> DataFrame:
    """(doc_id, text, source, text_layer, error) -> status, message, canonical, digests, language.

    Order: parse errors, missing text layer (PDF), length. A document that is stopped keeps its row.
    """
    docs = canonical.canonicalise(docs, config, source="source")
    status = (
        F.when(F.col("error").isin("Encrypted", "UnsupportedFormat"), F.col("error")).when(F.col("error").isNotNull(), "ParseError")
        .when(~F.coalesce("text_layer", F.lit(True)), "NoTextLayer").when(F.length("canonical") < config.min_content_length, "TooShort").otherwise("Ok")
    )
    docs = docs.withColumn("status", status).withColumn("message", F.when(F.col("status") == "ParseError", F.col("error")))
    kept = F.col("status").isin("Ok", "TooShort")
    docs = docs.withColumn("hash_canonical", F.when(kept, F.sha2(F.col("canonical").cast("binary"), 256))).withColumn("own_content_length", F.when(kept, F.length("canonical")).otherwise(0).cast("long"))
    return gates.language(docs)


def sourced(docs: DataFrame) -> DataFrame:
    """Documents of any table with doc_id and text in the columns that parsed files have; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.lit("Plain").alias("source"), F.lit(None).cast("boolean").alias("text_layer"), F.lit(None).cast("string").alias("error"), F.sha2(text.cast("binary"), 256).alias("hash_exact"))


def extract(docs: DataFrame, config: Config, resources: Resources) -> Extraction:
    """docs: doc_id, text, source, text_layer, error, hash_exact (from termforge.sources, or `sourced`)."""
    return Extraction(gated(docs, config), config, resources, Lists.of(resources))


def canonical_texts(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id and canonical text, without gates: what offsets are resolved against."""
    return canonical.canonicalise(docs, config, source="source" if "source" in docs.columns else None).select("doc_id", "canonical")


def resolved(keywords: DataFrame, texts: DataFrame) -> DataFrame:
    """keywords by span, with the bytes of the canonical text there."""
    spans = keywords.select("doc_id", "kind", "normalised", "original_keyword", F.explode("offsets").alias("span"))
    return spans.join(texts, "doc_id").selectExpr("doc_id", "kind", "normalised", "original_keyword", "span.start AS start", "span.end AS end", "cast(substring(cast(canonical AS binary), cast(span.start + 1 AS int), cast(span.end - span.start AS int)) AS string) AS found")


def resolved_in_place(x: Extraction, kind: str) -> DataFrame:
    """As `resolved` of the keywords of a kind and their texts, from rows that hold both: no document is moved."""
    found = "cast(substring(cast(canonical AS binary), cast(o.start + 1 AS int), cast(o.end - o.start AS int)) AS string)"
    span = f"named_struct('kind', k.kind, 'normalised', k.normalised, 'original_keyword', k.original_keyword, 'start', o.start, 'end', o.end, 'found', {found})"
    rows = x.whole("canonical").selectExpr("doc_id", f"flatten(transform(filter(keywords, k -> k.kind = '{kind}'), k -> transform(k.offsets, o -> {span}))) AS spans")
    return rows.selectExpr("doc_id", "inline(spans)")
