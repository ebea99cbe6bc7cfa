"""A training-data pipeline over documents: each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

In every stage an empty table gives an empty one, other columns than those of documents are left behind whatever their
names, and rows with a null doc_id, lang, source or n_chars are treated as any others. What becomes of null, empty and
repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import decontaminate, language_id, near_dedup, packing, pii
from termforge.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language the network can't tell (`und`) are rejected, and those of which it gives no language more than
#: all others together. Of 10,000 documents of the smallest bench tables that is 10, and 9 of those 10 have the wrong label.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a language; the network learns from the labelled documents.

    Null texts and texts without a letter go. Repeated rows are decided alike. Where no row has a label nothing can be
    told, and all rows go.
    """
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates (5-word shingles, 0.8): that with the least doc_id.

    Rows are told apart by doc_id and text: of rows with the least doc_id but several texts of a group one text stays, and
    of rows alike in both one row. A row that shares its doc_id with a duplicate but not its text stays. Rows
    without words, null texts included, and rows without doc_id are near to nothing: they all stay.
    """
    docs = docs.select(*COLUMNS)
    groups = stored(near_dedup.near_components(docs, width=5, percent=80).where("doc_id IS NOT NULL AND n_shingles > 0"), "groups")
    kept = groups.where("kept").groupBy("doc_id").agg(F.min("text_id").alias("first"), F.count("*").alias("rows"))
    kept = kept.where("rows > 1").select("doc_id", "first")  # those whose doc_id is there more than once
    others = groups.join(kept, "doc_id").where("kept AND text_id <> first").select("doc_id", "text_id")
    dropped = groups.where("NOT kept").select("doc_id", "text_id").unionByName(others).distinct()
    keyed = docs.withColumn("text_id", F.xxhash64(F.coalesce("text", F.lit("")))).join(dropped, ["doc_id", "text_id"], "left_anti")
    twice = groups.where("kept").groupBy("doc_id", "text_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "text_id")
    once = keyed.join(twice, ["doc_id", "text_id"], "left_anti")
    return once.unionByName(keyed.join(twice, ["doc_id", "text_id"], "left_semi").dropDuplicates(["doc_id", "text_id"])).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item; null and empty texts hold none. Repeated rows are decided alike."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; n_chars follows the new text and is null for a null one. Every row stays."""
    return pii.redact_pii(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the token stream into sequences; a row for each piece of a document. A null text is empty: its end alone.
    Repeated rows are packed as often as they are there."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained models, sketches and a tokenizer are in between: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
