"""Language and prose gates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termforge.config import Config
from termforge.functions import classes
from termforge.functions.arrow import slices

#: Frequent function words of the seven languages; the vote stands in for a statistical model.
FUNCTION_WORDS = {
    "en": "the and of to in is that for it was with on are as be this have from by at or an not",
    "fr": "le la les des et en un une du que est pour dans qui sur par au avec pas ce se il elle sont",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "es": "el los las y en un una del que es por con para no se su al lo como más pero sus le",
    "it": "il lo gli e di che in un una per è con non si da del della sono al come più anche dei",
    "nl": "de het een en van in is dat op te voor met zijn niet aan er ook als bij door maar naar",
    "pt": "o os as e de do da em um uma que é para com não se por mais ao dos como mas na no",
}
LEAST_CHARS = 40
_CODES = sorted(FUNCTION_WORDS)
_VOTERS = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
_VOTES = np.array([[0] * len(_CODES), *([w in FUNCTION_WORDS[c].split() for c in _CODES] for w in _VOTERS)], np.int64)
_VOTER = {w: i for i, w in enumerate(_VOTERS, 1)}


def votes(texts: list[str]) -> np.ndarray:
    """A row of votes for each text, in order of the codes: words of letters, in small letters, that a language lists."""
    texts = [classes.lowered(t) for t in texts]
    text = "\n".join(texts)
    letter = np.zeros(len(text) + 2, bool)
    letter[1:-1] = classes.table()[classes.codes(text)] & classes.LETTER != 0
    turn = np.flatnonzero(letter[1:] != letter[:-1])
    words = [text[a:b] for a, b in zip(turn[::2].tolist(), turn[1::2].tolist())]
    voter = np.fromiter((_VOTER.get(w, 0) for w in words), np.int64, len(words))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(starts, turn[::2][voter > 0], "right") - 1
    out = np.zeros((len(texts), len(_CODES)), np.int64)
    np.add.at(out, doc, _VOTES[voter[voter > 0]])
    return out


def spoken(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(language, confidence) of each text: null and 0 below LEAST_CHARS characters or without a vote."""
    n = votes(texts)
    most = n.max(1)
    heard = (np.fromiter(map(len, texts), np.int64, len(texts)) >= LEAST_CHARS) & (most > 0)
    return pa.array(_CODES).take(pa.array(n.argmax(1), mask=~heard)), np.where(heard, most / np.maximum(n.sum(1), 1), 0.0)


@F.arrow_udf(StructType().add("language", "string").add("confidence", "double"))
def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        parts = [spoken([t or "" for t in s.to_pylist()]) for s in slices(b)] or [spoken([])]
        yield pa.StructArray.from_arrays([pa.concat_arrays([p for p, _ in parts]), pa.array(np.concatenate([c for _, c in parts]))], ["language", "confidence"])


def language(docs: DataFrame, text: str = "canonical") -> DataFrame:
    """docs plus language (null below LEAST_CHARS characters or without a vote) and confidence: the share of the winner's votes, first by code on ties."""
    docs = docs.withColumn("spoken", told(text)).withColumn("language", F.col("spoken.language")).withColumn("confidence", F.col("spoken.confidence"))
    return supported(docs.drop("spoken"))


def supported(docs: DataFrame) -> DataFrame:
    return docs.withColumn("fully_supported", F.coalesce(F.col("language") == "en", F.lit(False)))


def table_row(text: str) -> str:
    """SQL: the text has a tab, or at most six words and no end of a sentence."""
    return rf"(contains({text}, '\t') OR (size(filter(split({text}, '(?U)\\s+'), w -> w <> '')) <= 6 AND NOT regexp_replace({text}, '(?U)\\s+$', '') rlike '[.!?]$'))"


_CONTROLS = re.compile("[\x1c-\x1f]")  # white space for Python's `split` alone
_GAPS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def is_row(text: str) -> bool:
    """As `table_row`."""
    words = [w for w in _GAPS.split(text) if w] if _CONTROLS.search(text) else text.split()
    return "\t" in text or len(words) <= 6 and not (words and words[-1][-1] in ".!?")


def prose_measures(docs: DataFrame, tokens: DataFrame, clauses: DataFrame) -> DataFrame:
    """doc_id, tokens, stopword_ratio, mean_sentence_len, table_line_ratio of every document; nothing over nothing is 0."""
    words = tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum(F.col("is_stopword").cast("long")).alias("stops"))
    lines = clauses.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.sum(F.expr(f"cast({table_row('text')} AS long)")).alias("rows"))
    return ratios(docs.select("doc_id").join(words, "doc_id", "left").join(lines, "doc_id", "left").fillna(0, ["tokens", "stops", "clauses", "rows"]))


def ratios(counts: DataFrame) -> DataFrame:
    """Columns with tokens, stops, clauses and rows of each document -> the prose measures in place of the last three."""
    kept = [c for c in counts.columns if c not in ("stops", "clauses", "rows")]
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0D ELSE {a} / {b} END"
    return counts.selectExpr(*kept, f"{ratio('stops', 'tokens')} AS stopword_ratio", f"{ratio('tokens', 'clauses')} AS mean_sentence_len", f"{ratio('rows', 'clauses')} AS table_line_ratio")


def verdict(measures: DataFrame, config: Config = Config()) -> DataFrame:
    """measures (with language and tabular) plus reason and is_prose: the first test that fails decides."""
    p = config.prose
    reason = (
        F.when(F.col("tabular"), "InherentlyTabular").when(F.coalesce(F.col("language") != "en", F.lit(True)), "NotEnglish").when(F.col("tokens") < p.min_tokens, "TooFewTokens")
        .when(F.col("mean_sentence_len") < p.min_mean_sentence_len, "SentencesTooShort").when(F.col("stopword_ratio") < p.min_stopword_ratio, "TooFewStopwords")
        .when(F.col("table_line_ratio") > p.max_table_line_ratio, "TooManyTableLines").otherwise("Prose")
    )
    return measures.withColumn("reason", reason).withColumn("is_prose", F.col("reason") == "Prose")


REASONS = {
    "Prose": "it is running text", "InherentlyTabular": "its format holds tables", "TooFewTokens": "there are too few words to count", "SentencesTooShort": "its sentences are short",
    "TooFewStopwords": "it has few function words", "TooManyTableLines": "many of its lines look like rows", "NotEnglish": "only English is counted",
}


def summary(verdicts: DataFrame) -> DataFrame:
    """verdicts plus summary, one line for people."""
    said = F.coalesce(*(F.when(F.col("reason") == k, v) for k, v in REASONS.items()))
    return verdicts.withColumn("summary", F.format_string("%s; sentences of %.1f words, %.0f%% function words, %.0f%% rows, %d words", said, "mean_sentence_len", F.col("stopword_ratio") * 100, F.col("table_line_ratio") * 100, "tokens"))
