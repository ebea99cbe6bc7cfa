"""Records of documents, and their forms: JSON lines, JSON, CSV, tables for people."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from termforge.config import Config
from termforge.operators import gates
from termforge.plans.extraction import KINDS, Extraction

CSV_COLUMNS = ("path", "status", "kind", "rank", "score", "frequency", "original_keyword", "normalised", "origin", "expansion")
#: Why a document that is not Ok has no keywords.
STATUS_REASONS = {
    "Ok": "", "TooShort": "its text is too short", "NoTextLayer": "its pages hold pictures and no text", "Encrypted": "it is locked with a password",
    "UnsupportedFormat": "nothing here reads its format", "ParseError": "its format is damaged",
}
WIDE = 28


def status_label(status: Column, message: Column) -> Column:
    """The status, with its message where parsing failed."""
    return F.when(status == "ParseError", F.concat_ws(": ", status, message)).otherwise(status)


def origin_label(origin: str, expansion: str | None) -> str:
    return origin.lower() if expansion is None else f"{origin.lower()} = {expansion}"


def records(found: Extraction, kinds: Iterable[str] = tuple(KINDS), top: int | None = None, features: bool = False) -> DataFrame:
    """One row a document with the keywords that are asked for; ranks are those among all keywords of a kind.

    features adds to each shape keyword its components (name, value, weight, contribution).
    """
    wanted = [k for k in KINDS if k in set(kinds)]
    keep = lambda k: k["kind"].isin(*wanted) & (F.lit(True) if top is None else k["rank"] < top)
    rows = found.results()
    if "path" in found.documents.columns:
        rows = rows.join(found.documents.select("doc_id", "path"), "doc_id")
    else:
        rows = rows.withColumn("path", F.col("doc_id").cast("string"))
    rows = rows.withColumn("keywords", F.filter("keywords", keep))
    if features or found.config.retain_features:
        from termforge.operators import analysis

        parts = analysis.components(found.candidates, found.config).groupBy("doc_id", F.col("normalised").alias("of")).agg(F.sort_array(F.collect_list(F.struct("name", "value", "weight", "contribution"))).alias("parts"))
        told = parts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("of", "parts"))).alias("features"))
        rows = rows.join(told, "doc_id", "left")
    return rows


def empty_reasons(rows: DataFrame, config: Config) -> DataFrame:
    """rows plus reasons: a map from each kind without keywords to why it has none."""
    t = config.thresholds
    prose = F.format_string(f"prose, but nothing at or below {t.topical:g}")
    not_prose = F.coalesce(*(F.when(F.col("prose.reason") == k, F.lit(f"not counted: {v}")) for k, v in gates.REASONS.items() if k != "Prose"), prose)
    why = {"Identifier": F.lit(f"nothing scores {t.identifier:g} or more"), "Technical": F.lit(f"nothing scores {t.technical:g} or more"), "Topical": not_prose if config.enable_topical else F.lit("switched off")}
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in why.items()))
    missing = F.filter(entries, lambda e: ~F.exists("keywords", lambda k: k["kind"] == e["key"]))
    return rows.withColumn("reasons", F.when(F.col("status") == "Ok", F.map_from_entries(missing)))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value) a JSON object a document."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_lines(rows).write.mode(mode).text(path)


def csv_rows(rows: DataFrame) -> DataFrame:
    """A row for each keyword, and one for a document without any."""
    flat = rows.select("path", status_label(F.col("status"), F.col("message")).alias("status"), F.explode_outer("keywords").alias("k"))
    named = {"score": F.when(F.col("k.score").isNotNull(), F.format_string("%.4f", "k.score"))}
    return flat.select("path", "status", *(named.get(c, F.col(f"k.{c}")).alias(c) for c in CSV_COLUMNS[2:]))


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    csv_rows(rows).write.mode(mode).csv(path, header=True, escape='"', nullValue="", emptyValue="")


def csv_text(rows: DataFrame) -> Iterator[str]:
    """Lines of one CSV file, by path; rows stream to the driver."""

    def line(values: Iterable) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow("" if v is None else v for v in values)
        return out.getvalue()

    yield line(CSV_COLUMNS)
    order = [F.col("path"), F.when(F.col("kind") == "Identifier", 0).when(F.col("kind") == "Technical", 1).otherwise(2), F.col("rank")]
    for r in csv_rows(rows).orderBy(*order).toLocalIterator():
        yield line(r)


def json_text(rows: DataFrame) -> str:
    """All documents as one array; for results that fit the driver."""
    return json.dumps([json.loads(r["value"]) for r in rows.orderBy("path").select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator()], indent=2, ensure_ascii=False)


def short(text: str, most: int = WIDE) -> str:
    """White space collapsed, and cut with an ellipsis."""
    text = " ".join(text.split())
    return text if len(text) <= most else text[: most - 1] + "…"


def block(r: Row) -> str:
    """What people see of one document."""
    status = r["status"] + (f": {r['message']}" if r["message"] else "")
    out = [f"{r['path']}  [{status}]"]
    if r["status"] != "Ok":
        return "\n".join([*out, f"  no keywords: {STATUS_REASONS.get(r['status'], r['status'])}"])
    for kind in KINDS:
        own = [k for k in r["keywords"] if k["kind"] == kind]
        if not own and kind in (r["reasons"] or {}):
            out.append(f"  {kind}: none ({r['reasons'][kind]})")
        elif own:
            out.append(f"  {kind}")
            out += [f"    {k['rank']:>3}  {k['score']:.3f}  {short(k['original_keyword']):<{WIDE}}  x{k['frequency']}  {origin_label(k['origin'], k['expansion'])}" for k in own]
    return "\n".join(out)


def table_text(rows: DataFrame, config: Config) -> Iterator[str]:
    for r in empty_reasons(rows, config).orderBy("path").toLocalIterator():
        yield block(r)


def tally_line(counts: dict[str, int], unreadable: int = 0) -> str:
    """Counts by status that are not zero."""
    said = [f"{n} {k}" for k, n in counts.items() if n] + ([f"{unreadable} unreadable"] if unreadable else [])
    return f"{sum(counts.values()) + unreadable} documents: " + (", ".join(said) or "none")


def exit_code(counts: dict[str, int], unreadable: int, strict: bool) -> int:
    """1 if a file could not be read; else 2 if all must be Ok and some are not; else 0."""
    if unreadable:
        return 1
    return 2 if strict and counts.get("Ok", 0) != sum(counts.values()) else 0
