"""Files to text: format by content, one reader a format, errors as a column."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.sources import pdf

#: Header names that tell a mail, in alphabetical order.
_HEADERS = ("date:", "delivered-to:", "from:", "message-id:", "mime-version:", "received:", "return-path:", "subject:", "to:")
KIND = {"Pdf": "Pdf", "Docx": "WordProcessing", "Xlsx": "Spreadsheet", "Pptx": "Presentation", "Email": "Email"}
#: The PDF reader, (bytes) -> (text, has a text layer): the last one. Another one may be put here; with none PDF is UnsupportedFormat.
PDF_READER: list[Callable[[bytes], tuple[str, bool]]] = [pdf.text_of]


class Encrypted(Exception):
    pass


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and content of all files below path, or of several. Sorting is left to the output.

    Files that vanish or can't be read are passed over; `unread` tells them. Names that start with `_` or `.` are not listed.
    """
    return spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).load(path).select("path", "content")


def unread(spark: SparkSession, path: str, read: DataFrame) -> DataFrame:
    """Paths that are listed but missing among those read."""
    return files(spark, path).select("path").join(read.select("path"), "path", "left_anti")


def sniffed(content: bytes) -> str:
    """The format by its first bytes; names and endings are not asked."""
    if content[:5] == b"%PDF-":
        return "Pdf"
    if content[:4] == b"\xd0\xcf\x11\xe0":
        return "Email"
    if content[:4] == b"PK\x03\x04":
        try:
            for name in zipfile.ZipFile(io.BytesIO(content)).namelist():
                for start, kind in (("word/", "Docx"), ("xl/", "Xlsx"), ("ppt/", "Pptx")):
                    if name.startswith(start):
                        return kind
        except zipfile.BadZipFile:
            pass
        return "PlainText"
    try:
        lines = content[:2048].decode().splitlines()[:12]
    except UnicodeDecodeError:
        return "PlainText"
    return "Email" if sum(line.lower().startswith(_HEADERS) for line in lines) >= 2 else "PlainText"


def plain(content: bytes) -> str:
    content = content.removeprefix(b"\xef\xbb\xbf")
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("latin-1")


def mail(content: bytes) -> str:
    m = email.message_from_bytes(content, policy=email.policy.default)
    parts = [p.get_content() for p in m.walk() if p.get_content_type() == "text/plain" and not p.is_attachment()]
    return "".join(x.rstrip("\n") + "\n" for x in [str(m["subject"] or ""), *parts] if x)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def paragraphs(xml: bytes) -> str:
    """Text of all elements named t; a line feed where an element named p ends."""
    out = []
    for event, e in ElementTree.iterparse(io.BytesIO(xml), ("end",)):
        if _local(e.tag) == "t":
            out.append(e.text or "")
        elif _local(e.tag) == "p":
            out.append("\n")
    return "".join(out)


def _parts(content: bytes, name: str) -> list[bytes]:
    z = zipfile.ZipFile(io.BytesIO(content))
    return [z.read(n) for n in sorted(z.namelist()) if re.fullmatch(name, n)]


def word(content: bytes) -> str:
    return "".join(map(paragraphs, _parts(content, r"word/document\.xml")))


def slides(content: bytes) -> str:
    return "".join(paragraphs(p) + "\n" for p in _parts(content, r"ppt/slides/slide.*\.xml"))


def sheets(content: bytes) -> str:
    """Sheet names, and each row's strings and ISO dates with tabs between them; numbers and truth values are left out."""
    z = zipfile.ZipFile(io.BytesIO(content))
    read = lambda n: ElementTree.fromstring(z.read(n))
    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
    out = []
    for k, sheet in enumerate((e for e in read("xl/workbook.xml").iter() if _local(e.tag) == "sheet"), 1):
        rid = next((v for a, v in sheet.attrib.items() if _local(a) == "id"), None)
        path = "xl/" + str(targets.get(rid) or f"worksheets/sheet{k}.xml").removeprefix("/xl/")
        if path not in names:
            continue
        out.append(sheet.get("name", "") + "\n")
        for row in (e for e in read(path).iter() if _local(e.tag) == "row"):
            cells = []
            for c in row:
                value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                text = {"s": lambda v=value: shared[int(v)], "str": lambda v=value: v, "d": lambda v=value: v, "inlineStr": lambda c=c: "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")}.get(c.get("t"), str)()
                if text.strip():
                    cells.append(text.strip())
            if cells:
                out.append("\t".join(cells) + "\n")
    return "".join(out)


def parsed(content: bytes, hint: str | None = None, least_layer: int = 32) -> tuple[str | None, str, bool | None, str | None]:
    """(text, source kind, text layer, error) of a file; a broken file gives an error, never an exception."""
    kind = hint or sniffed(content)
    source, layer = KIND.get(kind, "Plain"), None
    try:
        if kind == "Pdf":
            if not PDF_READER:
                return None, source, None, "UnsupportedFormat"
            text, layer = PDF_READER[-1](content)
            layer = layer and len(text.strip()) >= least_layer
        else:
            text = {"Docx": word, "Xlsx": sheets, "Pptx": slides, "Email": mail}.get(kind, plain)(content)
        return text, source, layer, None
    except (Encrypted, pdf.Locked):
        return None, source, None, "Encrypted"
    except Exception as e:  # any malformed file is a result, not a failure of the run
        return None, source, None, f"{kind}: {type(e).__name__}: {e}"[:300]


def documents(found: DataFrame, least_layer: int = 32) -> DataFrame:
    """(path, content[, hint]) -> doc_id (a hash of the path), path, text, source, text_layer, error, hash_exact."""

    @F.pandas_udf("text string, source string, text_layer boolean, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for content, hint in batches:
            yield pd.DataFrame([parsed(c, h, least_layer) for c, h in zip(content, hint)], columns=["text", "source", "text_layer", "error"])

    hint = F.col("hint") if "hint" in found.columns else F.lit(None).cast("string")
    rows = found.select("path", F.xxhash64("path").alias("doc_id"), F.sha2("content", 256).alias("hash_exact"), read("content", hint).alias("p"))
    return rows.select("doc_id", "path", F.coalesce("p.text", F.lit("")).alias("text"), "p.source", "p.text_layer", "p.error", "hash_exact")


def tsv(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """surface, register, scheme, file of three-column tables with # comments; the first rows of each file if asked for."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"[^/]*$", 0).alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line")).where("line <> '' AND NOT startswith(line, '#')")
    rows = lines.select("file", "n", F.split("line", "\t").alias("f"))
    rows = rows.select("file", "n", F.when(F.size("f") == 3, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not three columns in "), "file"))).alias("f"))
    if first is not None:
        from pyspark.sql import Window

        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("n"))).where(F.col("r") <= first)
    return rows.select(F.col("f")[0].alias("surface"), F.col("f")[1].alias("register"), F.col("f")[2].alias("scheme"), "file")
