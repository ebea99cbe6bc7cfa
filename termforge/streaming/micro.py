"""Extraction over streams: each micro-batch is a batch of documents, and no state is kept between them.

A document's result depends on it alone, so there is no watermark and no late row. A batch is written to a folder of
its own number, which a repeated batch overwrites: the output has every document once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termforge.config import Config
from termforge.plans import extraction
from termforge.resources import Resources
from termforge.sources import parse

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark, path: str, **options: str) -> DataFrame:
    """New files below path, as they come: path and content."""
    return spark.readStream.format("binaryFile").schema(FILES).options(recursiveFileLookup="true", **options).load(path).select("path", "content")


def from_files(batch: DataFrame) -> DataFrame:
    return parse.documents(batch)


def keywords_of(x: extraction.Extraction) -> DataFrame:
    return x.keywords


def results_of(x: extraction.Extraction) -> DataFrame:
    return x.results()


def extract_stream(
    stream: DataFrame, sink: str, checkpoint: str, config: Config, resources: Resources, prepare: Callable[[DataFrame], DataFrame] = extraction.sourced, wanted: Callable[[extraction.Extraction], DataFrame] = results_of, once: bool = True
) -> StreamingQuery:
    """Start a query that writes results of each batch as Parquet under sink/batch=N. prepare makes documents of a batch's rows."""

    def write(batch: DataFrame, number: int) -> None:
        x = extraction.extract(prepare(batch), config, resources)
        wanted(x).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        x.tokens.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
