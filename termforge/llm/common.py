"""What the training-data operators share: shared scratch storage and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATHS = ("documents", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that setting is absent (local tests) is a temporary folder set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="termforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there.

    The files survive a lost executor, and every later reader sees the same rows, also where
    the plan above them (sampled range bounds, partition numbers) would not repeat exactly.
    """
    path = f"{shared_dir(df.sparkSession)}/termforge/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict[tuple[str, str], object] = {}


def held(kind: str, key: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one thing, so that what operators of one job keep doesn't add up."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        _HELD[kind, key] = make()
    return _HELD[kind, key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null text as empty; other columns are left behind, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
