"""How tables are dealt out to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """A table as it is read where its files make enough tasks for all cores, else dealt out once by its key."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(4 * cores, key)
