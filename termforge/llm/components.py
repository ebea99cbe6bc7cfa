"""Connected components of a table of links, by alternating large-star and small-star steps; of few links, at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.common import stored


#: Links up to which components are found in the driver: 16 bytes each to it, and up to twice as many rows (node, root) back.
MOST_LOCAL = 100_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of links and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root != root[root]).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def connected(links: DataFrame, most: int = 200) -> DataFrame:
    """(a, b) links of longs -> (node, root): root is the least node of the component; nodes without links are absent.

    Every step replaces links by links to a neighbourhood's least node: no neighbourhood is gathered, and the
    number of steps grows with the logarithm of the nodes. Each step's links are written to the shared folder.
    Up to MOST_LOCAL links need no steps: the driver finds their components, and the result is broadcast where it is joined.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "links")
    if edges.count() <= MOST_LOCAL:
        found = edges.toArrow()
        nodes, roots = _roots(found["a"].to_numpy(), found["b"].to_numpy())
        return F.broadcast(links.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())})))
    was = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = _least(large)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"links did not settle in {most} steps")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
