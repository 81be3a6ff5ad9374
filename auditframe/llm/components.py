"""Connected components of an edge list, by alternating large and small stars.

Each round replaces edges by edges to the smallest neighbour (large star: of the larger
neighbours; small star: of the smaller ones), until nothing changes: a logarithmic number
of rounds in practice. Labels are the smallest node of each component. Only minima are
aggregated by node, with partial aggregation, so a hub costs one row per map task; the
joins with the minima are skew-splittable. Lineage is cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import shared_dir, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has b < a. Large: link larger neighbours of each node to its smallest; small: smaller ones and itself."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        rows = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = rows.groupBy("u").agg(F.min("v").alias("m"))
        out = rows.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``edges`` (columns a, b of one orderable type)."""
    path = shared_dir(edges.sparkSession)
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{path}/0")
    state, step = None, 0
    while True:
        one = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (one.n, one.s) == state or not one.n:
            break
        state, step = (one.n, one.s), step + 1
        now = stored(_star(_star(now, True), False), f"{path}/{step}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
