"""Running sums and maxima over an ordered column in two levels, so no window holds all rows.

The column's range is cut into ``BUCKETS`` equal parts. A window runs within each part, and one over
the parts' totals, ``BUCKETS`` rows for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def running(rows: DataFrame, keys: list[str], order: str, values: list[str], descending: bool = False, largest: bool = False) -> DataFrame:
    """``rows`` with each of ``values`` as its running sum (``largest``: maximum) and ``<value>_before``, that of the rows before (NULL at the first).

    ``rows`` has one row for each value of ``order`` (a number) within ``keys``.
    """
    fold = F.max if largest else F.sum
    both = (lambda a, b: F.greatest(a, b)) if largest else (lambda a, b: F.coalesce(a + b, a, b))
    bounds = rows.agg(F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi"))
    share = (F.col(order) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    rows = rows.join(F.broadcast(bounds)).withColumn("_b", part).drop("_lo", "_hi")
    way = F.desc if descending else F.asc
    over = Window.partitionBy(*keys).orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_b").agg(*[fold(v).alias(v) for v in values])
    totals = totals.select(*keys, "_b", *[fold(v).over(over).alias(f"_t_{v}") for v in values])
    within = Window.partitionBy(*keys, "_b").orderBy(way(order))
    here = {v: fold(v).over(within.rowsBetween(Window.unboundedPreceding, 0)) for v in values}
    before = {v: fold(v).over(within.rowsBetween(Window.unboundedPreceding, -1)) for v in values}
    kept = [c for c in rows.columns if c not in values]
    rows = rows.select(*kept, *[here[v].alias(f"_h_{v}") for v in values], *[before[v].alias(f"_p_{v}") for v in values])
    out = rows.join(totals, [*keys, "_b"])
    names = [c for c in kept if c != "_b"]
    return out.select(*names, *[both(F.col(f"_h_{v}"), F.col(f"_t_{v}")).alias(v) for v in values], *[both(F.col(f"_p_{v}"), F.col(f"_t_{v}")).alias(f"{v}_before") for v in values])
