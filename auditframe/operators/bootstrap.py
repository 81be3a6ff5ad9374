"""Cluster bootstrap as relational algebra.

A resample draws as many groups with replacement as there are. Draws come from a counter:
hash(seed, resample, slot) modulo the number of groups, so they need no state and any task
can make its own. The draws of all resamples become one weight table (b, g, w), shared by
every statistic of a data set; equal seeds over equal groups are therefore paired.

Additive statistics are functions of sums: sums per group are aggregated once, and each
resample is a weighted sum of them, at a cost of resamples x groups however many units there
are. ``poisson`` weights are the form for very many groups: independent Poisson(1) counts by
hash, without an index of groups and without a join of draws.

A statistic that is undefined on a resample is NULL: left out of the interval, and counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.functions.numeric import draw, rounded, uniform


def group_index(groups: DataFrame) -> DataFrame:
    """(group_key, g): groups numbered 0.. in order of their key; one row per group, however many units."""
    keys = groups.select("group_key").filter(F.col("group_key").isNotNull()).distinct()
    return keys.select("group_key", (F.row_number().over(Window.orderBy("group_key")) - 1).alias("g"))


def weights(index: DataFrame, n_groups: int, seed: int, n_boot: int) -> DataFrame:
    """(b, g, w): how often group g is drawn in resample b."""
    if n_groups < 2:
        raise ValueError(f"a cluster bootstrap needs at least two groups, got {n_groups}")
    slots = index.sparkSession.range(n_boot * n_groups).select(F.floor(F.col("id") / n_groups).cast("int").alias("b"), (F.col("id") % n_groups).alias("slot"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("slot").cast("string"))
    return slots.select("b", draw(text, F.lit(n_groups)).alias("g")).groupBy("b", "g").agg(F.count("*").alias("w"))


def poisson_weights(index: DataFrame, seed: int, n_boot: int) -> DataFrame:
    """(b, group_key, w): independent Poisson(1) weights; no draw table, no index."""
    rows = index.select("group_key", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    u = uniform(F.concat_ws(":", F.lit(f"poisson:{seed}"), F.col("b").cast("string"), "group_key"))
    bounds, total, term = [], 0.0, math.exp(-1.0)
    for k in range(1, 10):
        total += term
        bounds.append(total)
        term /= k
    w = F.lit(0)
    for k, bound in enumerate(bounds, 1):
        w = F.when(u >= bound, k).otherwise(w)
    return rows.select("b", "group_key", w.alias("w")).filter("w > 0")


def interval(samples: DataFrame, keys: list[str], level: float) -> DataFrame:
    """(keys, statistic, lo, hi, n_valid) from samples (keys, b, statistic, v)."""
    alpha = (1 - level) / 2
    bounds = F.percentile("v", F.array(F.lit(alpha), F.lit(1 - alpha)))
    return samples.groupBy(*keys, "statistic").agg(bounds.alias("q"), F.count("v").alias("n_valid")).select(*keys, "statistic", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_valid")


class Resampled:
    """Additive statistics of one data set: ``sums`` per (keys, group), and ``finals`` of the summed columns."""

    def __init__(self, rows: DataFrame, sums: dict[str, Column], finals: dict[str, Column], keys: list[str], seed: int, n_boot: int = 2000):
        self.keys, self.finals, self.seed, self.n_boot = keys, finals, seed, n_boot
        self.index = group_index(rows)
        self.n_groups = self.index.count()
        per_group = rows.groupBy(*keys, "group_key").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
        self.names = list(sums)
        self.per_group = per_group.join(self.index, "group_key")

    def _listed(self, summed: DataFrame, extra: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), c.cast("double").alias("v")) for n, c in self.finals.items()]))
        return summed.select(*self.keys, *extra, each.alias("s")).select(*self.keys, *extra, "s.*")

    def values(self) -> DataFrame:
        """(keys, statistic, v) on the full data."""
        return self._listed(self.per_group.groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.names]), [])

    def samples(self) -> DataFrame:
        """(keys, b, statistic, v) of every resample."""
        w = weights(self.index, self.n_groups, self.seed, self.n_boot)
        summed = self.per_group.join(w, "g").groupBy(*self.keys, "b").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in self.names])
        return self._listed(summed, ["b"])

    def estimates(self, level: float = 0.95) -> DataFrame:
        """(keys, statistic, value, lo, hi, n_valid), rounded."""
        return estimate(self.values(), self.samples(), self.keys, level)


def estimate(values: DataFrame, samples: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    found = values.withColumnRenamed("v", "value").join(interval(samples, keys, level), [*keys, "statistic"], "left")
    return found.select(*keys, "statistic", *[rounded(F.col(c)).alias(c) for c in ("value", "lo", "hi")], F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


def difference(a: Resampled, b: Resampled, paired: bool) -> tuple[DataFrame, DataFrame]:
    """(values, samples) of a - b, resample by resample. Paired: same seed and groups; else different seeds."""
    if paired and (a.seed != b.seed or digest(a) != digest(b)):
        raise ValueError("paired estimates need the same seed and the same groups")
    if not paired and a.seed == b.seed:
        raise ValueError("unpaired estimates need different seeds")
    if a.n_boot != b.n_boot:
        raise ValueError("estimates have different numbers of resamples")
    minus = F.col("v") - F.col("w")
    join = lambda x, y, on: x.join(y.withColumnRenamed("v", "w"), on).select(*on, minus.alias("v"))
    return join(a.values(), b.values(), [*a.keys, "statistic"]), join(a.samples(), b.samples(), [*a.keys, "b", "statistic"])


def digest(x: Resampled) -> tuple:
    """Identifies a set of groups, in any order."""
    one = x.index.agg(F.count("*").alias("n"), F.sum(F.xxhash64("group_key").cast("decimal(38,0)")).alias("s")).first()
    return one.n, one.s
