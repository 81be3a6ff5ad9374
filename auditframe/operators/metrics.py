"""Discrimination, calibration and selective prediction over units."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions.numeric import div
from auditframe.operators.bootstrap import group_index, weights
from auditframe.operators.running import running
from auditframe.operators.storage import materialised


def auc(rows: DataFrame, score: str, positive: Column, keys: list[str]) -> DataFrame:
    """(keys, n_pos, n_neg, auc): Mann-Whitney with ties counted half, from counts per distinct score."""
    counts = rows.groupBy(*keys, F.col(score).alias("_score")).agg(F.sum(positive.cast("long")).alias("_pos"), F.sum((~positive).cast("long")).alias("_neg"))
    counts = running(counts, keys, "_score", ["_neg"])
    below = F.coalesce("_neg_before", F.lit(0))
    own = F.col("_neg") - below
    rows = counts.groupBy(*keys).agg(F.sum("_pos").alias("n_pos"), F.sum(own).alias("n_neg"), F.sum(F.col("_pos") * (2 * below + own)).alias("_wins"))
    return rows.select(*keys, "n_pos", "n_neg", div(F.col("_wins"), 2 * F.col("n_pos") * F.col("n_neg")).alias("auc"))


def auc_by_level(units: DataFrame, levels: list[int]) -> DataFrame:
    """(level, n_pos, n_neg, auc) of each lesion level against sound units."""
    names = units.sparkSession.createDataFrame([(x,) for x in levels], "at int")
    rows = units.join(F.broadcast(names), (F.col("level") == 0) | (F.col("level") == F.col("at")))
    return auc(rows, "p_lesion", F.col("level") > 0, ["at"]).withColumnRenamed("at", "level")


def resampled_auc(units: DataFrame, score: str, seed: int, n_boot: int = 2000) -> tuple[DataFrame, DataFrame]:
    """``(values, samples)`` of auc_1 and auc_2 (levels 1 and 2 against sound units) and auc_gap (auc_2 - auc_1), by groups drawn with replacement.

    Units enter as counts per group and distinct score, so a resample costs as many rows as there are distinct scores. A
    resample without one of the levels has no value for what needs it.
    """
    index = group_index(units)
    w = weights(index, index.count(), seed, n_boot).unionByName(index.select(F.lit(-1).alias("b"), "g", F.lit(1).cast("long").alias("w")))
    counts = units.groupBy("group_key", F.col(score).alias("score")).agg(*[F.count_if(F.col("level") == i).alias(f"n{i}") for i in range(3)]).join(index, "group_key")
    curve = counts.join(w, "g").groupBy("b", "score").agg(*[F.sum(F.col(f"n{i}") * F.col("w")).alias(f"n{i}") for i in range(3)])
    below = F.coalesce(F.sum("n0").over(Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = curve.withColumn("twice", 2 * below + F.col("n0"))
    total = wins.groupBy("b").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)], *[F.sum(F.col(f"n{i}") * F.col("twice")).alias(f"t{i}") for i in (1, 2)])
    one = {i: div(F.col(f"t{i}"), 2 * F.col(f"n{i}") * F.col("n0")) for i in (1, 2)}
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), v.alias("v")) for n, v in (("auc_1", one[1]), ("auc_2", one[2]), ("auc_gap", one[2] - one[1]))]))
    rows = total.select("b", listed.alias("s")).select("b", "s.*")
    return rows.filter("b < 0").drop("b"), rows.filter("b >= 0")


def brier(rows: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("p") - F.col("y")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e * e).alias("brier"))


def uniform_bins(rows: DataFrame, n_bins: int) -> DataFrame:
    """``rows`` with a bin of equal width; an edge belongs to the upper bin."""
    return rows.withColumn("bin", F.least(F.floor(F.col("p") * F.lit(float(n_bins))), F.lit(n_bins - 1)).cast("int"))


def quantile_bins(rows: DataFrame, n_bins: int) -> DataFrame:
    """``rows`` with a bin of equal count; equal edges collapse, an edge belongs to the upper bin."""
    edges = rows.agg(F.array_sort(F.array_distinct(F.percentile("p", F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])))).alias("edges"))
    return rows.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("p")))).drop("edges")


def reliability(binned: DataFrame) -> DataFrame:
    """(bin, n, mean_p, rate) of the populated bins."""
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))


def ece(binned: DataFrame) -> DataFrame:
    gaps = binned.groupBy("bin").agg(F.abs(F.sum("p") - F.sum("y")).alias("gap"), F.count("*").alias("n"))
    return gaps.agg(F.sum("n").alias("n"), div(F.sum("gap"), F.sum("n")).alias("ece"))


def recalibration(rows: DataFrame, iterations: int = 100, tolerance: float = 1e-10) -> tuple[float, float] | None:
    """(slope, intercept) of the outcome on logit(p), by Newton steps on five sums; None if one class, constant or separable."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    data = rows.groupBy(F.log(p / (1 - p)).alias("x")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    data = materialised(data)
    n, y, lo, hi = data.agg(F.sum("n"), F.sum("y"), F.min("x"), F.max("x")).first()
    if not n or y in (0, n) or hi - lo < 1e-12:
        return None
    a, b = math.log(y / (n - y)), 0.0
    for _ in range(iterations):
        mu = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w, r = F.col("n") * mu * (1 - mu), F.col("y") - F.col("n") * mu
        s = data.agg(F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x")), F.sum(r), F.sum(r * F.col("x"))).first()
        det = s[0] * s[2] - s[1] * s[1]
        if not det > 1e-12 * max(1.0, s[0] * s[2]):
            return None
        da, db = (s[2] * s[3] - s[1] * s[4]) / det, (s[0] * s[4] - s[1] * s[3]) / det
        a, b = a + da, b + db
        if not (math.isfinite(a) and math.isfinite(b)) or abs(b) > 1e6:
            return None
        if max(abs(da), abs(db)) < tolerance:
            return b, a
    return None


def risk_coverage(rows: DataFrame) -> DataFrame:
    """(confidence, coverage, risk) at each distinct confidence, highest first."""
    counts = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum((~F.col("correct")).cast("long")).alias("wrong"))
    total = counts.agg(F.sum("n").alias("total"))
    seen = running(counts, [], "confidence", ["n", "wrong"], descending=True)
    return seen.join(F.broadcast(total)).select("confidence", div(F.col("n"), F.col("total")).alias("coverage"), div(F.col("wrong"), F.col("n")).alias("risk"))


def aurc(curve: DataFrame) -> DataFrame:
    step = running(curve.select("confidence", "risk", "coverage"), [], "confidence", ["coverage"], descending=True, largest=True)
    return step.agg(F.sum((F.col("coverage") - F.coalesce("coverage_before", F.lit(0.0))) * F.col("risk")).alias("aurc"))


def operating_point(rows: DataFrame, constraint: str, target: float, coverage: float = 1.0) -> DataFrame:
    """One row (threshold, strict, fitted, margin).

    Sensitivity: the highest threshold with enough positives at or above it. Specificity: the
    k-th lowest negative, above which (strictly) a unit is positive. ``margin``: the distance
    within which the nearest share of units is referred, the boundary included.
    """
    if constraint not in ("sensitivity", "specificity") or not 0 < target <= 1 or not 0 < coverage <= 1:
        raise ValueError(f"no such operating point: {constraint} {target}, coverage {coverage}")
    strict = constraint == "specificity"
    of = rows.filter(F.col("y") == (0 if strict else 1))
    counts = of.groupBy("p").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    seen = running(counts, [], "p", ["n"], descending=not strict).select("p", F.col("n").alias("seen")).join(F.broadcast(total)).filter(F.col("seen") >= F.ceil(F.lit(target) * F.col("total")))
    at = seen.groupBy("total").agg((F.min if strict else F.max)("p").alias("threshold"), F.min(F.struct("seen")).alias("first"))
    at = at.select("threshold", F.lit(strict).alias("strict"), div(F.col("first.seen"), F.col("total")).alias("fitted"))
    if coverage >= 1:
        return at.withColumn("margin", F.lit(None).cast("double"))
    near = rows.join(F.broadcast(at.select("threshold"))).groupBy(F.abs(F.col("p") - F.col("threshold")).alias("d")).agg(F.count("*").alias("n"))
    total = near.agg(F.sum("n").alias("total"))
    margin = running(near, [], "d", ["n"]).select("d", F.col("n").alias("seen")).join(F.broadcast(total)).filter(F.col("seen") >= F.ceil(F.lit(1 - coverage) * F.col("total"))).agg(F.min("d").alias("margin"))
    return at.join(F.broadcast(margin))


def selective_sums(point: dict) -> dict[str, Column]:
    """Additive statistics of a frozen operating point over (y, p)."""
    positive = F.col("p") > point["threshold"] if point["strict"] else F.col("p") >= point["threshold"]
    accepted = F.lit(True) if point["margin"] is None else F.abs(F.col("p") - point["threshold"]) > point["margin"]
    y = F.col("y") == 1
    flags = {"n": F.lit(True), "acc": accepted, "pos": y, "neg": ~y, "pos_acc": y & accepted, "neg_acc": ~y & accepted, "tp": y & positive, "tn": ~y & ~positive, "tp_acc": y & accepted & positive, "tn_acc": ~y & accepted & ~positive, "missed": y & accepted & ~positive}
    return {k: v.cast("long") for k, v in flags.items()}


def selective_rates() -> dict[str, Column]:
    c = F.col
    return {
        "coverage": div(c("acc"), c("n")), "sensitivity_accepted": div(c("tp_acc"), c("pos_acc")), "specificity_accepted": div(c("tn_acc"), c("neg_acc")),
        "missed_positive_rate": div(c("missed"), c("pos")), "sensitivity": div(c("tp"), c("pos")), "specificity": div(c("tn"), c("neg")),
    }
