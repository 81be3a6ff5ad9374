"""Probes for hidden structure, and the small models they need."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.numeric import div
from auditframe.operators.metrics import auc
from auditframe.operators.storage import materialised


@dataclass(frozen=True)
class Normal:
    """One mode: its share of the sample, centre and spread."""

    share: float
    centre: float
    spread: float


@dataclass(frozen=True)
class Mixture:
    """A sample of similarities as one mode or two: the information criterion of each (less is better), and the two modes, lower first."""

    criterion: tuple[float, float]
    low: Normal
    high: Normal

    @property
    def distance(self) -> float:
        """Ashman's D: distance of the modes in units of their spread."""
        return math.sqrt(2) * (self.high.centre - self.low.centre) / math.hypot(self.low.spread, self.high.spread)

    @property
    def separated(self) -> bool:
        return self.criterion[1] < self.criterion[0] and self.distance > 2

    def crossing(self) -> float:
        """Where the high mode becomes the denser one between the centres: the root of a quadratic in x, as the log densities are quadratics."""
        a, b = self.low, self.high
        level = lambda m: math.log(m.share / m.spread) - m.centre**2 / (2 * m.spread**2)
        square = 0.5 / a.spread**2 - 0.5 / b.spread**2
        line = b.centre / b.spread**2 - a.centre / a.spread**2
        rest = level(b) - level(a)
        if abs(square) < 1e-12 * line:
            roots = [-rest / line]
        else:
            root = math.sqrt(max(line * line - 4 * square * rest, 0.0))
            roots = [(-line + root) / (2 * square), (-line - root) / (2 * square)]
        between = [x for x in roots if a.centre <= x <= b.centre]
        return min(between, default=a.centre)


#: Width of the bins that a sample is counted in: a cosine has 20,001 of them at most, whatever the sample.
BIN = 1e-4


def fit_mixture(rows: DataFrame, value: str, starts: tuple[float, ...] = (0.5, 0.75, 0.9, 0.97), iterations: int = 500) -> Mixture:
    """Expectation-maximisation on counts by bin, with each bin's mean and its mean square, from several starting cuts; the likeliest fit wins.

    ``value`` lies in [-1, 1]; only its bins reach the driver.
    """
    x_ = F.col(value)
    bins = rows.filter(x_.isNotNull()).groupBy(F.floor(x_ / BIN).alias("b")).agg(F.count("*").alias("n"), F.avg(x_).alias("x")).orderBy("b").collect()
    if sum(r.n for r in bins) < 3:
        raise ValueError("a mixture needs three values or more")
    n, x = np.array([r.n for r in bins], float), np.array([r.x for r in bins])
    size, least = n.sum(), 1e-6
    mean = float(n @ x / size)
    var = max(float(n @ (x - mean) ** 2 / size), least)
    one = size * (math.log(2 * math.pi * var) + 1) + 2 * math.log(size)
    best = None
    for start in starts:
        high = (np.cumsum(n) > start * size).astype(float)
        last = -math.inf
        for _ in range(iterations):
            weight = np.maximum(np.array([n @ (1 - high), n @ high]), 1e-9)
            centre = np.array([n @ ((1 - high) * x), n @ (high * x)]) / weight
            spread = np.maximum(np.array([n @ ((1 - high) * (x - centre[0]) ** 2), n @ (high * (x - centre[1]) ** 2)]) / weight, least)
            log = np.log(weight / size)[:, None] - 0.5 * np.log(2 * math.pi * spread)[:, None] - (x - centre[:, None]) ** 2 / (2 * spread[:, None])
            total = np.logaddexp(*log)
            high, like = np.exp(log[1] - total), float(n @ total)
            if like - last < 1e-6 * abs(like):
                break
            last = like
        if best is None or like > best[0]:
            best = (like, weight / size, centre, np.sqrt(spread))
    like, share, centre, spread = best
    low, high = sorted((Normal(float(w), float(c), float(s)) for w, c, s in zip(share, centre, spread)), key=lambda m: m.centre)
    return Mixture((float(one), float(-2 * like + 5 * math.log(size))), low, high)


def standardised(rows: DataFrame, column: str = "v") -> DataFrame:
    """``rows`` with ``features``: the vector of the array column, centred and scaled."""
    vectors = rows.withColumn("_raw", array_to_vector(column))
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(vectors).transform(vectors)
    return scaled.drop("_raw")


def silhouette(rows: DataFrame, block_rows: int = 2000) -> float | None:
    """Mean Euclidean silhouette over (id, cluster, v). Exact.

    Blocks of rows meet pairwise; a task holds two of them and gives, for each row, the summed distances to each cluster.
    """
    n = max(1, math.ceil(rows.count() / block_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = rows.select("id", "cluster", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    spread = spread.select("id", "cluster", "v", "own", "other", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    spread = spread.select("id", "cluster", "v", "side", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("j"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        side = np.array(group.column("side").to_pylist())
        ids, cluster, v = (np.array(group.column(c).to_pylist()) for c in ("id", "cluster", "v"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = {"id": [], "cluster": [], "c2": [], "d": [], "n": []}
        for c in np.unique(cluster[b]):
            to = b[cluster[b] == c]
            for i in a:
                here = to[ids[to] != ids[i]]
                if len(here):
                    for name, x in zip(out, (ids[i], cluster[i], c, float(np.sqrt(((v[here] - v[i]) ** 2).sum(1)).sum()), len(here))):
                        out[name].append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
        return pa.table({k: pa.array(x, t) for (k, x), t in zip(out.items(), kinds)})

    sums = spread.groupBy("i", "j").applyInArrow(run, "id long, cluster int, c2 int, d double, n long").groupBy("id", "cluster", "c2").agg((F.sum("d") / F.sum("n")).alias("d"))
    own = F.max(F.when(F.col("cluster") == F.col("c2"), F.col("d")))
    near = F.min(F.when(F.col("cluster") != F.col("c2"), F.col("d")))
    each = sums.groupBy("id").agg(own.alias("a"), near.alias("b")).select(F.when(F.col("a").isNull(), 0.0).otherwise(div(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("s"))
    return each.agg(F.avg("s")).first()[0]


def cluster_sites(rows: DataFrame, seed: int, expected_k: int = 3, ks: range = range(2, 7), restarts: int = 10) -> dict:
    """Clusters for each k (best of several starts), their silhouettes, and whether the expected number stands out."""
    data = materialised(standardised(rows))
    found = {}
    for k in ks:
        models = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(data) for i in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        labels = best.transform(data).select("id", "cluster", vector_to_array("features").alias("v"))
        found[k] = (silhouette(labels), labels.select("id", "cluster"))
    best = max(found, key=lambda k: (found[k][0] or -1, -k))
    return {"silhouette": {k: s for k, (s, _) in found.items()}, "best_k": best, "labels": found[best][1], "clean": best == expected_k and (found[best][0] or 0) >= 0.5}


def site_probe(rows: DataFrame, n_splits: int = 5, reg: float = 0.01) -> DataFrame:
    """Out-of-fold class probabilities of a linear probe for ``site``: (id, site, p array), folds of whole groups.

    The scaler is fitted on the training folds only.
    """
    folds = rows.withColumn("fold", F.pmod(F.xxhash64("group_no"), F.lit(n_splits)))
    vectors = folds.withColumn("_raw", array_to_vector("v"))
    vectors = materialised(vectors)
    out = None
    for k in range(n_splits):
        train, test = vectors.filter(F.col("fold") != k), vectors.filter(F.col("fold") == k)
        scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(train)
        model = LogisticRegression(labelCol="site", regParam=reg, maxIter=50, family="multinomial").fit(scaler.transform(train))
        part = model.transform(scaler.transform(test)).select("id", "site", vector_to_array("probability").alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def macro_auc(probabilities: DataFrame, n_classes: int) -> float | None:
    """Mean one-against-rest AUC; None if a class is missing."""
    values = []
    for c in range(n_classes):
        rows = probabilities.select(F.get("p", F.lit(c)).alias("score"), "site")
        values.append(auc(rows, "score", F.col("site") == c, []).first().auc)
    return None if any(v is None for v in values) else sum(values) / n_classes


def fit_head(rows: DataFrame, strengths: tuple[float, ...] = (0.1, 0.01, 0.001), n_splits: int = 3) -> tuple[object, float]:
    """Multinomial logistic regression on ``features`` (label ``y``, groups ``group_no``); its strength has the least grouped-CV log-loss."""
    folds = rows.withColumn("fold", F.pmod(F.xxhash64("group_no"), F.lit(n_splits)))
    folds = materialised(folds)
    make = lambda reg: LogisticRegression(labelCol="y", featuresCol="features", regParam=reg, maxIter=50, family="multinomial")
    losses = []
    for reg in strengths:
        total, n = 0.0, 0
        for k in range(n_splits):
            model = make(reg).fit(folds.filter(F.col("fold") != k))
            p = F.get(vector_to_array("probability"), F.col("y").cast("int"))
            one = model.transform(folds.filter(F.col("fold") == k)).agg(F.sum(-F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-12)))).alias("l"), F.count("*").alias("n")).first()
            total, n = total + (one.l or 0.0), n + one.n
        losses.append(total / max(n, 1))
    best = strengths[losses.index(min(losses))]
    return make(best).fit(folds), best
