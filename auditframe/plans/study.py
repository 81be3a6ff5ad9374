"""A study: from a configuration and two data sets to a report.

The plan is a list of independent DataFrames over shared fixtures; the driver collects only
their few result rows. What cannot be computed is a row of the ledger with its reason, never
a missing row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions import draws
from auditframe.functions.numeric import age_band, div
from auditframe.operators import metrics as me
from auditframe.operators import splits as sp
from auditframe.operators.mapping import read_config
from auditframe.operators.bootstrap import Resampled, difference, estimate

#: A value above this is suspicious; cells below this size are listed apart.
WIRE, SMALL = 0.95, 20
CLAIMS = 3


@dataclass(frozen=True)
class Study:
    """Seeds, threshold policy and split of a study."""

    seed: int = 20261009
    n_boot: int = 2000
    split: str = "patient"
    fractions: Mapping[str, float] = field(default_factory=lambda: dict(sp.FRACTIONS))
    constraint: str = "sensitivity"
    target: float = 0.8
    coverage: float = 0.85
    alpha: float = 0.05
    iou: float = 0.5
    box_score: float | None = None

    def __post_init__(self) -> None:
        sp.check_fractions(dict(self.fractions))
        if self.split not in ("patient", "image_naive"):
            raise ValueError(f"unknown split {self.split!r}")
        if self.n_boot < 2 or not 0 < self.alpha < 1:
            raise ValueError("n_boot must be two or more, alpha between 0 and 1")

    @classmethod
    def from_mapping(cls, data: Mapping) -> Study:
        unknown = set(data) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**data)

    @classmethod
    def from_file(cls, path: str) -> Study:
        """Settings from a YAML or JSON file; ``box_score: operating_point`` stands for the fitted threshold."""
        data = dict(read_config(path))
        if data.get("box_score") == "operating_point":
            data["box_score"] = None
        return cls.from_mapping(data)

    @classmethod
    def from_json(cls, text: str) -> Study:
        return cls.from_mapping(json.loads(text))


def level_statistics(threshold: float) -> tuple[dict, dict]:
    """Sums and final expressions of the rates by level; pooled numbers stand only beside the strata."""
    flag, level, c = F.col("p_lesion") >= threshold, F.col("level"), F.col
    sums = {"n1": level == 1, "t1": (level == 1) & flag, "n2": level == 2, "t2": (level == 2) & flag, "n0": level == 0, "t0": (level == 0) & ~flag}
    finals = {
        "sensitivity_1": div(c("t1"), c("n1")), "sensitivity_2": div(c("t2"), c("n2")), "specificity": div(c("t0"), c("n0")),
        "sensitivity_pooled": div(c("t1") + c("t2"), c("n1") + c("n2")), "depth_gap": div(c("t2"), c("n2")) - div(c("t1"), c("n1")),
    }
    return {k: v.cast("long") for k, v in sums.items()}, finals


def make_split(images: DataFrame, cfg: Study) -> DataFrame:
    """The split that the settings ask for, checked; only a naive one may leak."""
    make = sp.group_split if cfg.split == "patient" else sp.naive_image_split
    return sp.checked(make(images, cfg.seed, dict(cfg.fractions)), allow_leakage=cfg.split == "image_naive")


def evaluate(units: DataFrame, external: DataFrame | None, cfg: Study) -> dict[str, DataFrame]:
    """Result tables of a study over units (uid, image_id, group_key, level, p_lesion, age, sex)."""
    spark = units.sparkSession
    images = units.groupBy("image_id").agg(F.min("group_key").alias("group_key"))
    one_group = units.groupBy("image_id").agg(F.count_distinct("group_key").alias("n")).filter("n > 1").limit(1).count() == 0
    key = "group_key" if one_group else "image_id"
    images = images.withColumn("group_key", F.col(key))
    split = make_split(images, cfg)
    rows = units.join(split.select("image_id", "partition"), "image_id")
    ledger: list[tuple[str, str, str]] = []
    out: dict[str, DataFrame] = {"split": split.groupBy("partition").agg(F.count("*").alias("images"), F.count_distinct("group_key").alias("groups")), "leakage": sp.leakage(split)}
    decisions = rows.select("uid", "group_key", "partition", "level", "p_lesion", (F.col("level") > 0).cast("int").alias("y"), F.col("p_lesion").alias("p"))
    point = me.operating_point(decisions.filter("partition = 'val'"), cfg.constraint, cfg.target, cfg.coverage).first()
    if point is None:
        ledger.append(("internal", "operating point", "no case of the constrained class in the validation part"))
        return out | {"ledger": spark.createDataFrame(ledger, "scope string, metric string, reason string")}
    point = point.asDict()
    test = rows.filter("partition = 'test'")
    sums, finals = level_statistics(point["threshold"])
    internal = Resampled(test, sums, finals, [], cfg.seed, cfg.n_boot)
    out["stratified"] = internal.estimates()
    out["headline"] = Resampled(test, sums, {"depth_gap": finals["depth_gap"]}, [], cfg.seed, cfg.n_boot).estimates(1 - cfg.alpha / CLAIMS)
    out["selective"] = Resampled(decisions.filter("partition = 'test'"), me.selective_sums(point), me.selective_rates(), [], cfg.seed, cfg.n_boot).estimates()
    out["auc"] = me.auc_by_level(test, [1, 2])
    binned = me.quantile_bins(decisions.filter("partition = 'test'"), 10)
    out["calibration"] = me.ece(binned)
    out["reliability"] = me.reliability(binned)
    fit = me.recalibration(decisions.filter("partition = 'test'"))
    if fit is None:
        ledger.append(("internal", "recalibration", "one class, or separable"))
    if "age" in units.columns and units.filter("age IS NOT NULL").limit(1).count():
        cells = test.withColumn("subgroup", age_band(F.col("age"))).filter("subgroup IS NOT NULL")
        out["subgroups"] = Resampled(cells, sums, {k: finals[k] for k in ("sensitivity_pooled", "specificity")}, ["subgroup"], cfg.seed, cfg.n_boot).estimates()
    else:
        ledger.append(("internal", "subgroups by age", "no age on any unit"))
    if external is not None:
        other = Resampled(external, sums, finals, [], cfg.seed + 1, cfg.n_boot)
        out["external_gap"] = estimate(*difference(internal, other, paired=False), [])
    else:
        ledger.append(("external", "gap", "no external data set was given"))
    out["ledger"] = spark.createDataFrame(ledger, "scope string, metric string, reason string")
    return out


def tripwire(estimates: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Values above the wire: real flags, or small cells; an unknown size counts as real."""
    rows = estimates.filter(F.col("value") > WIRE)
    if sizes is not None:
        rows = rows.join(sizes, "statistic", "left")
    else:
        rows = rows.withColumn("n", F.lit(None).cast("long"))
    return rows.withColumn("kind", F.when(F.col("n") < SMALL, "small cell").otherwise("flag"))


def noise_floor(rows: DataFrame, n_sim: int = 1000, n_bins: int = 10, seed: int = 1) -> DataFrame:
    """95th percentile of the calibration error of outcomes drawn from the probabilities themselves; bins stay fixed."""
    if "uid" not in rows.columns:
        raise ValueError("units need a uid: their draws hang on it")
    binned = me.quantile_bins(rows, n_bins).select("bin", F.col("p").cast("double").alias("p"), F.concat_ws(":", F.lit(""), F.col("uid").cast("string")).alias("tail"))
    # Sums of p do not depend on the draws, so a task hands on counts of positive outcomes only.
    spread = binned.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    drawn = spread.mapInArrow(_outcomes(n_sim, seed), "b int, bin int, y long").groupBy("b", "bin").agg(F.sum("y").alias("y"))
    sums = binned.groupBy("bin").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    gaps = drawn.join(F.broadcast(sums), "bin").select("b", F.abs(F.col("p") - F.col("y")).alias("gap"), "n")
    each = gaps.groupBy("b").agg(div(F.sum("gap"), F.sum("n")).alias("ece"))
    return each.agg(F.percentile("ece", F.lit(0.95)).alias("floor"))


def _outcomes(n_sim: int, seed: int):
    """(b, bin, y): how many of a task's rows (bin, p, tail) get a positive outcome in simulation b: those whose draw from ``nf:seed:b`` + ``tail`` is below p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            kept = batch.filter(pc.is_valid(batch.column("bin")))
            bins, p = kept.column("bin").to_numpy(), kept.column("p").fill_null(0.0).to_numpy()
            # draw / 1e6 < p as numbers of 64 bits, for whole draws: draw < least.
            least = np.clip(np.ceil(np.nan_to_num(p) * 1e6), 0, 1e6)
            least = np.where((least - 1) / 1e6 >= p, least - 1, least)
            least = np.clip(np.where(least / 1e6 < p, least + 1, least), 0, 1e6).astype(np.uint32)
            tails = [t.encode() for t in kept.column("tail").to_pylist()]
            for place in np.unique(bins).tolist():
                at = np.flatnonzero(bins == place)
                counts = found.setdefault(place, np.zeros(n_sim, np.int64))
                for some, rows in draws.of_one_length([tails[i] for i in at]):
                    limits = least[at[some]]
                    for first, heads in draws.numbered(n_sim, f"nf:{seed}:{{}}"):
                        for (k, lo), digest in draws.digests(heads, rows):
                            hits = digest % np.uint32(1_000_000) < limits[lo : lo + digest.shape[1]]
                            counts[first + k : first + k + len(hits)] += hits.sum(axis=1)
        for place, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_sim), pa.int32()), pa.array(np.full(n_sim, place), pa.int32()), pa.array(counts)], ["b", "bin", "y"])

    return run


def ece_interval(rows: DataFrame, seed: int, n_boot: int = 2000, n_bins: int = 10) -> DataFrame:
    """(statistic, value, lo, hi, n_valid) of the quantile-bin calibration error, its edges taken anew from each resample.

    A resample is weights on distinct values: its percentile edges (linear between the values at the two ranks) are exact
    percentiles with these weights, equal edges collapse, and an edge belongs to the upper bin, as in ``quantile_bins``.
    """
    from auditframe.operators import bootstrap as bs

    index = bs.group_index(rows)
    w = bs.weights(index, index.count(), seed, n_boot).unionByName(index.select(F.lit(-1).alias("b"), "g", F.lit(1).cast("long").alias("w")))
    counts = rows.groupBy("group_key", "p").agg(F.count("*").alias("n"), F.sum("y").alias("y")).join(index, "group_key").join(w, "g")
    by_value = counts.groupBy("b", "p").agg(F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.col("y") * F.col("w")).alias("y"))
    cuts = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    edges = by_value.groupBy("b").agg(F.array_distinct(F.percentile("p", cuts, F.col("n"))).alias("edges"))
    place = by_value.join(edges, "b").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("p"))))
    gaps = place.groupBy("b", "bin").agg(F.abs(F.sum(F.col("p") * F.col("n")) - F.sum("y")).alias("gap"), F.sum("n").alias("n"))
    each = gaps.groupBy("b").agg(div(F.sum("gap"), F.sum("n")).alias("v")).withColumn("statistic", F.lit("ece"))
    return bs.estimate(each.filter("b < 0").drop("b"), each.filter("b >= 0"), [])
