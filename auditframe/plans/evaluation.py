"""Evaluation queries over the fixtures: splits, agreement, resampling, discrimination, calibration, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.numeric import age_band, div, grade_at, rounded, uniform
from auditframe.operators import agreement as ag
from auditframe.operators import diagnostics as dg
from auditframe.operators import metrics as me
from auditframe.operators import ratings as ra
from auditframe.operators import records as rc
from auditframe.operators import splits as sp
from auditframe.operators.bootstrap import Resampled, difference, estimate
from auditframe.operators.storage import materialised, written
from auditframe.plans import study as st
from auditframe.sources import fixtures as fx

SEED, N_BOOT, THRESHOLD, K = 20261009, 2000, 0.3, 3
DF = DataFrame


def _images(spark: SparkSession, d: str) -> DF:
    """Images with their group (customer) and site."""
    orders, customer = fx.table(spark, d, "orders"), fx.table(spark, d, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return rows.select(F.col("o_orderkey").cast("string").alias("image_id"), F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("group_key"), F.col("c_mktsegment").alias("site"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))


def _r(df: DF, *cols: str) -> DF:
    return df.select(*[rounded(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _sizes(rows: DF) -> DF:
    return rows.groupBy("partition").agg(F.count("*").alias("images"), F.count_distinct("group_key").alias("groups"))


# --- Splits -----------------------------------------------------------------


def split_patient_sizes(spark, d):
    return _sizes(sp.group_split(_images(spark, d), SEED))


def split_naive_sizes(spark, d):
    return _sizes(sp.naive_image_split(_images(spark, d), SEED))


def split_stratified(spark, d):
    rows = sp.group_split(_images(spark, d), SEED, stratum=F.max("urgent"))
    return rows.groupBy("partition", "urgent").agg(F.count("*").alias("images"))


def split_kfold(spark, d):
    return sp.group_kfold(_images(spark, d), SEED).groupBy("fold").agg(F.count("*").alias("images"), F.count_distinct("group_key").alias("groups"))


def leakage_measured(spark, d):
    return _r(sp.leakage(sp.naive_image_split(_images(spark, d), SEED)), "leaked_share")


def leakage_patient_clean(spark, d):
    return _r(sp.leakage(sp.checked(sp.group_split(_images(spark, d), SEED))), "leaked_share")


def site_holdout_sizes(spark, d):
    rows = sp.leave_one_site_out(_images(spark, d))
    return rows.groupBy("holdout", "partition").agg(F.count("*").alias("images"), F.count_distinct("group_key").alias("groups"))


def test_seen_patient_rate(spark, d):
    return sp.seen_rate(sp.naive_image_split(_images(spark, d), SEED))


def eligible_training(spark, d):
    index = fx.content_index(spark, d).select("file", "sha", F.col("subset").alias("group_key"))
    held = index.filter("group_key IN ('src0', 'src1')")
    return sp.eligible_training(index, held).groupBy("group_key").agg(F.count("*").alias("n"))


def swap_sets(spark, d):
    index = fx.content_index(spark, d).select("file", "subset")
    held = index.filter("subset = 'src0'")
    return sp.matched_swap(held, index, SEED, "file", 50).select("file", "subset")


# --- Ratings and agreement ----------------------------------------------------


def _readings(spark, d):
    return fx.readings(fx.units(spark, d))


def ratings_long(spark, d):
    return _readings(spark, d).groupBy("rater", "grade").agg(F.count("*").alias("n"))


def image_ratings(spark, d):
    return ag.image_ratings(_readings(spark, d)).groupBy("rater", "grade").agg(F.count("*").alias("n"))


def consensus(spark, d):
    return ag.consensus(_readings(spark, d)).groupBy("n_raters", "grade").agg(F.count("*").alias("n"))


def contingency(spark, d):
    return ag.contingency(ag.pairs(_readings(spark, d)), K, ["rater_a", "rater_b"])


def _kappa(weights):
    def query(spark, d):
        pairs = ag.pairs(_readings(spark, d))
        cells = pairs.groupBy("rater_a", "rater_b").agg(*[F.sum(c).alias(n) for n, c in ag.cell_sums(K).items()], F.count("*").alias("n"))
        return cells.select("rater_a", "rater_b", "n", rounded(ag.kappa_of_cells(K, weights)).alias("kappa"))

    return query


def kappa_two_raters(spark, d):
    labels = fx.table(spark, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    cells = labels.agg(*[F.sum(c).alias(n) for n, c in ag.cell_sums(2).items()], F.count("*").alias("n"))
    return cells.select("n", rounded(ag.kappa_of_cells(2, "none")).alias("kappa"))


def pairwise_kappa_ci(spark, d):
    pairs = ag.pairs(_readings(spark, d)).withColumn("pair", F.concat_ws("-", "rater_a", "rater_b"))
    return Resampled(pairs, ag.cell_sums(K), {"kappa": ag.kappa_of_cells(K, "linear")}, ["pair"], SEED, N_BOOT).estimates()


def fleiss(spark, d):
    """Of the units that all readers graded."""
    return _r(ag.fleiss(materialised(ag.complete(_readings(spark, d))), K), "kappa")


def fleiss_ci(spark, d):
    return Resampled(*ag.fleiss_sums(materialised(ag.complete(_readings(spark, d))), K), [], SEED, N_BOOT).estimates()


def _alpha(metric):
    return lambda spark, d: _r(ag.krippendorff(_readings(spark, d), metric, K), "alpha")


def _loo_cells(spark, d):
    rows = ag.leave_one_out(_readings(spark, d))
    model = fx.units(spark, d).select("uid", (F.col("p_lesion") >= THRESHOLD).cast("int").alias("m"))
    rows = rows.join(model, "uid")
    both = F.explode(F.array(F.struct(F.lit("ceiling").alias("who"), F.col("loo").alias("a")), F.struct(F.lit("model").alias("who"), F.col("m").alias("a"))))
    return rows.select("uid", "group_key", "rater", F.col("grade").alias("b"), both.alias("x")).select("uid", "group_key", "rater", "b", "x.who", "x.a")


def loo_ceiling(spark, d):
    rows = _loo_cells(spark, d)
    return Resampled(rows, ag.cell_sums(K), {"kappa": ag.kappa_of_cells(K, "linear")}, ["rater", "who"], SEED, N_BOOT).estimates()


def ceiling_difference(spark, d):
    """Model minus ceiling per reader, paired over the same resamples."""
    rows = _loo_cells(spark, d)
    cells, final = ag.cell_sums(K), {"kappa": ag.kappa_of_cells(K, "linear")}
    one = {w: Resampled(rows.filter(F.col("who") == w), cells, final, ["rater"], SEED, N_BOOT) for w in ("model", "ceiling")}
    return estimate(*difference(one["model"], one["ceiling"], paired=True), ["rater"])


def _scored(spark, d):
    """Readings with the model's score in whole percents, and its grade at the operating threshold."""
    score = F.floor(F.col("p_lesion") * 100.0).cast("int")
    return ra.aligned(_readings(spark, d), fx.units(spark, d).select("uid", score.alias("m"))).withColumnRenamed("m", "s")


def _grade_at(t):
    return (F.col("s") >= t).cast("int")


def _curve(spark, scored):
    return ag.sweep_curve(scored, spark.range(1, 100).select(F.col("id").cast("int").alias("t")), _grade_at, K, "linear")


def kappa_sweep(spark, d):
    """Mean kappa of the model with the readers at 99 thresholds, in percent."""
    return _r(_curve(spark, _scored(spark, d)), "kappa")


def kappa_sweep_summary(spark, d):
    scored = _scored(spark, d)
    return ag.sweep_summary(scored, _curve(spark, scored), int(THRESHOLD * 100), _grade_at, K, "linear", SEED, N_BOOT)


def model_vs_readers(spark, d):
    model = fx.units(spark, d).select("uid", (F.col("p_lesion") >= THRESHOLD).cast("int").alias("m"))
    return ag.model_vs_readers(ra.aligned(_readings(spark, d), model), K, "linear", SEED, N_BOOT)


# --- Ratings and tables from records ------------------------------------------------


def _teeth(spark, d):
    """Records with an inventory, and predictions for the teeth of all images."""
    units = fx.with_teeth(fx.units(spark, d))
    readings = fx.readings(units).join(units.select("uid", "fdi"), "uid")
    return rc.from_readings(units, readings, teeth=True), fx.predictions(units)


def _read_teeth(spark, d, reader=None):
    """Records, those of one ``reader`` or all, and the predictions for their teeth, each computed once: checks and joins read them often."""
    records, predictions = _teeth(spark, d)
    records = written(records if reader is None else records.filter(F.array_contains("readers", reader)))
    return records, written(ra.restrict(predictions, records))


def tooth_ratings(spark, d):
    return ra.tooth_ratings(_teeth(spark, d)[0]).groupBy("rater", "grade").agg(F.count("*").alias("n"))


def image_ratings_from_records(spark, d):
    return ra.image_ratings(_teeth(spark, d)[0]).groupBy("rater", "grade").agg(F.count("*").alias("n"))


def tooth_table(spark, d):
    """Reference grades of all teeth with the model's mean probability of a lesion and its calls."""
    rows = ra.tooth_table(*_read_teeth(spark, d))
    called = grade_at(F.col("probs"), 0.3)
    return _r(rows.groupBy("reference").agg(F.count("*").alias("n"), F.count_distinct("group_key").alias("groups"), F.avg(ra.p_lesion(F.col("probs"))).alias("p"), F.sum((called > 0).cast("long")).alias("called")), "p")


def tooth_table_of_reader(spark, d):
    """As ``tooth_table`` by one reader, on the images that this reader read."""
    rows = ra.tooth_table(*_read_teeth(spark, d, "r1"), reader="r1")
    return rows.groupBy("reference").agg(F.count("*").alias("n"))


def region_crosstab(spark, d):
    """Findings by part of the mouth, with the share of each part in its finding."""
    return _r(rc.region_crosstab(_teeth(spark, d)[0]), "share")


def per_image(spark, d):
    """Findings and inventoried teeth of an image: median, largest number, images without."""
    return rc.per_image(_teeth(spark, d)[0])


# --- Resampled rates ------------------------------------------------------------


def _level_rates(spark, d, keys=()):
    """Sensitivity by level, specificity and pooled sensitivity as sums."""
    flag = F.col("p_lesion") >= THRESHOLD
    level = F.col("level")
    sums = {"n1": (level == 1), "t1": (level == 1) & flag, "n2": (level == 2), "t2": (level == 2) & flag, "n0": (level == 0), "t0": (level == 0) & ~flag}
    c = F.col
    finals = {
        "sensitivity_1": div(c("t1"), c("n1")), "sensitivity_2": div(c("t2"), c("n2")), "specificity": div(c("t0"), c("n0")),
        "sensitivity_pooled": div(c("t1") + c("t2"), c("n1") + c("n2")), "depth_gap": div(c("t2"), c("n2")) - div(c("t1"), c("n1")),
        "accuracy_minus_sound": div(c("t0") + c("t1") + c("t2") - c("n0"), c("n0") + c("n1") + c("n2")),
    }
    return {k: v.cast("long") for k, v in sums.items()}, finals


def stratified_report(spark, d):
    sums, finals = _level_rates(spark, d)
    return Resampled(fx.units(spark, d), sums, finals, [], SEED, N_BOOT).estimates()


def boot_bonferroni(spark, d):
    sums, finals = _level_rates(spark, d)
    return Resampled(fx.units(spark, d), sums, {"depth_gap": finals["depth_gap"]}, [], SEED, N_BOOT).estimates(1 - 0.05 / 3)


def boot_specificity_ci(spark, d):
    sums, finals = _level_rates(spark, d)
    return Resampled(fx.units(spark, d), sums, {k: finals[k] for k in ("sensitivity_1", "sensitivity_2", "specificity")}, [], SEED, N_BOOT).estimates()


def subgroup_age(spark, d):
    sums, finals = _level_rates(spark, d)
    rows = fx.units(spark, d).withColumn("subgroup", age_band(F.col("age"))).filter("subgroup IS NOT NULL")
    return Resampled(rows, sums, {k: finals[k] for k in ("sensitivity_pooled", "specificity")}, ["subgroup"], SEED, N_BOOT).estimates()


def subgroup_sex(spark, d):
    sums, finals = _level_rates(spark, d)
    rows = fx.units(spark, d).withColumn("subgroup", F.col("sex"))
    return Resampled(rows, sums, {k: finals[k] for k in ("sensitivity_pooled", "specificity")}, ["subgroup"], SEED, N_BOOT).estimates()


def subgroup_cells(spark, d):
    """Size of each age cell and why it is not computable, if it isn't."""
    rows = fx.units(spark, d).withColumn("value", age_band(F.col("age")))
    cells = rows.filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("group_key").alias("groups"), F.sum((F.col("level") > 0).cast("long")).alias("lesions"))
    reason = F.when(F.col("groups") < 2, "fewer than two patients").when(F.col("lesions") == 0, "no lesions in this subgroup")
    return cells.select("value", "n", "groups", "lesions", reason.alias("reason"))


def event_rate_ci(spark, d):
    rows = fx.event_groups(spark, d)
    flag = (F.col("p") >= 0.5).cast("long")
    sums = {"n": F.lit(1), "y": F.col("y").cast("long"), "f": flag}
    return Resampled(rows, sums, {"error_rate": div(F.col("y"), F.col("n")), "flag_rate": div(F.col("f"), F.col("n"))}, [], SEED, N_BOOT).estimates()


def boot_diff_unpaired(spark, d):
    """Specificity of two sites, each with its own seed."""
    sums, finals = _level_rates(spark, d)
    rows = fx.units(spark, d)
    one = [Resampled(rows.filter(F.col("site") == s), sums, {"specificity": finals["specificity"]}, [], SEED + i, N_BOOT) for i, s in enumerate(("BUILDING", "MACHINERY"))]
    return estimate(*difference(*one, paired=False), [])


def auc_by_level(spark, d):
    return _r(me.auc_by_level(fx.units(spark, d), [1, 2]), "auc")


def auc_interval(spark, d):
    """AUC by level and deep minus shallow, with intervals; scores in whole percents."""
    rows = fx.units(spark, d).withColumn("s", F.floor(F.col("p_lesion") * 100.0).cast("int"))
    return estimate(*me.resampled_auc(rows, "s", SEED, N_BOOT), [])


def _heads(spark, d):
    """Units with the depth that a head of three classes calls, and the probability by a head of two."""
    u = lambda name: uniform(F.concat(F.lit(f"{name}:"), "uid"))
    rows = fx.units(spark, d)
    return rows.withColumn("called_deep", u("dp") < 0.1 + 0.3 * F.col("level")).withColumn("p_binary", F.least(F.lit(0.999), F.col("p_lesion") + 0.1 * u("bh")))


def depth_rates(spark, d):
    """Detected, right in depth, and by a head of two classes, for shallow and deep lesions."""
    return dg.depth_rates(_heads(spark, d), THRESHOLD, THRESHOLD, SEED, N_BOOT)


def missed_margins(spark, d):
    return _r(dg.margins(_heads(spark, d), THRESHOLD), "just_below", "median_missed")


def krippendorff_ci(spark, d):
    return ag.alpha_intervals(_readings(spark, d), K, ["nominal", "ordinal", "interval"], SEED, N_BOOT)


# --- Calibration ------------------------------------------------------------------


def brier(spark, d):
    return _r(me.brier(fx.event_groups(spark, d), []), "brier")


def ece_uniform(spark, d):
    return _r(me.ece(me.uniform_bins(fx.event_groups(spark, d), 10)), "ece")


def ece_quantile(spark, d):
    return _r(me.ece(me.quantile_bins(fx.event_groups(spark, d), 10)), "ece")


def reliability_curve(spark, d):
    return _r(me.reliability(me.quantile_bins(fx.event_groups(spark, d), 10)), "mean_p", "rate")


def recalibration(spark, d):
    found = me.recalibration(fx.event_groups(spark, d))
    return _r(spark.createDataFrame([found or (None, None)], "slope double, intercept double"), "slope", "intercept")


def ece_interval(spark, d):
    """Calibration error with an interval, bin edges taken anew from each resample."""
    return st.ece_interval(fx.event_groups(spark, d), SEED, N_BOOT)


def noise_floor(spark, d):
    """The error that a perfectly calibrated model of these probabilities would show."""
    return _r(st.noise_floor(fx.event_groups(spark, d).withColumnRenamed("event_id", "uid")), "floor")


def split_kfold_stratified(spark, d):
    rows = sp.group_kfold(_images(spark, d), SEED, stratum=F.max("urgent"))
    return rows.groupBy("fold", "urgent").agg(F.count("*").alias("images"), F.count_distinct("group_key").alias("groups"))


# --- Selective prediction -------------------------------------------------------------


def _decisions(spark, d):
    return fx.units(spark, d).select("uid", "group_key", (F.col("level") > 0).cast("int").alias("y"), (F.floor(F.col("p_lesion") * 1000.0) / 1000.0).alias("p"))


def _confidence(spark, d):
    rows = _decisions(spark, d)
    return rows.select(F.greatest("p", 1 - F.col("p")).alias("confidence"), ((F.col("p") >= 0.5).cast("int") == F.col("y")).alias("correct"))


def risk_coverage(spark, d):
    curve = me.risk_coverage(_confidence(spark, d).withColumn("confidence", F.floor(F.col("confidence") * 100.0) / 100.0))
    return _r(curve, "confidence", "coverage", "risk")


def aurc(spark, d):
    return _r(me.aurc(me.risk_coverage(_confidence(spark, d).withColumn("confidence", F.floor(F.col("confidence") * 100.0) / 100.0))), "aurc")


def operating_point_sens(spark, d):
    return _r(me.operating_point(_decisions(spark, d), "sensitivity", 0.9, 0.85), "threshold", "fitted", "margin")


def operating_point_spec(spark, d):
    return _r(me.operating_point(_decisions(spark, d), "specificity", 0.8), "threshold", "fitted", "margin")


def selective_eval(spark, d):
    """Fit on even suppliers, evaluate on odd ones."""
    rows = _decisions(spark, d).withColumn("odd", F.substring_index("group_key", "/", -1).cast("long") % 2)
    fit = rows.filter("odd = 0")
    sp.disjoint_groups(fit, rows.filter("odd = 1"))
    point = me.operating_point(fit, "sensitivity", 0.9, 0.85).first().asDict()
    return Resampled(rows.filter("odd = 1"), me.selective_sums(point), me.selective_rates(), [], SEED, N_BOOT).estimates()


def tripwire(spark, d):
    """Rates above 0.95 by site and level, and whether the cell is too small to mean anything."""
    rows = fx.units(spark, d).filter("level > 0").groupBy("site", "level").agg(F.count("*").alias("n"), F.avg((F.col("p_lesion") >= THRESHOLD).cast("double")).alias("value"))
    return _r(rows.filter("value > 0.95").withColumn("kind", F.when(F.col("n") < 20, "small cell").otherwise("flag")), "value")


QUERIES = {f.__name__: f for f in (
    boot_specificity_ci, split_patient_sizes, split_naive_sizes, split_stratified, split_kfold, split_kfold_stratified, ece_interval, noise_floor, leakage_measured, leakage_patient_clean, site_holdout_sizes,
    test_seen_patient_rate, eligible_training, swap_sets, ratings_long, image_ratings, consensus, contingency, kappa_two_raters, pairwise_kappa_ci, fleiss, fleiss_ci,
    tooth_ratings, image_ratings_from_records, tooth_table, tooth_table_of_reader, region_crosstab, per_image, kappa_sweep_summary, model_vs_readers,
    loo_ceiling, ceiling_difference, kappa_sweep, stratified_report, boot_bonferroni, subgroup_age, subgroup_sex, subgroup_cells, event_rate_ci, boot_diff_unpaired,
    auc_by_level, auc_interval, depth_rates, missed_margins, krippendorff_ci, brier, ece_uniform, ece_quantile, reliability_curve, recalibration, risk_coverage, aurc, operating_point_sens, operating_point_spec, selective_eval, tripwire,
)}
QUERIES |= {f"cohen_kappa_{w}": _kappa(w) for w in ("none", "linear", "quadratic")}
QUERIES |= {f"krippendorff_{m}": _alpha(m) for m in ("nominal", "ordinal", "interval")}
