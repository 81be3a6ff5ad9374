"""A whole study from records, tooth predictions and boxes: every table of the report, and a ledger of what has no value.

Tables are named ``<set>_<table>``, the sets being ``internal`` (the test part) and ``external``. Rows that several tables need are
written once to the shared folder; the driver sees tables of a few rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.numeric import age_band, div, grade_at
from auditframe.operators import agreement as ag
from auditframe.operators import detection as de
from auditframe.operators import metrics as me
from auditframe.operators import ratings as ra
from auditframe.operators import records as rc
from auditframe.operators import splits as sp
from auditframe.operators.bootstrap import Resampled, difference, estimate
from auditframe.operators.storage import materialised
from auditframe.plans import study as st
from auditframe.sources.generators import Inputs

K, WEIGHTS = 3, "linear"


class Ledger:
    """Reasons, by scope and metric, why a number is missing."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str]] = []

    def note(self, scope: str, metric: str, reason: str) -> None:
        self.rows.append((scope, metric, reason))

    def attempt(self, out: dict[str, DataFrame], scope: str, name: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        """``make()`` as the table ``<scope>_<name>``; what it refuses to compute goes into the ledger, any other error is one."""
        try:
            out[f"{scope}_{name}"] = made = make()
            return made
        except ValueError as e:
            self.note(scope, name, str(e))
            return None


def selected(inputs: Inputs, images: DataFrame) -> Inputs:
    """The part of a data set on some images."""
    return Inputs(*(ra.restrict(rows, images) for rows in (inputs.records, inputs.predictions, inputs.detections)))


def teeth(inputs: Inputs, scope: str, ledger: Ledger) -> DataFrame:
    """Units (uid, image_id, group_key, level, p_lesion, y, p, called, age, sex) of the images with an inventory; the others are noted."""
    kept, note = ra.inventoried(inputs.records)
    if note["excluded"]:
        ledger.note(scope, "tooth-level metrics", f"{note['excluded']} images without a tooth inventory; the other {note['kept']} are used, detection uses all")
    p = ra.p_lesion(F.col("probs"))
    rows = ra.tooth_table(kept, ra.restrict(inputs.predictions, kept))
    return materialised(rows.select("uid", "image_id", "group_key", F.col("reference").alias("level"), p.alias("p_lesion"), (F.col("reference") > 0).cast("int").alias("y"), p.alias("p"), grade_at(F.col("probs"), 0.0).alias("called"), "age", "sex"))


def boxes_of(records: DataFrame, reader: str) -> DataFrame:
    """(image_id, group_key, lesion_id, level, box): the lesions that a reader drew."""
    rows = records.select("image_id", rc.group_key().alias("group_key"), F.posexplode("annotations").alias("i", "a")).filter(F.col("a.annotator_id") == reader)
    level = ra.by_depth(F.col("a"))
    return rows.select("image_id", "group_key", F.concat_ws("#", "image_id", F.col("i").cast("string")).alias("lesion_id"), level.alias("level"), F.col("a.bbox").alias("box")).filter("level > 0 AND box IS NOT NULL")


def detected(inputs: Inputs, reader: str, threshold: float, cfg: st.Study, seed: int) -> DataFrame:
    """(statistic, value, lo, hi, n_valid): sensitivity by level, false boxes per image and average precision by level, against one reader.

    For the average precision of a level, boxes on lesions of another level are neither right nor wrong. A level that the
    reader never drew has no row.
    """
    read = inputs.records.filter(F.array_contains("readers", reader))
    images = read.select("image_id", rc.group_key().alias("group_key"))
    lesions = materialised(boxes_of(read, reader))
    boxes = ra.restrict(inputs.detections, read).drop("group_key").join(images, "image_id")
    matched = materialised(de.greedy_match(lesions, boxes, cfg.iou))
    hits = matched.filter((F.col("score") >= threshold) & F.col("lesion_id").isNotNull()).select("image_id", "lesion_id", F.lit(1).alias("hit"))
    rows = lesions.join(hits, ["image_id", "lesion_id"], "left").select("group_key", "level", "hit", F.lit(0).alias("images"), F.lit(0).cast("long").alias("fp"))
    false = de.false_positives(images, matched, threshold).select("group_key", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("hit"), F.lit(1).alias("images"), "fp")
    flag = lambda test: F.coalesce(test.cast("long"), F.lit(0))
    sums = {"images": F.col("images"), "fp": F.col("fp")}
    for k in (1, 2):
        sums |= {f"n{k}": flag(F.col("level") == k), f"t{k}": flag((F.col("level") == k) & F.col("hit").isNotNull())}
    finals = {f"sensitivity_{k}": div(F.col(f"t{k}"), F.col(f"n{k}")) for k in (1, 2)} | {"fp_per_image": div(F.col("fp"), F.col("images"))}
    out = Resampled(rows.unionByName(false), sums, finals, [], seed, cfg.n_boot).estimates()
    for k in (r[0] for r in lesions.select("level").distinct().orderBy("level").collect()):
        aimed = de.greedy_match(lesions, boxes, cfg.iou, k).join(lesions.select("image_id", "lesion_id", "level"), ["image_id", "lesion_id"], "left")
        scored = aimed.filter(F.col("level").isNull() | (F.col("level") == k)).select("group_key", "score", F.col("lesion_id").isNotNull().alias("tp"))
        ap = de.resampled_average_precision(scored, lesions.filter(F.col("level") == k).select("group_key"), [], seed, cfg.n_boot)
        out = out.unionByName(estimate(*(x.withColumn("statistic", F.lit(f"average_precision_{k}")) for x in ap), []))
    return out.withColumn("reader", F.lit(reader))


def evaluate_set(inputs: Inputs, units: DataFrame, point: dict, cfg: st.Study, scope: str, seed: int, ledger: Ledger) -> tuple[dict[str, DataFrame], Resampled]:
    """All tables of one data set, and the resampled rates by level for differences between sets."""
    out: dict[str, DataFrame] = {f"{scope}_cohort": rc.summary(inputs.records)}
    sums, finals = st.level_statistics(point["threshold"])
    rates = Resampled(units, sums, finals, [], seed, cfg.n_boot)
    ledger.attempt(out, scope, "stratified", rates.estimates)
    levels = {r[0] for r in units.select("level").distinct().collect()}
    for k in sorted({1, 2} - levels):
        ledger.note(scope, f"level {k}", "no lesion of this level in the reference")
    out[f"{scope}_auc"] = me.auc_by_level(units, sorted({1, 2} & levels) or [1])
    binned = me.quantile_bins(units, 10)
    out[f"{scope}_reliability"] = me.reliability(binned)
    ledger.attempt(out, scope, "calibration", lambda: st.ece_interval(units, seed, cfg.n_boot).crossJoin(me.brier(units, []).select("brier")).crossJoin(st.noise_floor(units, min(cfg.n_boot, 1000), seed=seed)))
    fit = me.recalibration(units)
    if fit is None:
        ledger.note(scope, "recalibration", "one class, or separable")
    else:
        out[f"{scope}_recalibration"] = units.sparkSession.createDataFrame([fit], "slope double, intercept double")
    ledger.attempt(out, scope, "selective", lambda: Resampled(units, me.selective_sums(point), me.selective_rates(), [], seed, cfg.n_boot).estimates())
    for attribute, value in (("age", age_band(F.col("age"))), ("sex", F.col("sex"))):
        cells = units.withColumn("subgroup", value).filter("subgroup IS NOT NULL")
        if not cells.limit(1).count():
            ledger.note(scope, f"subgroups by {attribute}", f"no {attribute} on any unit")
            continue
        wanted = {k: finals[k] for k in ("sensitivity_pooled", "specificity")}
        ledger.attempt(out, scope, f"subgroups_{attribute}", lambda c=cells, w=wanted: Resampled(c, sums, w, ["subgroup"], seed, cfg.n_boot).estimates())
    threshold = point["threshold"] if cfg.box_score is None else cfg.box_score
    for reader in ra.all_readers(inputs.records):
        ledger.attempt(out, scope, f"detection_{reader}", lambda r=reader: detected(inputs, r, threshold, cfg, seed))
    return out, rates


def agreement(inputs: Inputs, units: DataFrame, operating: float, cfg: st.Study, scope: str, ledger: Ledger) -> dict[str, DataFrame]:
    """Readers among themselves and beside the model. With one reader there is no agreement and no ceiling: one reason, no tables."""
    out: dict[str, DataFrame] = {}
    kept, _ = ra.inventoried(inputs.records)
    ratings = materialised(ra.tooth_ratings(kept))
    readers = ra.all_readers(kept)
    if len(readers) < 2:
        ledger.note(scope, "agreement", f"one reader only ({', '.join(readers)}): neither agreement nor a human ceiling")
        return out
    ledger.attempt(out, scope, "krippendorff", lambda: ag.alpha_intervals(ratings, K, ["ordinal"], cfg.seed, cfg.n_boot))
    ledger.attempt(out, scope, "fleiss", lambda: Resampled(*ag.fleiss_sums(ratings, K), [], cfg.seed, cfg.n_boot).estimates())
    pairs = ag.pairs(ratings).withColumn("pair", F.concat_ws("-", "rater_a", "rater_b"))
    ledger.attempt(out, scope, "pairwise", lambda: Resampled(pairs, ag.cell_sums(K), {"kappa": ag.kappa_of_cells(K, WEIGHTS)}, ["pair"], cfg.seed, cfg.n_boot).estimates())

    score = F.struct(F.floor(F.col("p_lesion") * 100).cast("int").alias("p"), "called")
    scored = ratings.join(units.select("uid", score.alias("s")), "uid")
    grade = lambda t: F.when(F.col("s")["p"] >= t, F.col("s")["called"]).otherwise(0)
    thresholds = units.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("t"))
    at = max(1, min(99, int(operating * 100)))

    def sweep() -> DataFrame:
        ag.enough_readers(ratings, 2)
        return materialised(ag.sweep_curve(scored, thresholds, grade, K, WEIGHTS))

    curve = ledger.attempt(out, scope, "sweep", sweep)
    if curve is None:
        return out
    ledger.attempt(out, scope, "sweep_summary", lambda: ag.sweep_summary(scored, curve, at, grade, K, WEIGHTS, cfg.seed, cfg.n_boot))
    # The model is compared where it agrees best: what does not exceed the ceiling there does so nowhere.
    best = curve.agg(F.max_by("t", F.struct("kappa", -F.col("t")))).first()[0]
    if best is None:
        ledger.note(scope, "ceiling", "no threshold with a kappa")
        return out
    model = units.select("uid", F.when(F.floor(F.col("p_lesion") * 100) >= best, F.col("called")).otherwise(0).alias("m"))
    ledger.attempt(out, scope, "ceiling", lambda: ag.model_vs_readers(ra.aligned(ratings, model), K, WEIGHTS, cfg.seed, cfg.n_boot))
    return out


def headline(inner: Resampled, outer: Resampled | None, cfg: st.Study, ledger: Ledger, out: dict[str, DataFrame]) -> None:
    """Three claims, named beforehand, at a level corrected for their number."""
    level = 1 - cfg.alpha / st.CLAIMS
    gap = lambda pair: tuple(x.filter("statistic = 'depth_gap'") for x in pair)
    ledger.attempt(out, "headline", "gap", lambda: estimate(*gap((inner.values(), inner.samples())), [], level))
    if outer is None:
        ledger.note("headline", "external drop", "no external data set")
        return
    drops = lambda pair: tuple(x.filter("statistic IN ('sensitivity_1', 'sensitivity_2')") for x in pair)
    ledger.attempt(out, "headline", "drop", lambda: estimate(*drops(difference(inner, outer, paired=False)), [], level))


def evaluate_inputs(internal: Inputs, external: Inputs | None, cfg: st.Study) -> dict[str, DataFrame]:
    """All tables of a study. The threshold is fitted on the validation part alone; without a lesion there nothing can be evaluated."""
    ledger, out = Ledger(), {}
    spark = internal.records.sparkSession
    images = internal.records.select("image_id", rc.group_key().alias("group_key"))
    split = materialised(st.make_split(images, cfg).select("image_id", "group_key", "partition"))
    naive = sp.naive_image_split(images, cfg.seed, dict(cfg.fractions))
    out["split"] = split.groupBy("partition").agg(F.count("*").alias("images"), F.count_distinct("group_key").alias("groups"))
    out["leakage"], out["naive_leakage"], out["seen"] = sp.leakage(split), sp.leakage(naive), sp.seen_rate(split)
    if cfg.split == "image_naive":
        ledger.note("internal", "split", "by image: groups leak on purpose, and every internal number is inflated")
    parts = {name: selected(internal, split.filter(F.col("partition") == name)) for name in ("val", "test")}
    fitting = teeth(parts["val"], "validation", ledger)
    point = me.operating_point(fitting, cfg.constraint, cfg.target, cfg.coverage).first()
    if point is None or point["threshold"] is None:
        ledger.note("internal", "operating point", "no case of the constrained class in the validation part")
        return out | {"ledger": spark.createDataFrame(ledger.rows, "scope string, metric string, reason string")}
    point = point.asDict()
    out["operating_point"] = spark.createDataFrame([(cfg.constraint, cfg.target, point["threshold"], point["margin"])], "constraint string, target double, threshold double, margin double")
    units = teeth(parts["test"], "internal", ledger)
    sp.disjoint_groups(fitting, units, allow_overlap=cfg.split == "image_naive")
    tables, inner = evaluate_set(parts["test"], units, point, cfg, "internal", cfg.seed, ledger)
    out |= tables | agreement(parts["test"], units, point["threshold"], cfg, "internal", ledger)
    outer = None
    if external is None:
        ledger.note("external", "all", "no external data set: every number is internal")
    else:
        away = teeth(external, "external", ledger)
        # Another seed: the two sets are independent samples.
        tables, outer = evaluate_set(external, away, point, cfg, "external", cfg.seed + 1, ledger)
        out |= tables
    headline(inner, outer, cfg, ledger, out)
    return out | {"ledger": spark.createDataFrame(ledger.rows, "scope string, metric string, reason string")}
