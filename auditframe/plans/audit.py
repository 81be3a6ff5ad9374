"""Audit and detection queries: boxes, copies, recovered groups, hypothesis tests, records, mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.numeric import div, fdi_label, label_fdi, mirror_fdi, rounded
from auditframe.operators import dedup as dd
from auditframe.operators import detection as de
from auditframe.operators import mapping as mp
from auditframe.operators import records as rc
from auditframe.operators import recovery as rv
from auditframe.operators import splits as sp
from auditframe.operators.bootstrap import Resampled, difference, estimate
from auditframe.operators.probes import fit_mixture, macro_auc, site_probe
from auditframe.operators.storage import materialised, written
from auditframe.sources import fixtures as fx

SEED, N_BOOT, IOU, SCORE = 20261009, 2000, 0.5, 0.3
DF = DataFrame


def _r(df: DF, *cols: str) -> DF:
    return df.select(*[rounded(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- Boxes ------------------------------------------------------------------------


def _boxes(spark, d):
    units = fx.units(spark, d)
    return units, fx.lesions(units), fx.detections(units)


def iou_pairs(spark, d):
    _, les, det = _boxes(spark, d)
    pairs = de.overlaps(les, det, IOU)
    return pairs.agg(F.count("*").alias("pairs"), rounded(F.avg(F.floor(F.col("iou") * 1e6).cast("long")) / 1e6).alias("mean_iou"))


def _matched(spark, d, target=None):
    units, les, det = _boxes(spark, d)
    return units, les, det, de.greedy_match(les, det, IOU, target)


def greedy_match(spark, d):
    *_, matched = _matched(spark, d)
    return matched.filter("lesion_id IS NOT NULL").select("image_id", "det_id", "lesion_id")


def detection_sens(spark, d):
    _, les, _, matched = _matched(spark, d)
    hits = matched.filter((F.col("score") >= SCORE) & F.col("lesion_id").isNotNull()).select("image_id", "lesion_id", F.lit(1).alias("hit"))
    rows = les.join(hits, ["image_id", "lesion_id"], "left")
    sums = {f"{k}{level}": ((F.col("level") == level) & (F.lit(True) if k == "n" else F.col("hit").isNotNull())).cast("long") for level in (1, 2) for k in "nt"}
    finals = {f"sensitivity_{level}": div(F.col(f"t{level}"), F.col(f"n{level}")) for level in (1, 2)}
    return Resampled(rows, sums, finals, [], SEED, N_BOOT).estimates()


def fp_per_image(spark, d):
    """An image belongs to the group of its first unit."""
    units, _, _, matched = _matched(spark, d)
    images = units.groupBy("image_id").agg(F.min("group_key").alias("group_key"))
    rows = de.false_positives(images, matched, SCORE)
    return Resampled(rows, {"fp": F.col("fp"), "n": F.lit(1)}, {"fp_per_image": div(F.col("fp"), F.col("n"))}, [], SEED, N_BOOT).estimates()


def froc(spark, d):
    units, les, _, matched = _matched(spark, d)
    n = units.agg(F.count_distinct("image_id")).first()[0]
    return _r(de.froc(les, matched, n, [0.05, 0.1, 0.2, 0.5]), "sensitivity")


def ap_pooled(spark, d):
    _, les, _, matched = _matched(spark, d)
    rows = matched.select("score", "det_id", F.col("lesion_id").isNotNull().alias("tp"))
    return _r(de.average_precision(rows, les.agg(F.count("*").alias("n_pos")), []), "ap")


def ap_interval(spark, d):
    """Pooled average precision with an interval over resampled groups; detections of one score enter together."""
    _, les, _, matched = _matched(spark, d)
    rows = matched.select("group_key", "score", F.col("lesion_id").isNotNull().alias("tp"))
    return estimate(*de.resampled_average_precision(rows, les.select("group_key"), [], SEED, N_BOOT), [])


def ap_by_level(spark, d):
    """Per level, with lesions of other levels ignored: a hit on one is neither right nor wrong."""
    out = None
    for level in (1, 2):
        _, les, _, matched = _matched(spark, d, level)
        hit = matched.join(les.select("image_id", "lesion_id", "level"), ["image_id", "lesion_id"], "left").filter(F.col("level").isNull() | (F.col("level") == level))
        rows = hit.select(F.lit(level).alias("level"), "score", "det_id", F.col("lesion_id").isNotNull().alias("tp"))
        part = de.average_precision(rows, les.filter(F.col("level") == level).agg(F.count("*").alias("n_pos")).withColumn("level", F.lit(level)), ["level"])
        out = part if out is None else out.unionByName(part)
    return _r(out, "ap")


def _teeth(rows: DF, id_col: str) -> DF:
    """Tooth numbers by place in the image."""
    fdi = (F.floor((F.col("box.y1") / 40.0)) % 4 + 1) * 10 + F.floor(F.col("box.x1") / 50.0) % 8 + 1
    return rows.select("image_id", fdi.cast("int").alias("fdi"), "box", F.col(id_col).alias("ordinal_id"))


def enumeration_pr(spark, d):
    _, les, det = _boxes(spark, d)
    found = de.enumeration(_teeth(les, "lesion_id"), _teeth(det, "det_id"), IOU)
    return _r(found.select("*", div(F.col("correct"), F.col("n_pred")).alias("precision"), div(F.col("correct"), F.col("n_true")).alias("recall")), "precision", "recall")


def copy_effect(spark, d):
    """Enumeration by all detections minus that by confident ones only, on the same images and resamples."""
    units, les, det = _boxes(spark, d)
    images = units.groupBy("image_id").agg(F.min("group_key").alias("group_key"))
    truth, found = _teeth(les, "lesion_id"), lambda rows: _teeth(rows, "det_id")
    honest, swapped = (de.enumeration_counts(images, truth, found(rows), IOU) for rows in (det.filter(F.col("score") >= SCORE), det))
    return de.copy_effect(honest, swapped, SEED, N_BOOT)


def tooth_inventory(spark, d):
    _, _, det = _boxes(spark, d)
    fdi = (F.floor((F.col("box.y1") / 40.0)) % 4 + 1) * 10 + F.floor(F.col("box.x1") / 50.0) % 8 + 1
    rows = det.select("image_id", fdi.cast("int").alias("fdi"), "box", "score", F.xxhash64("det_id").alias("ordinal"))
    best = de.inventory(rows, SCORE)
    return _r(best.groupBy("fdi").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("score") * 1000 + 0.5).cast("long")).alias("score_sum")))


# --- Copies --------------------------------------------------------------------------


def content_overlap_matrix(spark, d):
    return dd.overlap_matrix(fx.content_index(spark, d))


def exact_elsewhere(spark, d):
    return dd.exact_elsewhere(fx.content_index(spark, d))


def within_subset_dups(spark, d):
    return dd.repeats_within(fx.content_index(spark, d))


def _signatures(spark, d):
    """64-bit signatures of texts, from all their words."""
    return dd.simhash(fx.table(spark, d, "documents"), "doc_id", "text")


def _near(spark, d, most=6):
    """Pairs of representatives, and the representative of every document."""
    signatures = _signatures(spark, d)
    return dd.near_pairs(signatures, most), dd.members(signatures)


def near_pairs(spark, d):
    return dd.with_copies(*_near(spark, d))


def near_pairs_two_signals(spark, d):
    """Near pairs that both signals declare: signature and correlation of the thumbs."""
    signatures = _signatures(spark, d)
    pairs = dd.near_pairs(signatures, 6, 0.95)
    return dd.with_copies(pairs, dd.members(signatures))


def threshold_grid(spark, d, in_arrays=dd.IN_ARRAYS):
    signatures = written(_signatures(spark, d))
    items = signatures.groupBy("sig", "thumb").agg(F.min("id").alias("id"))
    pairs = dd.near_pairs_in_arrays(items, 10, -1.0) if items.count() <= in_arrays else dd.near_pairs(signatures, 10, -1.0)
    counts = dd.pair_counts(pairs, dd.members(signatures))
    return dd.threshold_grid(counts, [0, 2, 4, 6, 8, 10], [0.8, 0.9, 0.95])


def nn_cosine(spark, d):
    """Distribution of nearest-neighbour similarity of the centred vectors."""
    near = rv.nearest_cosine(rv.centred(fx.embeddings(spark, d)))
    return near.select(F.floor(F.col("cosine") * 100.0 + 0.0000001).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def mixture_cut(spark, d):
    """The nearest-neighbour similarities as one mode or two, and the cut between them if they are apart."""
    fit = fit_mixture(rv.nearest_cosine(rv.centred(fx.embeddings(spark, d))), "cosine")
    row = (fit.criterion[0], fit.criterion[1], fit.low.centre, fit.high.centre, fit.distance, fit.separated, fit.crossing() if fit.separated else None)
    return spark.createDataFrame([row], "one double, two double, low double, high double, distance double, separated boolean, cut double")


def recovered_by_both_signals(spark, d):
    """Group sizes from near signatures and, where the similarities fall into two modes, from cosines: documents with an embedding of their number."""
    items = fx.embeddings(spark, d)
    signatures = _signatures(spark, d).join(items.select("id"), "id", "left_semi")
    return dd.group_sizes(rv.recovered(signatures, items)[0])


def _contents(spark, d):
    """(subset, id): where each content is, by its first document; and the signatures of the contents."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("subset"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("id"))
    index = docs.join(first, "sha").select("subset", "id")
    whole = docs.join(first.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return index, dd.simhash(whole, "doc_id", "text")


def reencoded_matrix(spark, d):
    index, signatures = _contents(spark, d)
    return rv.reencoded_matrix(rv.reencoded(dd.near_pairs(signatures, 6), dd.members(signatures), index), index)


def any_copy(spark, d):
    index, signatures = _contents(spark, d)
    return rv.any_copy(rv.reencoded(dd.near_pairs(signatures, 6), dd.members(signatures), index), index)


def crossing_pairs(spark, d):
    """Near pairs of representatives between sources: what the gate would stop on."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp"))
    return rv.crossing(_near(spark, d)[0], docs)


def partner_in_train(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.col("doc_id").alias("id"))
    return rv.partner_in_train(dd.groups(*_near(spark, d)), sp.naive_image_split(docs, SEED).select("id", "partition"))


def side_by_side(spark, d):
    """Contents of two sources, with the languages that each states for them."""
    rows = fx.content_index(spark, d).join(fx.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "lang"), "file")
    pairs = rv.side_by_side(rows.select("subset", F.col("sha").alias("id"), F.col("lang").alias("label")), rows.select("subset", F.col("sha").alias("id")), "src1", "src13")
    return pairs.select("id", F.array_join("first", ",").alias("first"), F.array_join("second", ",").alias("second"))


def training_sets(spark, d):
    """Honest, swapped and naive training sets around the held-out documents of one source."""
    index = fx.content_index(spark, d).select("file", "sha", F.concat_ws("/", "subset", (F.col("file") % 50).cast("string")).alias("group_key"))
    held, rest = F.col("group_key").isin("src0/1", "src0/2", "src0/3"), F.col("group_key").isNotNull()
    sets = sp.training_sets(index.filter(rest & ~held), index.filter(held), SEED)
    return sets.groupBy("set").agg(F.count("*").alias("n"), F.sum("file").alias("files"))


def prevalence_intervals(spark, d):
    units = fx.units(spark, d).withColumn("cluster", F.col("site"))
    return rv.prevalence_intervals(units, F.col("level") > 0, SEED, N_BOOT)


def site_probe_auc(spark, d):
    """How well a linear probe tells the sites of the embeddings apart, out of fold."""
    probabilities = materialised(site_probe(fx.embeddings(spark, d)))
    return spark.createDataFrame([(macro_auc(probabilities, 3),)], "auc double")


def recovered_groups(spark, d):
    return dd.groups(*_near(spark, d))


def recovered_group_sizes(spark, d):
    return dd.group_sizes(dd.groups(*_near(spark, d)))


def split_sensitivity(spark, d):
    labels = dd.groups(*_near(spark, d))
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.col("doc_id").alias("id"))
    parts = sp.naive_image_split(docs, SEED).select("id", "partition")
    return dd.straddling(labels, parts)


def pair_quality(spark, d):
    """Near pairs against all pairs of documents in one language."""
    truth = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"))
    return _r(dd.pair_quality_of_groups(*_near(spark, d), truth), "precision", "recall")


# --- Tests of hypotheses -----------------------------------------------------------------


def prevalence_by_cluster(spark, d):
    rows = fx.units(spark, d).groupBy("site").agg(F.count("*").alias("n"), F.avg((F.col("level") > 0).cast("double")).alias("prevalence"))
    return _r(rows, "prevalence")


def chi2_stat(spark, d):
    return _r(dd.chi_square(fx.units(spark, d), "site", F.col("level") > 0), "chi2")


def chi2_yates(spark, d):
    return _r(dd.chi_square(fx.units(spark, d), "sex", F.col("level") > 0), "chi2")


def mann_whitney_u(spark, d):
    return _r(dd.mann_whitney(fx.event_groups(spark, d), "p", F.col("y") == 1), "u", "z")


# --- Records -------------------------------------------------------------------------------


def _records(spark, d):
    return rc.from_readings(fx.units(spark, d), fx.readings(fx.units(spark, d)))


def summary_counts(spark, d):
    return _r(rc.summary(rc.validated(materialised(_records(spark, d)))), "images_per_patient")


def record_round_trip(spark, d):
    """Records that JSON returns unchanged."""
    records = materialised(_records(spark, d))
    back = rc.from_json(rc.to_json(records))
    same = F.to_json(F.struct("annotations", "readers")) == F.to_json(F.struct(F.col("b_annotations").alias("annotations"), F.col("b_readers").alias("readers")))
    rows = records.join(back.select("image_id", F.col("annotations").alias("b_annotations"), F.col("readers").alias("b_readers")), "image_id")
    return rows.agg(F.count("*").alias("n"), F.sum(same.cast("long")).alias("unchanged"))


def findings_by_reader(spark, d):
    return rc.flatten(_records(spark, d)).groupBy("annotator_id", "finding").agg(F.count("*").alias("n"))


def constraint_counts(spark, d):
    """Violations of each record constraint; none in a valid data set."""
    return rc.violations(_records(spark, d))


def label_mapping_classify(spark, d):
    rows = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("brand"), "p_brand", F.lit("size"), (F.col("p_size") % 5).cast("string")).alias("axes"))
    rules = mp.Rules([mp.Rule("small_b1", {"brand": ["Brand#11", "Brand#12", "Brand#13"], "size": ["0", "1"]}), mp.Rule("any_large", {"size": ["4"]})])
    return mp.classify(rows, rules).groupBy("target").agg(F.count("*").alias("n"))


def tooth_numbers(spark, d):
    """Conversions of all tooth numbers."""
    fdi = spark.range(32).select((F.floor(F.col("id") / 8) * 10 + 10 + F.col("id") % 8 + 1).cast("int").alias("fdi"))
    return fdi.select("fdi", mirror_fdi(F.col("fdi")).cast("int").alias("mirrored"), fdi_label(F.col("fdi")).cast("int").alias("label"), label_fdi(fdi_label(F.col("fdi"))).cast("int").alias("back"))


def domain_shift_delta(spark, d):
    """Sensitivity for shallow lesions at one site minus another's: a class that may be reported as a gap only."""
    rules = mp.Rules([mp.Rule("caries", {"level": ["1"]}, report_as="delta"), mp.Rule("deep_caries", {"level": ["2"]})])
    flag = F.col("p_lesion") >= SCORE
    sums = {"n": (F.col("level") == 1).cast("long"), "t": ((F.col("level") == 1) & flag).cast("long")}
    rows = fx.units(spark, d)
    one = [Resampled(rows.filter(F.col("site") == s), sums, {"sensitivity": div(F.col("t"), F.col("n"))}, [], SEED + i, N_BOOT) for i, s in enumerate(("BUILDING", "MACHINERY"))]
    return estimate(*difference(*one, paired=False), []).withColumn("target", F.lit(rules.checked_delta("caries")))


def not_computable_ledger(spark, d):
    """Why a metric has no value, by brand of the part: from the sizes of each cell."""
    units = fx.units(spark, d).withColumn("cell", F.concat_ws("/", "site", (F.col("part") % 97).cast("string")))
    cells = units.groupBy("cell").agg(F.count_if(F.col("level") == 1).alias("n1"), F.count_if(F.col("level") == 2).alias("n2"), F.count_distinct("group_key").alias("groups"), F.count("age").alias("ages"))
    because = lambda test, metric, reason: F.when(test, F.struct(F.lit(metric).alias("metric"), F.lit(reason).alias("reason")))
    reasons = F.array(
        because(F.col("n1") == 0, "sensitivity_1", "no lesion of this level"), because(F.col("n2") == 0, "sensitivity_2", "no lesion of this level"),
        because(F.col("groups") < 2, "interval", "fewer than two patients"), because(F.col("ages") == 0, "subgroup_age", "no age on any unit"),
    )
    return cells.select("cell", F.explode(F.array_compact(reasons)).alias("x")).select("cell", "x.*")


QUERIES = {f.__name__: f for f in (
    iou_pairs, greedy_match, detection_sens, fp_per_image, froc, ap_pooled, ap_interval, ap_by_level, enumeration_pr, copy_effect, tooth_inventory, content_overlap_matrix, exact_elsewhere,
    within_subset_dups, near_pairs, near_pairs_two_signals, threshold_grid, nn_cosine, mixture_cut, recovered_by_both_signals, reencoded_matrix, any_copy, crossing_pairs, partner_in_train, side_by_side, training_sets,
    prevalence_intervals, site_probe_auc, recovered_groups, recovered_group_sizes, split_sensitivity, pair_quality, prevalence_by_cluster,
    chi2_stat, chi2_yates, mann_whitney_u, summary_counts, record_round_trip, findings_by_reader, constraint_counts, label_mapping_classify, tooth_numbers,
    domain_shift_delta, not_computable_ledger,
)}
