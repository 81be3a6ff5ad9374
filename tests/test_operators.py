"""Operators against worked examples with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditframe.functions import numeric as nu
from auditframe.operators import agreement as ag
from auditframe.operators import bootstrap as bs
from auditframe.operators import dedup as dd
from auditframe.operators import detection as de
from auditframe.operators import mapping as mp
from auditframe.operators import metrics as me
from auditframe.operators import records as rc
from auditframe.operators import splits as sp


def value(df, column):
    return df.first()[column]


# --- Splits ---------------------------------------------------------------


def parts(spark, rows):
    return spark.createDataFrame(rows, "partition string, image_id string, group_key string")


def test_leakage_is_counted_and_raises(spark):
    rows = parts(spark, [("train", "i1", "ds/p1"), ("train", "i2", "ds/p2"), ("test", "i3", "ds/p1")])
    one = sp.leakage(rows).first()
    assert (one.n_groups, one.leaked_groups, one.leaked_share, one.repeated_images) == (2, 1, 0.5, 0)
    with pytest.raises(sp.LeakageError, match="ds/p1"):
        sp.checked(rows)
    assert sp.checked(rows, allow_leakage=True) is rows
    twice = parts(spark, [("train", "i1", "a"), ("test", "i1", "a")])
    with pytest.raises(sp.LeakageError, match="more than once"):
        sp.checked(twice, allow_leakage=True)


def test_same_patient_number_in_two_data_sets_is_clean(spark):
    assert sp.checked(parts(spark, [("train", "i1", "one/p1"), ("test", "i2", "two/p1")]))


@pytest.fixture(scope="module")
def images(spark):
    return spark.range(600).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("image_id"), F.concat(F.lit("p"), (F.col("id") % 151).cast("string")).alias("group_key"), F.when(F.col("id") % 151 < 70, "A").otherwise("B").alias("site"))


def test_group_split_is_clean_proportional_and_independent_of_order(spark, images):
    one = {r.image_id: r.partition for r in sp.checked(sp.group_split(images, 1)).collect()}
    two = {r.image_id: r.partition for r in sp.group_split(images.orderBy(F.desc("image_id")).repartition(7), 1).collect()}
    other = {r.image_id: r.partition for r in sp.group_split(images, 2).collect()}
    assert one == two != other and len(one) == 600
    assert abs(sum(p == "train" for p in one.values()) / 600 - 0.6) < 0.02


def test_naive_split_leaks(images):
    assert value(sp.leakage(sp.naive_image_split(images, 1)), "leaked_groups") > 100


def test_kfold_is_disjoint_and_covers(images):
    folds = sp.group_kfold(images, 1)
    assert folds.count() == 600 and folds.groupBy("group_key").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert folds.select("fold").distinct().count() == 5


def test_site_holdout(spark, images):
    rows = sp.leave_one_site_out(images)
    assert rows.count() == 1200 and rows.filter("partition = 'test' AND site <> holdout").count() == 0
    with pytest.raises(ValueError, match="no site"):
        sp.leave_one_site_out(images.withColumn("site", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="two sites"):
        sp.leave_one_site_out(images.withColumn("site", F.lit("a")))
    with pytest.raises(sp.LeakageError, match="span"):
        sp.leave_one_site_out(images.withColumn("site", F.concat("site", F.pmod(F.xxhash64("image_id"), F.lit(2)).cast("string"))))


def test_a_repeated_image_is_an_error_wherever(spark):
    twice = parts(spark, [("train", "i1", "a"), ("train", "i1", "a"), ("test", "i2", "b")])
    assert sp.leakage(twice).first().repeated_images == 1
    with pytest.raises(sp.LeakageError, match="more than once"):
        sp.checked(twice)
    rows = parts(spark, [("train", "i1", "a"), ("test", "i2", "b")]).withColumn("patient_id_source", F.lit("assumed_unique"))
    assert sp.leakage(rows).first().unverifiable_groups == 2


def test_split_is_checked_when_it_is_made(spark, images):
    clean = sp.group_split(images, 1)
    assert sp.split(clean, "patient") is clean
    naive = sp.naive_image_split(images, 1)
    assert sp.split(naive, "image_naive", allow_leakage=True) is naive
    for rows, kind, allow in ((naive, "patient", False), (naive, "patient", True), (clean, "other", False), (clean.filter("partition = 'train'"), "patient", False)):
        with pytest.raises(ValueError):
            sp.split(rows, kind, allow)
    with pytest.warns(UserWarning, match="leaks no group"):
        sp.split(clean, "image_naive", allow_leakage=True)


def test_stratified_folds(images):
    folds = sp.group_kfold(images, 1, 4, stratum=F.max((F.col("site") == "A").cast("int")))
    assert folds.count() == 600 and folds.groupBy("group_key").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        sp.group_kfold(images.limit(3), 1, 50)


def test_operating_point_groups(spark):
    fitted, rows = spark.createDataFrame([("a",), ("b",)], "group_key string"), spark.createDataFrame([("b",), ("c",), ("c",)], "group_key string")
    with pytest.raises(sp.LeakageError, match="'b'"):
        sp.disjoint_groups(fitted, rows)
    assert sp.disjoint_groups(fitted, rows, allow_overlap=True) == 1 and sp.disjoint_groups(fitted.filter("group_key = 'a'"), rows) == 0


def test_training_sets(spark):
    rows = [(i, f"s{i}", f"g{i}") for i in range(10)] + [(10, "h0", "x"), (11, "s0", "k")]
    sets = sp.training_sets(spark.createDataFrame(rows, "file long, sha string, group_key string"), spark.createDataFrame([("h0", "held"), ("z", "k")], "sha string, group_key string"), 1)
    of = {}
    for r in sets.collect():
        of.setdefault(r.set, set()).add(r.file)
    assert of["honest"] == set(range(10)) and of["naive"] == set(range(12)) and len(of["swap"]) == 10 and of["swap"] - of["honest"] == {10}


@pytest.mark.parametrize("fractions", [{"a": 1.0}, {"a": 0.5, "b": 0.6}, {"a": 1.2, "b": -0.2}])
def test_bad_fractions(fractions):
    with pytest.raises(ValueError):
        sp.check_fractions(fractions)


def test_eligible_training(spark):
    rows = [("s1", "g1"), ("s2", "g2"), ("s3", "g3"), ("s4", "g4")]
    candidates = spark.createDataFrame(rows, "sha string, group_key string")
    held = spark.createDataFrame([("s2", "x"), ("y", "g3")], "sha string, group_key string")
    assert sorted(r.sha for r in sp.eligible_training(candidates, held).collect()) == ["s1", "s4"]


# --- Agreement -------------------------------------------------------------


def long(spark, matrix):
    rows = [(f"u{i}", f"g{i}", f"r{j}", g) for i, row in enumerate(matrix) for j, g in enumerate(row) if g is not None]
    return spark.createDataFrame(rows, "uid string, group_key string, rater string, grade int")


def test_consensus_is_the_lower_median(spark):
    got = {r.uid: r.grade for r in ag.consensus(long(spark, [[0, 1, 1], [1, 2, None], [2, 2, 0], [1, None, None], [0, 1, 2]])).collect()}
    assert got == {"u0": 1, "u1": 1, "u2": 2, "u3": None, "u4": 1}
    assert value(ag.consensus(long(spark, [[1]]), min_raters=1), "grade") == 1


#: A published example: ten subjects, fourteen raters, five categories.
FLEISS = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]


def test_fleiss_needs_a_complete_design(spark):
    with pytest.raises(ag.IncompleteDesign, match="u1"):
        ag.fleiss(long(spark, [[0, 1], [1, None], [1, 1]]), 2)
    assert ag.complete(long(spark, [[0, 1], [1, None], [1, 1]])).count() == 4


def test_fleiss(spark):
    assert round(value(ag.fleiss(long(spark, [[c for c, n in enumerate(row) for _ in range(n)] for row in FLEISS]), 5), "kappa"), 3) == 0.210


#: A published example: four coders, twelve units, values 1 to 5.
CODERS = [
    [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None], [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
    [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None], [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None],
]


@pytest.mark.parametrize("metric, alpha", [("nominal", 0.743), ("ordinal", 0.815), ("interval", 0.849)])
def test_krippendorff(spark, metric, alpha):
    matrix = [[None if c is None else c - 1 for c in unit] for unit in zip(*CODERS)]
    assert round(value(ag.krippendorff(long(spark, matrix), metric, 5), "alpha"), 3) == alpha


def kappa(spark, pairs, k, weights):
    rows = spark.createDataFrame(pairs, "a int, b int")
    return value(rows.agg(*[F.sum(c).alias(n) for n, c in ag.cell_sums(k).items()]).select(ag.kappa_of_cells(k, weights).alias("kappa")), "kappa")


def test_cohen_kappa(spark):
    assert kappa(spark, [(0, 0), (1, 1), (2, 2)], 3, "quadratic") == 1.0
    assert kappa(spark, [(0, 0), (0, 0)], 3, "none") is None
    assert round(kappa(spark, [(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15, 2, "none"), 6) == 0.4


def test_leave_one_out(spark):
    rows = {r.rater: r.loo for r in ag.leave_one_out(long(spark, [[0, 1, 2]])).collect()}
    assert rows == {"r0": 1, "r1": 0, "r2": 0}


# --- Bootstrap ----------------------------------------------------------------


def test_bootstrap_of_a_mean(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("group_key"), F.col("id").alias("x"))
    got = bs.Resampled(rows, {"x": F.col("x"), "n": F.lit(1)}, {"mean": nu.div(F.col("x"), F.col("n"))}, [], 1, 200).estimates().first()
    assert got.value == 4.5 and got.n_valid == 200 and got.lo < 4.5 < got.hi


def test_clustered_data_have_wider_intervals(spark):
    rows = spark.range(120).select(F.col("id").alias("u"), (F.col("id") % 30).cast("string").alias("g"))
    rows = rows.withColumn("x", nu.uniform(F.col("g")))
    final, sums = {"m": nu.div(F.col("x"), F.col("n"))}, {"x": F.col("x"), "n": F.lit(1)}
    wide = bs.Resampled(rows.withColumn("group_key", F.col("g")), sums, final, [], 1, 400).estimates().first()
    thin = bs.Resampled(rows.withColumn("group_key", F.col("u").cast("string")), sums, final, [], 1, 400).estimates().first()
    assert (wide.hi - wide.lo) > 1.6 * (thin.hi - thin.lo)


def test_bootstrap_guards(spark):
    one = spark.createDataFrame([("g", 1)], "group_key string, x int")
    many = spark.range(20).select(F.col("id").cast("string").alias("group_key"), F.col("id").alias("x"))
    make = lambda rows, seed: bs.Resampled(rows, {"x": F.col("x")}, {"s": F.col("x")}, [], seed, 20)
    with pytest.raises(ValueError, match="two groups"):
        make(one, 1).samples()
    with pytest.raises(ValueError, match="same seed"):
        bs.difference(make(many, 1), make(many, 2), paired=True)
    with pytest.raises(ValueError, match="different seeds"):
        bs.difference(make(many, 1), make(many, 1), paired=False)
    values, samples = bs.difference(make(many, 1), make(many, 1), paired=True)
    assert value(values, "v") == 0 and samples.filter("v <> 0").count() == 0


def test_undefined_resamples_are_counted(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 0, 0), ("c", 0, 0)], "group_key string, y int, n int")
    got = bs.Resampled(rows, {"y": F.col("y"), "n": F.col("n")}, {"rate": nu.div(F.col("y"), F.col("n"))}, [], 3, 100).estimates().first()
    assert got.value == 1 and 0 < got.n_valid < 100


def test_poisson_weights_have_mean_one(spark):
    index = spark.range(500).select(F.col("id").cast("string").alias("group_key"))
    total = bs.poisson_weights(index, 1, 20).agg(F.sum("w")).first()[0]
    assert abs(total / 10_000 - 1) < 0.05


# --- Metrics -----------------------------------------------------------------------


def py(spark, p, y):
    return spark.createDataFrame(list(zip(map(float, p), y)), "p double, y int")


def test_auc(spark):
    rows = py(spark, [0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1])
    assert value(me.auc(rows, "p", F.col("y") == 1, []), "auc") == 0.75
    assert value(me.auc(py(spark, [0.5] * 4, [0, 1, 0, 1]), "p", F.col("y") == 1, []), "auc") == 0.5
    assert value(me.auc(py(spark, [0.5], [1]), "p", F.col("y") == 1, []), "auc") is None


def test_calibration(spark):
    assert value(me.ece(me.uniform_bins(py(spark, [0.1, 0.1, 0.9, 0.9], [0, 1, 1, 1]), 2)), "ece") == pytest.approx(0.25)
    tied = me.quantile_bins(py(spark, [0.3] * 10, [0, 1] * 5), 10)
    assert tied.select("bin").distinct().count() == 1 and value(me.ece(tied), "ece") == pytest.approx(0.2)
    assert [value(me.brier(py(spark, p, [0, 1]), []), "brier") for p in ([0, 1], [1, 0], [0.5, 0.5])] == [0, 1, 0.25]


def test_recalibration(spark):
    assert me.recalibration(py(spark, [0.2, 0.8], [1, 1])) is None
    assert me.recalibration(py(spark, [0.5] * 4, [0, 1, 0, 1])) is None
    assert me.recalibration(py(spark, [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1])) is None
    p = [0.2] * 10 + [0.8] * 10
    slope, intercept = me.recalibration(py(spark, p, [1] * 2 + [0] * 8 + [1] * 8 + [0] * 2))
    assert slope == pytest.approx(1) and intercept == pytest.approx(0, abs=1e-9)


def test_risk_coverage(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.6, True)], "confidence double, correct boolean")
    curve = sorted(me.risk_coverage(rows).collect(), key=lambda r: r.coverage)
    assert [round(r.risk, 6) for r in curve] == [0, 0.5, round(1 / 3, 6), 0.25]
    tied = spark.createDataFrame([(0.9, True), (0.5, False), (0.5, True), (0.1, True)], "confidence double, correct boolean")
    assert sorted(r.coverage for r in me.risk_coverage(tied).collect()) == [0.25, 0.75, 1]


def test_operating_points(spark):
    rows = py(spark, [0.9, 0.8, 0.6, 0.4, 0.5, 0.3, 0.2, 0.1], [1, 1, 1, 1, 0, 0, 0, 0])
    sens = me.operating_point(rows, "sensitivity", 0.75).first()
    assert sens.threshold == 0.6 and sens.fitted == 0.75 and not sens.strict
    spec = me.operating_point(rows, "specificity", 0.75).first()
    assert spec.threshold == 0.3 and spec.fitted == 0.75 and spec.strict
    band = me.operating_point(rows, "sensitivity", 0.75, coverage=0.75).first()
    assert band.margin == pytest.approx(0.1)
    with pytest.raises(ValueError):
        me.operating_point(rows, "speed", 0.5)


def test_age_bands(spark):
    rows = spark.createDataFrame([(float(a),) for a in (10, 18, 34, 35, 64, 65, 90)] + [(None,)], "age double")
    assert [r[0] for r in rows.select(nu.age_band(F.col("age"))).collect()] == ["<18", "18-34", "18-34", "35-49", "50-64", "65+", "65+", None]


def test_grades(spark):
    rows = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.9, 0.05, 0.05],), ([0.4, 0.3, 0.3],)], "p array<double>")
    assert [r[0] for r in rows.select(nu.grade_at(F.col("p"), 0.5)).collect()] == [1, 0, 1]


# --- Detection ------------------------------------------------------------------------


def box(*b):
    return dict(zip(("x1", "y1", "x2", "y2"), map(float, b)))


A, B, BG = box(0, 0, 10, 10), box(100, 100, 110, 110), box(300, 300, 310, 310)
LES = "image_id string, group_key string, lesion_id string, level int, box struct<x1:double,y1:double,x2:double,y2:double>"
DET = "image_id string, det_id string, score double, box struct<x1:double,y1:double,x2:double,y2:double>"


def matched(spark, les, det, **kw):
    les = spark.createDataFrame([("i", "g", k, level, b) for k, level, b in les], LES)
    det = spark.createDataFrame([("i", k, s, b) for k, s, b in det], DET)
    return les, de.greedy_match(les, det, **kw)


def claims(spark, les, det, **kw):
    return {r.det_id: r.lesion_id for r in matched(spark, les, det, **kw)[1].collect()}


def test_greedy_match(spark):
    assert claims(spark, [("a", 1, A), ("b", 2, B)], [("d1", 0.9, A), ("d2", 0.8, A), ("d3", 0.7, BG), ("d4", 0.6, B)]) == {"d1": "a", "d2": None, "d3": None, "d4": "b"}
    near = box(6, 0, 16, 10)
    assert claims(spark, [("a", 1, A)], [("d", 0.9, near)]) == {"d": None}
    assert claims(spark, [("a", 1, A)], [("d", 0.9, near)], threshold=0.2) == {"d": "a"}
    two = [("a", 1, A), ("b", 2, box(1, 0, 11, 10))]
    assert claims(spark, two, [("d1", 0.9, A), ("d2", 0.8, A)], threshold=0.5) == {"d1": "a", "d2": "b"}
    assert claims(spark, two, [("d1", 0.9, A)], threshold=0.5, target=2) == {"d1": "b"}


def test_average_precision(spark):
    rows = spark.createDataFrame([(0.9, "a", True), (0.8, "b", False), (0.7, "c", True)], "score double, det_id string, tp boolean")
    pos = lambda n: spark.createDataFrame([(n,)], "n_pos int")
    assert value(de.average_precision(rows, pos(3), []), "ap") == pytest.approx(1 / 3 + 2 / 9)
    assert value(de.average_precision(rows, pos(0), []), "ap") is None
    assert value(de.average_precision(rows.limit(0), pos(2), []), "ap") in (0.0, None)


def test_false_positives_count_images_without_boxes(spark):
    _, m = matched(spark, [("a", 1, A)], [("d", 0.9, BG)])
    images = spark.createDataFrame([("i", "g"), ("j", "g")], "image_id string, group_key string")
    assert {r.image_id: r.fp for r in de.false_positives(images, m, 0.5).collect()} == {"i": 1, "j": 0}


def test_froc(spark):
    les, m = matched(spark, [("a", 1, A)], [("d", 0.9, A), ("e", 0.8, BG)])
    assert [r.sensitivity for r in de.froc(les, m, 1, [1.0]).collect()] == [1.0]


def test_enumeration(spark):
    kind = "image_id string, fdi int, box struct<x1:double,y1:double,x2:double,y2:double>"
    truth = spark.createDataFrame([("i", 11, A), ("i", 21, B), ("i", 36, BG)], kind)
    pred = spark.createDataFrame([("i", 11, A), ("i", 22, B), ("i", 36, A)], kind)
    assert tuple(de.enumeration(truth, pred, 0.5).first()) == (3, 3, 1)


def test_tooth_numbers(spark):
    rows = spark.createDataFrame([(16,), (26,), (37,), (48,)], "f int")
    assert [r[0] for r in rows.select(nu.mirror_fdi(F.col("f"))).collect()] == [26, 16, 47, 38]


# --- Copies and groups --------------------------------------------------------------


def test_near_pairs_is_exact(spark):
    import random

    random.seed(1)
    sigs = [random.getrandbits(63) for _ in range(40)]
    sigs += [s ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63)) for s in sigs[:20]] + sigs[:3]
    rows = spark.createDataFrame(list(enumerate(sigs)), "id long, sig long")
    for most in (0, 6, 10):
        first = {}
        for i, s in enumerate(sigs):
            first.setdefault(s, i)
        want = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and bin(s ^ t).count("1") <= most}
        assert {(r.a, r.b) for r in dd.near_pairs(rows, most).collect()} == want
    with pytest.raises(ValueError):
        dd.near_pairs(rows, 32)
    first, want = {}, None
    for equal in (1, 2, 3, 4):  # whatever the width of the keys
        got = {tuple(r) for r in dd.near_pairs(rows, 4, equal=equal).collect()}
        want = want or got
        assert got == want and got
    assert dd.agreeing_bands(10**9, 6) > dd.agreeing_bands(100, 6)


def test_near_pairs_by_two_signals(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    thumbs = [rng.random(8).tolist() for _ in range(6)]
    thumbs += [(2.0 * np.array(t) + 1).tolist() for t in thumbs[:3]]
    rows = [(i, (i % 3) << 40, t) for i, t in enumerate(thumbs)]
    got = {(r.a, r.b): r.correlation for r in dd.near_pairs(spark.createDataFrame(rows, "id long, sig long, thumb array<double>"), 6, -1.0).collect()}
    assert len(got) == 36 and all(abs(c - np.corrcoef(thumbs[a], thumbs[b])[0, 1]) < 1e-9 for (a, b), c in got.items())
    high = dd.near_pairs(spark.createDataFrame(rows, "id long, sig long, thumb array<double>"), 6, 0.999)
    assert {(r.a, r.b) for r in high.collect()} == {(0, 6), (1, 7), (2, 8)}


def simhash_brute(text):
    import hashlib

    hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in set((text or "").split(" "))]
    sig = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    return sig - (1 << 64) if sig >> 63 else sig


def test_signatures_are_of_all_words(spark, tmp_path):
    from auditframe.plans import audit

    opening, body, other = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("o", 16), ("b", 400), ("x", 400)))
    texts = [f"{opening} {body}", f"another start {body}", f"{opening} {other}", None, "", "é 漢字 a a  a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.sig for r in audit._signatures(spark, str(tmp_path)).collect()}
    assert got == {i: simhash_brute(t) for i, t in enumerate(texts)}
    apart = lambda a, b: bin((got[a] ^ got[b]) & (2**64 - 1)).count("1")
    assert apart(0, 1) < 16 < apart(0, 2)


def test_copies_count_as_items(spark):
    from itertools import combinations

    sigs = [5, 5, 5, 7, 7, 1 << 40, -1, -1, 255 << 20]  # copies with and without near neighbours
    lang = ["en", "en", "de", "en", "de", "de", "en", None, "en"]
    near = {(a, b): d for a, b in combinations(range(9), 2) if (d := bin((sigs[a] ^ sigs[b]) & (2**64 - 1)).count("1")) <= 6}
    rows = spark.createDataFrame(list(enumerate(sigs)), "id long, sig long")
    pairs, members = dd.near_pairs(rows, 6), dd.members(rows)
    counts = dd.pair_counts(pairs, members).withColumn("correlation", F.coalesce("correlation", F.lit(1.0)))
    grid = {r.most: r.n for r in dd.threshold_grid(counts, [0, 2, 6], [0.9]).collect()}
    assert grid == {most: sum(d <= most for d in near.values()) for most in (0, 2, 6)} and grid[0] == 5
    labels = {i: i for i in range(9)}
    for a, b in sorted(near) * 9:
        labels[a] = labels[b] = min(labels[a], labels[b])
    want = {i: labels[i] for i in range(9) if any(i in p for p in near)}
    found = dd.groups(pairs, members)
    assert {r.id: r.label for r in found.collect()} == want and {6, 7} <= set(want)
    assert {r.id for p in ("a", "b") for r in dd.with_copies(pairs, members).select(dd.F.col(p).alias("id")).collect()} == set(want)
    homes = spark.createDataFrame([(i, "test" if i == 7 else "train") for i in range(9)], "id long, partition string")
    assert dd.straddling(found, homes).first().asDict() == {"groups": 2, "straddling": 1}
    true = {(a, b) for a, b in combinations(range(9), 2) if lang[a] and lang[a] == lang[b]}
    q = dd.pair_quality_of_groups(pairs, members, spark.createDataFrame(list(enumerate(lang)), "id long, grp string")).first()
    assert (q.n_declared, q.n_true, q.both) == (len(near), len(true), len(true & set(near))) and 0 < q.recall < 1


def test_connected(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)], "a long, b long")
    labels = {r.id: r.label for r in dd.connected(links).collect()}
    assert {labels[i] for i in range(31)} == {0} and {labels[i] for i in (100, 101, 102)} == {100}
    with pytest.raises(dd.NotConverged):
        dd.connected(links, rounds=1)


def test_hypothesis_tests(spark):
    rows = spark.createDataFrame([("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 20 + [("b", 0)] * 20, "c string, y int")
    assert round(value(dd.chi_square(rows, "c", F.col("y") == 1), "chi2"), 4) == 4.32
    sample = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 0), (4.0, 0)], "x double, y int")
    assert value(dd.mann_whitney(sample, "x", F.col("y") == 1), "u") == 0


# --- Records and mapping ----------------------------------------------------------------


def record(spark, **change):
    note = {"finding": "caries", "annotator_id": "r1", "bbox": None, "tooth_fdi": 16, "stage": 1, "confidence": 0.5, "meta": None}
    base = {
        "image_id": "i", "path": "/x/i.png", "patient_id": "p", "patient_id_source": "provided", "dataset": "ds", "modality": "bitewing", "readers": ["r1"], "annotations": [note], "site_id": "A", "device": None,
        "age": 30.0, "sex": "F", "teeth_present": [16, 17], "teeth_present_source": "annotated", "width": 10, "height": 10, "meta": None,
    }
    notes = [{**note, **x} for x in change.pop("notes", [{}])]
    base |= {"annotations": notes} | change
    return spark.createDataFrame([tuple(base[k] for k in base)], rc.RECORD)


@pytest.mark.parametrize("name, change", [
    ("box", {"notes": [{"bbox": box(5, 0, 5, 1)}]}), ("annotator", {"notes": [{"annotator_id": " "}], "readers": [" "]}), ("tooth", {"notes": [{"tooth_fdi": 19}], "teeth_present": [16, 19]}),
    ("confidence", {"notes": [{"confidence": 1.5}]}), ("stage", {"notes": [{"finding": "deep_caries", "stage": 1}]}), ("inventory_source", {"teeth_present_source": None}), ("identity", {"patient_id": ""}),
    ("stray_annotator", {"notes": [{"annotator_id": "r9"}]}), ("inventory", {"notes": [{"tooth_fdi": 18}]}), ("age", {"age": 130.0}), ("size", {"width": 0}),
])
def test_each_constraint(spark, name, change):
    bad = record(spark, **change)
    assert {r.name for r in rc.violations(bad).filter("n > 0").collect()} >= {name}
    with pytest.raises(rc.InvalidRecord, match=name):
        rc.validated(bad)


def test_valid_record_and_round_trip(spark):
    good = record(spark)
    assert rc.validated(good) is good
    assert rc.from_json(rc.to_json(good)).collect() == good.collect()
    assert rc.flatten(good).first().group_key == "ds/p"


def test_readers_are_not_pooled_silently(spark):
    two = record(spark, readers=["r1", "r2"])
    with pytest.raises(rc.InvalidRecord, match="several readers"):
        rc.has(two, "caries", None)
    with pytest.raises(rc.InvalidRecord, match="did not read"):
        rc.findings_by(two, "r9")
    assert [value(rc.has(two, "caries", r), "has") for r in ("r1", "r2")] == [True, False]


def test_inventory_must_be_independent(spark):
    assert rc.check_inventory(record(spark)) == 0.5
    with pytest.raises(rc.InvalidRecord):
        rc.check_inventory(record(spark), 0.6)
    with pytest.raises(rc.InvalidRecord, match="independent"):
        rc.check_inventory(record(spark, teeth_present=[16]))


def test_label_mapping(spark):
    rows = spark.createDataFrame([("x", {"lesion": "periapical", "density": "lucent"}), ("y", {"lesion": "caries", "depth": "pulp"}), ("z", {})], "id string, axes map<string,string>")
    rules = mp.Rules([mp.Rule("periapical_lesion", {"lesion": ["periapical"], "density": ["lucent", "mixed"]}), mp.Rule("any_caries", {"lesion": ["caries"]}, report_as="delta"), mp.Rule("deep_caries", {"lesion": ["caries"], "depth": ["pulp"]})])
    assert sorted((r.id, r.target) for r in mp.classify(rows, rules).collect()) == [("x", "periapical_lesion"), ("y", "any_caries"), ("y", "deep_caries")]
    assert rules.delta_only() == ["any_caries"] and rules.reportable() == ["periapical_lesion", "deep_caries"]
    for bad in ([mp.Rule("a", {"x": ["1"]})] * 2, [mp.Rule("a", {})], [mp.Rule("a", {"x": ["1"]}, rationale=" ")]):
        with pytest.raises(ValueError):
            mp.Rules(bad)
    with pytest.raises(ValueError):
        mp.Rules([], version="1")


# --- Running sums --------------------------------------------------------------------------


@pytest.mark.parametrize("descending, largest", [(False, False), (True, False), (False, True), (True, True)])
def test_running(spark, descending, largest):
    import random

    from auditframe.operators.running import running

    rng = random.Random(1)
    rows = [(k, x, rng.randint(-5, 9)) for k in "ab" for x in sorted({rng.choice([rng.random(), 1e6 * rng.random(), 0.5]) for _ in range(300)})] + [("c", 2.0, 4)]
    got = {(r.k, r.x): (r.v, r.v_before) for r in running(spark.createDataFrame(rows, "k string, x double, v long"), ["k"], "x", ["v"], descending, largest).collect()}
    for k in "abc":
        total = None
        for _, x, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1], reverse=descending):
            before, total = total, v if total is None else max(total, v) if largest else total + v
            assert got[k, x] == (total, before)


def ap_brute(rows, n_pos):
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    hits, precision = 0, []
    for k, (_, _, tp) in enumerate(order, 1):
        hits += tp
        precision.append(hits / k)
    return sum(max(precision[k:]) for k, r in enumerate(order) if r[2]) / n_pos


def test_average_precision_with_ties(spark):
    import random

    rng = random.Random(2)
    rows = [(k, rng.randint(0, 12) / 10, f"d{i:03d}", rng.random() < 0.4) for k in (1, 2) for i in range(120)]
    got = de.average_precision(spark.createDataFrame(rows, "k int, score double, det_id string, tp boolean"), spark.createDataFrame([(1, 70), (2, 90), (3, 5)], "k int, n_pos long"), ["k"])
    found = {r.k: r.ap for r in got.collect()}
    assert all(abs(found[k] - ap_brute([r[1:] for r in rows if r[0] == k], n)) < 1e-9 for k, n in ((1, 70), (2, 90))) and found[3] == 0


def test_resampled_average_precision(spark):
    rows = [("g1", 0.9, True), ("g1", 0.8, False), ("g2", 0.7, True), ("g2", 0.7, False), ("g3", 0.95, False)]
    lesions = [("g1",), ("g2",), ("g2",)]
    values, samples = de.resampled_average_precision(spark.createDataFrame(rows, "group_key string, score double, tp boolean"), spark.createDataFrame(lesions, "group_key string"), [], 3, 50)
    # .95 wrong; .9 right: 1/2; .8 wrong; the two at .7 enter together: 2/5
    assert abs(values.first().v - (0.5 + 0.4) / 3) < 1e-9
    drawn = samples.collect()
    assert len(drawn) <= 50 and all(r.v is None or 0 <= r.v <= 1 for r in drawn)
    one = {r.b: r.v for r in drawn}
    w = {}
    for r in bs.weights(bs.group_index(spark.createDataFrame(rows, "group_key string, score double, tp boolean")), 3, 3, 50).collect():
        w.setdefault(r.b, {})[f"g{r.g + 1}"] = r.w
    for b, by in w.items():
        again = [x for x in rows for _ in range(by.get(x[0], 0))]  # weights are repeated rows
        n_pos = sum(by.get(g, 0) for g, in lesions)
        steps, total = [], 0.0
        for s in sorted({x[1] for x in again}, reverse=True):
            upto = [x for x in again if x[1] >= s]
            steps.append((sum(x[2] for x in again if x[1] == s), sum(x[2] for x in upto) / len(upto)))
        for k, (hits, _) in enumerate(steps):
            total += hits * max(p for _, p in steps[k:])
        assert one.get(b) is None if not n_pos else abs(one[b] - total / n_pos) < 1e-9


def test_resampled_average_precision_in_arrays_or_joined(spark, monkeypatch):
    """Whole resamples in a task give what joined weights give, without a join of weights (the code before joined them always)."""
    monkeypatch.setattr(de, "AT_ONCE", 7)
    odd = [None, float("nan"), 0.0, -0.0, -1.5]
    rows = [(None if i % 29 == 0 else f"g{i % 13}", odd[i % 5] if i % 4 == 0 else (i * 7 % 10) / 10, i % 3 == 0) for i in range(200)]
    lesions = [(f"g{i % 17}",) for i in range(90)]
    rows, lesions = spark.createDataFrame(rows, "group_key string, score double, tp boolean"), spark.createDataFrame(lesions, "group_key string")
    whole, joined = (de.resampled_average_precision(rows, lesions, [], 5, 40, most) for most in (de.IN_ARRAYS, 0))
    plans = [part[1]._jdf.queryExecution().optimizedPlan().toString() for part in (whole, joined)]
    assert "Join" not in plans[0] and "MapInArrow" in plans[0] and "Join" in plans[1]
    a, b = ({r.b: r.v for r in part[1].collect()} for part in (whole, joined))
    assert len(a) == 40 and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert abs(whole[0].first().v - joined[0].first().v) < 1e-12
    none = rows.filter("false")
    for most in (de.IN_ARRAYS, 0):
        values, samples = de.resampled_average_precision(none, lesions, [], 5, 4, most)
        assert values.first().v == 0 and [r.v for r in samples.collect()] == [0.0] * 4


def test_near_pairs_in_arrays(spark, monkeypatch):
    """The same pairs as by keys, which are not made (the code before exploded every signature into its keys, thumb included)."""
    import random

    monkeypatch.setattr(dd, "ROWS", 3)
    monkeypatch.setattr(dd, "COLUMNS", 7)
    rng = random.Random(4)
    sigs = [rng.getrandbits(64) - (1 << 63) for _ in range(30)]
    sigs += [s ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for s in sigs] + sigs[:5]
    for unit in (1.0, 0.37):
        rows = [(3 * i % 65, s, [4.0] * 8 if i % 11 == 0 else [rng.randint(0, 5) * unit for _ in range(8)]) for i, s in enumerate(sigs)]
        items = spark.createDataFrame(rows, "id long, sig long, thumb array<double>")
        for correlation in (-1.0, 0.2):
            found = dd.near_pairs_in_arrays(items, 10, correlation)
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "Generate" not in plan and "Join" not in plan
            got = {(r.a, r.b): (r.distance, r.correlation) for r in found.collect()}
            want = {(r.a, r.b): (r.distance, r.correlation) for r in dd.near_pairs(items, 10, correlation).collect()}
            assert got.keys() == want.keys()
            assert len(got) >= 3 and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)
    assert not dd.near_pairs_in_arrays(items.filter("false"), 10, -1.0).count()
