"""Ratings, tables and comparisons with readers, on worked examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditframe.operators import agreement as ag
from auditframe.operators import ratings as ra
from auditframe.operators import records as rc
from auditframe.functions import numeric as nu


def note(reader, finding, fdi, stage=None):
    return (finding, reader, None, fdi, stage, None, None)


def records(spark, rows):
    """(image, patient, readers, notes, teeth)"""
    return spark.createDataFrame([(i, f"/x/{i}.png", p, "provided", "ds", "bitewing", readers, notes, "A", None, 30.0, "F", teeth, "annotated" if teeth else None, None, None, None) for i, p, readers, notes, teeth in rows], rc.RECORD)


@pytest.fixture(scope="module")
def two(spark):
    return records(spark, [
        ("i1", "p1", ["r1", "r2"], [note("r1", "deep_caries", 12), note("r1", "caries", 12), note("r2", "caries", 13), note("r2", "impacted", 11)], [11, 12, 13]),
        ("i2", "p2", ["r1"], [], [11, 12, 13]),
    ])


def test_tooth_ratings(two):
    got = {(r.uid, r.rater): r.grade for r in ra.tooth_ratings(two).collect()}
    assert got == {("i1#11", "r1"): 0, ("i1#11", "r2"): 0, ("i1#12", "r1"): 2, ("i1#12", "r2"): 0, ("i1#13", "r1"): 0, ("i1#13", "r2"): 1, ("i2#11", "r1"): 0, ("i2#12", "r1"): 0, ("i2#13", "r1"): 0}
    assert ra.all_readers(two) == ["r1", "r2"]
    image = {(r.uid, r.rater): r.grade for r in ra.image_ratings(two).collect()}
    assert image == {("i1", "r1"): 2, ("i1", "r2"): 1, ("i2", "r1"): 0}


def test_units_that_cannot_be_formed(spark, two):
    with pytest.raises(rc.InvalidRecord, match="no tooth inventory"):
        ra.tooth_ratings(two.withColumn("teeth_present", F.when(F.col("image_id") == "i1", F.col("teeth_present"))))
    with pytest.raises(rc.InvalidRecord, match="without a tooth number"):
        ra.tooth_ratings(records(spark, [("i", "p", ["r1"], [note("r1", "caries", None)], [11, 12])]))
    with pytest.raises(rc.InvalidRecord, match="not independent"):
        ra.tooth_ratings(records(spark, [("i", "p", ["r1"], [note("r1", "caries", 11)], [11])]))
    kept, count = ra.inventoried(two.withColumn("teeth_present", F.when(F.col("image_id") == "i1", F.col("teeth_present"))))
    assert kept.count() == 1 and count == {"kept": 1, "excluded": 1}
    with pytest.raises(rc.InvalidRecord):
        ra.inventoried(two.withColumn("teeth_present", F.lit(None).cast("array<int>")))


def test_stage_scale(spark):
    staged = records(spark, [("i", "p", ["r1"], [note("r1", "caries", 11, 3)], [11, 12])])
    assert sorted(r.grade for r in ra.tooth_ratings(staged, ra.by_stage).collect()) == [0, 3]
    with pytest.raises(Exception, match="not on this scale"):
        ra.image_ratings(records(spark, [("i", "p", ["r1"], [note("r1", "caries", 11)], [11, 12])]), ra.by_stage).collect()


def predictions(spark, drop=(), more=()):
    rows = [(i, t, [0.2, 0.5, 0.3] if (i, t) == ("i1", 12) else [0.9, 0.05, 0.05]) for i in ("i1", "i2") for t in (11, 12, 13) if (i, t) not in drop]
    return spark.createDataFrame([*rows, *more], "image_id string, tooth_fdi int, probs array<double>")


def test_tooth_table(spark, two):
    rows = {r.uid: r for r in ra.tooth_table(two, predictions(spark)).withColumn("p", ra.p_lesion(F.col("probs"))).withColumn("half", nu.grade_at(F.col("probs"), 0.5)).collect()}
    assert {u: r.reference for u, r in rows.items()} == {"i1#11": 0, "i1#12": 0, "i1#13": 0, "i2#11": 0, "i2#12": 0, "i2#13": 0}
    assert round(rows["i1#12"].p, 6) == 0.8 and rows["i1#12"].half == 1 and rows["i1#11"].half == 0 and rows["i1#11"].group_key == "ds/p1"
    assert {r.uid for r in ra.tooth_table(two, predictions(spark), reader="r1").filter("reference = 2").collect()} == {"i1#12"}
    with pytest.raises(rc.InvalidRecord, match="did not read"):
        ra.tooth_table(two, predictions(spark), reader="r2")


@pytest.mark.parametrize("change, match", [
    ({"drop": [("i2", 11)]}, "without a prediction"), ({"more": [("i1", 18, [1.0, 0.0, 0.0])]}, "not in the inventory"), ({"more": [("i1", 11, [1.0, 0.0, 0.0])]}, "predicted twice"),
    ({"drop": [("i1", 11)], "more": [("i1", 11, [0.7, 0.7, 0.0])]}, "not probabilities"), ({"drop": [("i1", 11)], "more": [("i1", 11, [1.0, 0.0])]}, "not probabilities"),
])
def test_predictions_cover_the_inventory(spark, two, change, match):
    with pytest.raises(ValueError, match=match):
        ra.tooth_table(two, predictions(spark, **change))


def panel(spark, n=120, readers=4, copies=0):
    """A latent truth, noisy readers, and a model that copies one of them."""
    import random

    rng = random.Random(7)
    rows, model = [], []
    for u in range(n):
        truth = rng.choice([0, 0, 1, 2])
        grades = [truth if rng.random() > 0.3 else rng.randint(0, 2) for _ in range(readers)]
        rows += [(f"u{u}", f"g{u // 2}", f"r{j}", g) for j, g in enumerate(grades)]
        model.append((f"u{u}", grades[copies]))
    return spark.createDataFrame(rows, "uid string, group_key string, rater string, grade int"), spark.createDataFrame(model, "uid string, m int")


def test_a_model_that_copies_a_reader_exceeds_that_ceiling_alone(spark):
    ratings, model = panel(spark)
    got = {r.rater: r for r in ag.model_vs_readers(ra.aligned(ratings, model), 3, "linear", 1, 200).collect()}
    assert got["r0"].model == 1.0 and got["r0"].exceeds_ceiling and not any(got[f"r{i}"].exceeds_ceiling for i in (1, 2, 3))
    assert all(r.n == 120 and r.individual < r.model or r.rater != "r0" for r in got.values())
    with pytest.raises(ValueError, match="at least 3 readers"):
        ag.model_vs_readers(ra.aligned(ratings.filter("rater < 'r2'"), model), 3, "linear", 1, 20)
    with pytest.raises(ValueError, match="without a grade"):
        ra.aligned(ratings, model.filter("uid <> 'u3'"))
    with pytest.raises(ValueError, match="several grades"):
        ra.aligned(ratings, model.unionByName(model.limit(1)))


def test_kappas_of_unread_units(spark):
    """Cells of a reader who is missing count for nothing."""
    ratings, model = panel(spark, 60)
    some = ratings.filter("NOT (rater = 'r3' AND uid < 'u3')")
    got = {r.rater: r for r in ag.model_vs_readers(ra.aligned(some, model), 3, "none", 1, 50).collect()}
    by = {}
    for r in some.collect():
        by.setdefault(r.uid, {})[r.rater] = r.grade

    def kappa(a, b):
        n, k = len(a), range(3)
        o = sum(x == y for x, y in zip(a, b)) / n
        e = sum(a.count(i) * b.count(i) for i in k) / n**2
        return (o - e) / (1 - e)

    for r in ("r0", "r3"):
        units = [g for g in by.values() if r in g and len(g) > 2]
        singles = [[(g[o], g[r]) for g in units if o in g] for o in ("r0", "r1", "r2", "r3") if o != r]
        loo = [(sorted(v for o, v in g.items() if o != r)[(len(g) - 2) // 2], g[r]) for g in units]
        assert got[r].n == len(units) and abs(got[r].ceiling - kappa(*map(list, zip(*loo)))) < 1e-6
        assert abs(got[r].individual - sum(kappa(*map(list, zip(*s))) for s in singles) / 3) < 1e-6


def test_sweep(spark):
    ratings, model = panel(spark, 80)
    scored = ra.aligned(ratings, model.select("uid", (F.col("m") * 30 + 20).alias("m"))).withColumnRenamed("m", "s")
    grade = lambda t: (F.col("s") >= t).cast("int") + (F.col("s") >= t + 30).cast("int")
    curve = ag.sweep_curve(scored, spark.createDataFrame([(10,), (40,), (50,), (90,)], "t int"), grade, 3, "linear")
    assert curve.count() == 4
    rows = {r.statistic: r for r in ag.sweep_summary(scored, curve, 10, grade, 3, "linear", 1, 100).collect()}
    top = max(curve.collect(), key=lambda r: (r.kappa, -r.t))
    assert rows["at_best"].best == top.t and abs(rows["at_best"].value - top.kappa) < 1e-6
    assert abs(rows["best_minus_operating"].value - (rows["at_best"].value - rows["at_operating"].value)) < 2e-6
    assert rows["ceiling"].reaches_ceiling == (top.kappa >= rows["ceiling"].lo) and rows["ceiling"].operating_costs_agreement == (rows["best_minus_operating"].lo > 0)


def test_regions(spark):
    got = spark.createDataFrame([(t,) for t in (11, 22, 33, 44, 45, 16, 28)], "fdi int").select(nu.region(F.col("fdi")).alias("r"))
    assert [r.r for r in got.collect()] == ["incisor", "incisor", "canine", "premolar", "premolar", "molar", "molar"]


def test_records_of_tooth_tables_are_computed_once(spark):
    """The checks and joins of a tooth table read written records and predictions: no shuffle is made anew for each."""
    from auditframe.plans import evaluation as ev

    for reader in (None, "r1"):
        for rows in ev._read_teeth(spark, "/root/testdata/sf0.001", reader):
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString() and rows.limit(1).count()
