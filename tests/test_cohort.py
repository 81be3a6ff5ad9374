from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from auditframe.operators import diagnostics as dg
from auditframe.operators import records as rc
from auditframe.operators.storage import materialised
from auditframe.plans import cohort, report, study
from auditframe.sources import generators as ge


@pytest.fixture(scope="module")
def inputs(spark):
    inner, outer = ge.synthetic_inputs(spark, 7, 50, 20, external_demographics=False)
    kept = lambda x: ge.Inputs(*map(materialised, (x.records, x.predictions, x.detections)))
    return kept(inner), kept(outer)


def test_generated_records(spark, inputs):
    rows = ge.make_records(spark, 30, seed=3, staged=0.5)
    for records in (rows, inputs[0].records, inputs[1].records):
        assert rc.validated(records).count() > 0
    assert rows.groupBy("patient_id").agg(F.count_distinct("site_id").alias("n")).filter("n > 1").count() == 0
    lesions = rc.flatten(rows)
    assert 0 < lesions.filter("stage IS NULL").count() < lesions.count()
    again = ge.make_records(spark, 30, seed=3, staged=0.5).repartition(7)
    as_json = lambda x: sorted(r[0] for r in rc.to_json(x).collect())
    assert as_json(rows) == as_json(again) != as_json(ge.make_records(spark, 30, seed=4, staged=0.5))
    assert inputs[1].records.filter("age IS NOT NULL OR sex IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        ge.make_records(spark, 2, per_patient=(3, 1))


def test_memorised_groups_score_better(spark):
    """Where the model was trained it separates sound from lesion teeth almost fully; elsewhere it does not."""
    inner = ge.make_reader_study(spark, 60, 5)
    known = inner.truth.select("group_key").distinct().filter(F.xxhash64("group_key") % 2 == 0)
    rows = ge.simulate_model(inner, ge.INTERNAL, 5, known)[0].join(inner.truth.select("image_id", "tooth_fdi", "level", "group_key"), ["image_id", "tooth_fdi"])
    rows = rows.join(known.withColumn("known", F.lit(True)), "group_key", "left")
    wrong = (F.col("level") > 0) != (1 - F.col("probs")[0] > 0.5)
    rate = {r.known: r.w for r in rows.groupBy("known").agg(F.avg(wrong.cast("double")).alias("w")).collect()}
    assert rate[True] < 0.01 < rate[None]
    assert rows.filter(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0


def test_study_of_records(spark, inputs, tmp_path):
    tables = cohort.evaluate_inputs(*inputs, study.Study(n_boot=20))
    assert tables["leakage"].first().leaked_groups == 0 < tables["naive_leakage"].first().leaked_groups
    for name in ("headline_gap", "headline_drop", "internal_ceiling", "internal_krippendorff", "internal_detection_r1", "external_detection_r4", "internal_calibration", "external_selective"):
        assert tables[name].count() > 0, name
    reasons = {(r.scope, r.metric) for r in tables["ledger"].collect()}
    # An incomplete design has no Fleiss' kappa, and the external set no demographics.
    assert {("internal", "fleiss"), ("external", "subgroups by age"), ("external", "subgroups by sex")} <= reasons and "internal_fleiss" not in tables
    text = report.render_study(tables, "Study", "simulated")
    assert text.count("> simulated") > 10 and text.index("## Split") < text.index("## Claim") < text.index("## Not computable")
    manifest = report.write(str(tmp_path), text, report.figures(tables))
    assert json.loads((tmp_path / "manifest.json").read_text()) == manifest and "internal_sweep.svg" in manifest


def test_one_reader_and_missing_inventories(spark, inputs):
    one = inputs[0].records
    alone = one.withColumn("readers", F.array(F.lit("r1"))).withColumn("annotations", F.filter("annotations", lambda a: a["annotator_id"] == "r1"))
    bare = alone.withColumn("teeth_present", F.when(F.col("image_id") > "synthetic-p0002", F.col("teeth_present"))).withColumn("teeth_present_source", F.when(F.col("image_id") > "synthetic-p0002", F.lit("annotated")))
    ledger = cohort.Ledger()
    part = ge.Inputs(bare, inputs[0].predictions, inputs[0].detections)
    units = cohort.teeth(part, "internal", ledger)
    assert cohort.agreement(part, units, 0.3, study.Study(n_boot=20), "internal", ledger) == {}
    assert [r[1] for r in ledger.rows] == ["tooth-level metrics", "agreement"]


def test_settings_file(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"seed": 4, "box_score": "operating_point", "iou": 0.4}')
    cfg = study.Study.from_file(str(path))
    assert (cfg.seed, cfg.box_score, cfg.iou) == (4, None, 0.4)


def test_verdicts():
    assert dg.verdicts((0.1, 0.2), (-0.1, 0.1), 50, 2) == {"depth": "imbalance", "detection": "imbalance"}
    assert dg.verdicts((-0.1, 0.2), (-0.2, -0.1), 50, 20) == {"depth": "called", "detection": "difficulty"}
    assert dg.verdicts((None, None), (-0.2, 0.1), 50, 20)["detection"] == "unresolved"
    assert dg.verdicts((0.1, 0.2), (0.0, 0.1), 0, 0)["detection"] == "no deep lesions"
