from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.functions import draws
from auditframe.functions.numeric import uniform
from auditframe.plans import report, study


@pytest.fixture(scope="module")
def units(spark):
    rows = spark.range(1200).select(F.col("id").cast("string").alias("uid"), F.concat(F.lit("i"), F.floor(F.col("id") / 3).cast("string")).alias("image_id"), F.concat(F.lit("g"), (F.floor(F.col("id") / 3) % 90).cast("string")).alias("group_key"))
    rows = rows.withColumn("level", F.when(uniform(F.concat(F.lit("l"), "uid")) < 0.7, 0).when(uniform(F.concat(F.lit("m"), "uid")) < 0.5, 1).otherwise(2))
    return rows.withColumn("p_lesion", 0.1 + 0.25 * F.col("level") + 0.3 * uniform(F.concat(F.lit("p"), "uid"))).withColumn("age", F.lit(None).cast("double"))


def test_study_and_report(spark, units):
    cfg = study.Study(n_boot=40)
    tables = study.evaluate(units, units.filter("level < 2 OR uid > '5'"), cfg)
    text = report.render(tables, "Study", "synthetic data")
    assert "## Rates by level" in text and "no age on any unit" in text and "specificity" in text and "| train |" in text
    assert tables["leakage"].first().leaked_groups == 0
    assert "external" in report.render(study.evaluate(units, None, cfg), "Study")
    naive = study.evaluate(units, None, study.Study(n_boot=40, split="image_naive"))
    assert naive["leakage"].first().leaked_groups > 0


def test_tripwire(spark):
    rows = spark.createDataFrame([("a", 0.95), ("b", 0.96), ("c", 0.97)], "statistic string, value double")
    sizes = spark.createDataFrame([("b", 19)], "statistic string, n long")
    assert {r.statistic: r.kind for r in study.tripwire(rows, sizes).collect()} == {"b": "small cell", "c": "flag"}


def test_calibration_noise(spark, units):
    rows = units.select("uid", "group_key", F.col("p_lesion").alias("p"), (uniform(F.concat(F.lit("y"), "uid")) < F.col("p_lesion")).cast("int").alias("y"))
    floor = study.noise_floor(rows, 50).first().floor
    assert 0.02 < floor < 0.08
    got = study.ece_interval(rows, 1, 40).first()
    assert 0 < got.lo < got.hi < 0.2 and got.n_valid == 40


def test_settings(spark):
    assert study.Study.from_json('{"seed": 3, "split": "image_naive"}').seed == 3
    for bad in ({"split": "site"}, {"alpha": 2}, {"speed": 1}, {"fractions": {"a": 1.0}}):
        with pytest.raises(ValueError):
            study.Study.from_mapping(bad)


def test_small_tables_only(spark):
    with pytest.raises(ValueError):
        report.markdown_table(spark.range(2000))
    assert "<svg" in report.svg_line([(0, 0), (1, 1)], "x")


def test_resamples_are_those_of_the_reference():
    import inspect

    from auditframe.operators import probes
    from auditframe.plans import audit, evaluation

    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert audit.N_BOOT == evaluation.N_BOOT == 2000
    assert (default(study.noise_floor, "n_sim"), default(study.ece_interval, "n_boot"), default(probes.cluster_sites, "restarts")) == (1000, 2000, 10)


def test_noise_floor_hashes_in_arrays(spark):
    """Against draws one by one; no row is made for a draw (the code before exploded each row into its simulations)."""
    rows = [(u, p, 0) for u, p in zip([None, "", "é", "x" * 60, *map(str, range(196))], [None, 0.5, 0.25, 0.000001, *[k / 195 for k in range(196)]])]
    found = study.noise_floor(spark.createDataFrame(rows, "uid string, p double, y int"), 120, 4, seed=7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    known = sorted(p for _, p, _ in rows if p is not None)
    edges = [np.percentile(known, 100 * k / 4) for k in range(1, 4)]
    errors = []
    for b in range(120):
        gaps = [0.0] * 4
        for u, p, _ in rows:
            if p is not None:
                text = f"nf:7:{b}" + ("" if u is None else f":{u}")
                draw = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 1_000_000 / 1_000_000
                gaps[sum(e <= p for e in edges)] += p - (draw < p)
        errors.append(sum(map(abs, gaps)) / len(rows))
    assert abs(found.first().floor - np.percentile(errors, 95)) < 1e-12


def test_draws_of_many_texts():
    for size in (0, 1, 5, 50, 51, 60, 130):
        tails = [bytes((31 * i + 7 * j) % 256 for j in range(size)) for i in range(9)]
        for first, heads in draws.numbered(112, "9:{}"):
            for (k, lo), got in draws.digests(heads, np.frombuffer(b"".join(tails), np.uint8).reshape(9, size)):
                want = [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails[lo : lo + got.shape[1]]] for h in heads[k : k + got.shape[0]]]
                assert got.tolist() == want
