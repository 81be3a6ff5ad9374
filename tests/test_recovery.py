"""Hidden groups and sites: links, gates, tests and verdicts."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.functions.numeric import p_of_chi_square, p_of_z
from auditframe.operators import dedup as dd
from auditframe.operators import mapping as mp
from auditframe.operators import probes as pr
from auditframe.operators import recovery as rv


def vectors(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")


@pytest.mark.parametrize("rows", [7, 1000])
def test_nearest_and_links_are_exact(spark, rows):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)) + 3
    c = v - v.mean(0)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    cos = c @ c.T
    unit = rv.centred(vectors(spark, v))
    near = {r.id: r.cosine for r in rv.nearest_cosine(unit, rows).collect()}
    np.fill_diagonal(cos, -np.inf)
    assert all(abs(near[i] - cos[i].max()) < 1e-9 for i in range(60)) and len(near) == 60
    links = {(r.a, r.b) for r in rv.cosine_links(unit, 0.8, rows).collect()}
    assert links == {(i, j) for i in range(60) for j in range(i + 1, 60) if cos[i, j] >= 0.8}


def test_single_items_and_constant_vectors(spark):
    assert rv.nearest_cosine(rv.centred(vectors(spark, [[1, 2]]))).count() == 0
    assert rv.centred(vectors(spark, [[1, 2], [1, 2]])).count() == 0


def test_groups_are_recovered_from_both_signals(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 24))
    v = np.concatenate([base, base[:50] + rng.normal(size=(50, 24)) * 0.15])
    sigs = [random.Random(i).getrandbits(63) for i in range(200)]
    sigs[149] = sigs[148] ^ 1
    signatures = spark.createDataFrame(list(enumerate(sigs)), "id long, sig long")
    labels, fit, cut = rv.recovered(signatures, vectors(spark, v))
    got = {r.id: r.label for r in labels.collect()}
    assert fit.separated and fit.low.centre < cut < fit.high.centre
    assert all(got[150 + i] == i for i in range(50)) and got[149] == got[148] == 148 and set(got) == {*range(50), *range(150, 200), 148, 149}
    records = spark.createDataFrame([(i, f"p{i}", "provided") for i in range(200)], "image_id long, patient_id string, patient_id_source string")
    new = {r.image_id: (r.patient_id, r.patient_id_source) for r in rv.derived_ids(records, labels).collect()}
    assert new[150] == new[0] == ("recovered-0", "derived") and new[120] == ("p120", "provided")


def test_crossing_is_where_both_modes_are_equally_dense():
    for low, high in (((0.8, 0.4, 0.1), (0.2, 0.9, 0.02)), ((0.5, 0.0, 1.0), (0.5, 4.0, 1.0)), ((0.1, 0.5, 0.2), (0.9, 0.95, 0.01))):
        a, b = pr.Normal(*low), pr.Normal(*high)
        x = pr.Mixture((0.0, -1.0), a, b).crossing()
        dense = lambda m, x: m.share * math.exp(-((x - m.centre) ** 2) / (2 * m.spread**2)) / m.spread
        assert a.centre < x < b.centre and abs(dense(a, x) / dense(b, x) - 1) < 1e-6 and dense(b, x + 1e-3) > dense(a, x + 1e-3)


def test_gates(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "id long, grp string")
    with pytest.raises(rv.RecoveryError, match=r"\(3, 4\)"):
        rv.duplicate_gate(pairs, groups)
    rv.duplicate_gate(pairs.filter("a = 1"), groups)
    rv.adds_nothing(pairs, pairs.filter("a = 1"))
    with pytest.raises(rv.RecoveryError, match="second representation"):
        rv.adds_nothing(pairs.filter("a = 1"), pairs)


def test_near_copies_by_subset(spark):
    rng = random.Random(3)
    sigs = {i: rng.choice([0, 1, 3, 1 << 50, (1 << 50) - 1, 255 << 8]) for i in range(25)}
    index = [(f"s{rng.randint(0, 3)}", i) for i in range(25) for _ in range(rng.randint(1, 2))]
    signatures = spark.createDataFrame(list(sigs.items()), "id long, sig long")
    places = spark.createDataFrame(index, "subset string, id long")
    links = rv.reencoded(dd.near_pairs(signatures, 6), dd.members(signatures), places)
    near = lambda x, y: x != y and bin(sigs[x] ^ sigs[y]).count("1") <= 6
    want = {(x, t) for x in sigs for t, y in index if near(x, y)}
    assert {tuple(r) for r in links.collect()} == want
    matrix = {(r.subset, r.other): r.n for r in rv.reencoded_matrix(links, places).collect()}
    assert matrix == {k: n for k in {(s, t) for s, x in index for z, t in want if z == x} if (n := len({x for s, x in index if s == k[0] and (x, k[1]) in want}))}
    copies = {r.subset: (r.n, r.copies) for r in rv.any_copy(links, places).collect()}
    for s in copies:
        own = {x for t, x in index if t == s}
        assert copies[s] == (len(own), sum(any(t != s and (y == x or near(x, y)) for t, y in index) for x in own))


def test_partner_in_train_and_disagreement(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, label long")
    homes = spark.createDataFrame([(1, "test"), (2, "train"), (3, "test"), (4, "test"), (5, "test")], "id long, partition string")
    assert rv.partner_in_train(labels, homes).first().asDict() == {"n_test": 4, "with_partner": 1}
    inventories = spark.createDataFrame([("a", [1, 2]), ("a", [2, 1, 1]), ("b", [1]), ("b", [2])], "id string, teeth array<int>")
    assert [tuple(r) for r in rv.disagreeing(inventories).collect()] == [("b", 2)]
    index = spark.createDataFrame([("x", "s"), ("y", "s"), ("x", "t")], "subset string, id string")
    notes = spark.createDataFrame([("x", "s", "11: caries"), ("y", "s", "26"), ("y", "s", "21")], "subset string, id string, label string")
    assert [tuple(r) for r in rv.side_by_side(notes, index, "x", "y").collect()] == [("s", ["11: caries"], ["21", "26"])]


def test_p_values():
    # Published table values of the 5 % points.
    for df, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (7, 14.06714), (10, 18.30704)):
        assert abs(p_of_chi_square(x, df) - 0.05) < 1e-6
    assert p_of_chi_square(0, 3) == 1 and abs(p_of_z(1.959964) - 0.05) < 1e-6


def test_selection_check(spark):
    rows = [(f"i{i}", f"g{i}", i % 3, float(i % 17) + (30 if i % 4 == 0 else 0), i % 5 == 0) for i in range(240)]
    data = spark.createDataFrame(rows, "image_id string, group_key string, cluster int, width double, caries boolean")
    tests, differs = rv.selection_check(data, F.pmod(F.regexp_extract("image_id", "i(.*)", 1).cast("int"), F.lit(4)) == 0, ["width"], ["caries"], 1, 100)
    assert differs and tests[0]["p"] < 1e-6 and tests[0]["selected"] > 30 > tests[0]["rest"] and tests[1]["p"] > 0.9 and tests[2]["lo"] < 0 < tests[2]["hi"]
    tests, differs = rv.selection_check(data, F.pmod(F.xxhash64("image_id"), F.lit(2)) == 0, ["width"], ["caries"], 1, 100)
    assert not differs


def test_verdicts(spark):
    assert rv.shortcut_risk(0.6, 0.01) and not rv.shortcut_risk(0.5, 0.01) and not rv.shortcut_risk(0.9, 0.2) and not rv.shortcut_risk(None, 0.01)
    same, other = vectors(spark, [[1, 2], [3, 4]]), vectors(spark, [[1, 2], [3, 5]])
    rv.not_circular(same, other)
    with pytest.raises(ValueError, match="clustered by"):
        rv.not_circular(same, same)


def test_rules_of_differences(tmp_path):
    rules = mp.Rules([mp.Rule("d", {"x": ["1"]}, report_as="delta"), mp.Rule("u", {"x": ["2"]}, verified=False, report_as="delta"), mp.Rule("v", {"x": ["3"]})])
    assert rules.checked_delta("d") == "d"
    for bad in ("u", "v", "w"):
        with pytest.raises(ValueError):
            rules.checked_delta(bad)
    (tmp_path / "r.json").write_text('{"version": "1.0.0", "axes": ["x"], "rules": [{"target": "d", "conditions": {"x": ["1"]}}]}')
    (tmp_path / "r.yaml").write_text("version: 1.0.0\naxes: [x]\nrules:\n- target: d\n  conditions: {x: ['1']}\n")
    pytest.importorskip("yaml")
    assert mp.read_rules(str(tmp_path / "r.json")) == mp.read_rules(str(tmp_path / "r.yaml"))
    (tmp_path / "b.json").write_text('{"version": "1.0.0", "rules": [{"target": "d", "if": {}}]}')
    with pytest.raises(ValueError, match="unknown entries"):
        mp.read_rules(str(tmp_path / "b.json"))
