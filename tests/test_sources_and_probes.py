"""Annotation files, archives, probes, models and the streaming extension."""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from auditframe.operators import probes as pr
from auditframe.sources import annotation_files as af
from auditframe.streaming import leakage_monitor as lm

CATS = {
    "categories_1": [{"id": i, "name": n} for i, n in enumerate("2143")], "categories_2": [{"id": i, "name": str(8 - i)} for i in range(8)],
    "categories_3": [{"id": 0, "name": "Impacted"}, {"id": 1, "name": "Caries"}, {"id": 2, "name": "Deep Caries"}],
}


def coco(spark, tmp_path, **change):
    data = {
        "images": [{"id": 1, "file_name": "a.png", "height": 5, "width": 6}, {"id": 2, "file_name": "b.png", "height": 5, "width": 6}],
        "annotations": [{"id": 7, "image_id": 1, "bbox": [1, 2, 3, 4], "category_id_1": 0, "category_id_2": 2, "category_id_3": 1}], **CATS, **change,
    }
    (tmp_path / "a.json").write_text(json.dumps(data, indent=1))
    return af.documents(spark, str(tmp_path / "a.json"))


def test_coco_ids_mean_their_names(spark, tmp_path):
    rows = {r.file_name: r.findings for r in af.read_coco(coco(spark, tmp_path)).collect()}
    assert rows["b.png"] == [] and [(f.finding, f.fdi, f.box.asDict()) for f in rows["a.png"]] == [("caries", 26, {"x1": 1, "y1": 2, "x2": 4, "y2": 6})]
    assert [(r.file_name, r.fdi) for r in af.read_enumeration(coco(spark, tmp_path)).collect()] == [("a.png", 26)]


def test_coco_refuses_other_names(spark, tmp_path):
    with pytest.raises(af.UnreadableAnnotation, match="categories_1"):
        af.read_coco(coco(spark, tmp_path, categories_1=[{"id": 0, "name": "upper left"}])).collect()


def test_labelme(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"shapes": [{"label": "3-deep caries-26"}]}))
    assert [tuple(r)[1:] for r in af.read_labelme(af.documents(spark, str(tmp_path / "l.json"))).collect()] == [(3, "deep caries", 26)]
    (tmp_path / "m.json").write_text(json.dumps({"shapes": [{"label": "caries 26"}]}))
    with pytest.raises(af.UnreadableAnnotation):
        af.read_labelme(af.documents(spark, str(tmp_path / "m.json")))


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in (("xray/a.png", b"one"), ("xray/b.png", b"one"), ("xray/deep/c.png", b"two"), ("xray/d.txt", b"x")):
            z.writestr(name, data)
    (tmp_path / "r.zip").write_bytes(buffer.getvalue())
    members = af.archive_members(spark, str(tmp_path / "r.zip"), "xray/")
    assert sorted((r.member, r.size) for r in members.collect()) == [("a.png", 3), ("b.png", 3)]
    path = f"file://{tmp_path}/store"
    assert af.store_content(members, path).count() == 1 and af.store_content(members, path).count() == 1
    assert af.new_members(members, members.limit(1)).count() == 1
    listing = af.archive_listing(spark, str(tmp_path / "r.zip"), "xray/")
    assert af.new_members(listing, listing.withColumn("crc", F.col("crc") + 1)).count() == 2
    import hashlib

    assert {r.sha for r in af.read_members(listing, content=False).collect()} == {hashlib.sha256(b"one").hexdigest()}
    with pytest.raises(Exception, match="not what its digest says"):
        af.store_content(members.withColumn("content", F.lit(b"changed")), f"file://{tmp_path}/other")
    with pytest.raises(ValueError, match="checksum"):
        af.verified(spark.read.format("binaryFile").load(str(tmp_path / "r.zip")), {"r.zip": "0"})


def test_mixture_separates_two_modes(spark):
    two = spark.range(3000).select((F.when(F.col("id") % 10 == 0, 0.9).otherwise(0.4) + (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 - 0.5) * 0.1).alias("x"))
    fit = pr.fit_mixture(two, "x")
    assert fit.separated and 0.45 < fit.crossing() < 0.88 and abs(fit.high.share - 0.1) < 0.02 and fit.distance > 4
    one = spark.range(3000).select((sum((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0 for k in range(6)), F.lit(0.0)) / 6).alias("x"))
    assert not pr.fit_mixture(one, "x").separated


def blobs(spark, n=90):
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    site = (F.col("id") % 3).cast("int")
    v = F.array(*[F.when(site == k, 6.0).otherwise(0.0) + noise(k) for k in range(3)])
    return spark.range(n).select("id", site.alias("site"), F.floor(F.col("id") / 3).cast("int").alias("group_no"), v.alias("v"))


def test_sites_are_found(spark):
    found = pr.cluster_sites(blobs(spark), 1, ks=range(2, 5), restarts=2)
    assert found["best_k"] == 3 and found["clean"] and found["silhouette"][3] > 0.7


def test_site_probe_and_head(spark):
    rows = blobs(spark)
    assert pr.macro_auc(pr.site_probe(rows, n_splits=3), 3) == 1.0
    assert pr.macro_auc(pr.site_probe(rows, n_splits=3).filter("site < 2"), 3) is None
    model, strength = pr.fit_head(pr.standardised(rows).withColumn("y", F.col("site").cast("double")), n_splits=2)
    assert model.numClasses == 3 and strength in (0.1, 0.01, 0.001)


def test_leakage_monitor(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("p1", "train", "i1", at), ("p2", "train", "i2", at), ("p1", "test", "i3", at), ("p1", "test", "i4", at)]
    spark.createDataFrame(rows, "group_key string, partition string, image_id string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("group_key string, partition string, image_id string, ts timestamp").parquet(f"{tmp_path}/in")
    query = lm.monitor(stream).writeStream.format("memory").queryName("flags").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("flags").collect()] == [("p1", "train", "test", "i3")]


def test_monitor_state_ends(spark, tmp_path):
    schema = "group_key string, partition string, image_id string, ts timestamp"
    days = [[("p1", "train", "i1", 0)], [("p2", "train", "x", 40)], [("p2", "train", "y", 41)], [("p1", "test", "i3", 42)]]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = None
    for k, rows in enumerate(days):  # p1 is forgotten once the watermark has passed its ten days
        spark.createDataFrame([(*r[:3], dt.datetime(2024, 1, 1) + dt.timedelta(days=r[3])) for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if query is None:
            query = lm.monitor(stream, ttl_seconds=10 * 86400).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
    query.stop()
    assert spark.table("forgotten").count() == 0


def test_release_loader(spark):
    index = spark.createDataFrame([("diag", "a", "s1"), ("diag", "b", "s2"), ("diag", "c", "s3"), ("enum", "a", "s1"), ("enum", "x", "s2"), ("enum", "y", "s2"), ("test", "t", "s3")], "subset string, file string, sha string")
    notes = spark.createDataFrame([(f, [f"n{f}"]) for f in "abc"], "file string, annotations array<string>")
    boxes = spark.createDataFrame([("a", 11), ("a", 21), ("x", 11), ("y", 12)], "file string, fdi int")
    images, conflicts = af.load_release(notes, boxes, index, "diag", "enum", ["test"])
    got = {r.file: (r.teeth_present, r.copies_in, r.training_copies) for r in images.collect()}
    assert got == {"a": ([11, 21], ["enum"], ["enum"]), "b": (None, ["enum"], ["enum"]), "c": (None, ["test"], [])}
    assert [r.sha for r in conflicts.collect()] == ["s2"]
    with pytest.raises(af.UnreadableAnnotation, match="not in the release"):
        af.load_release(notes, boxes, index.filter("file <> 'c'"), "diag", "enum")


def test_drift(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(at + dt.timedelta(minutes=40 * i), 0.5, i % 2) for i in range(6)], "ts timestamp, p double, y int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, p double, y int").parquet(f"{tmp_path}/in")
    query = lm.drift(stream).writeStream.format("memory").queryName("drift").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("drift").collect()) == [1, 1, 2, 2]
