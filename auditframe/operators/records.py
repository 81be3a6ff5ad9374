"""Annotation records: schema, constraints, flattening, JSON and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.numeric import FDI, div, region

BOX = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"
ANNOTATION = f"STRUCT<finding: STRING, annotator_id: STRING, bbox: {BOX}, tooth_fdi: INT, stage: INT, confidence: DOUBLE, meta: MAP<STRING, STRING>>"
RECORD = (
    "image_id STRING, path STRING, patient_id STRING, patient_id_source STRING, dataset STRING, modality STRING, readers ARRAY<STRING>, "
    f"annotations ARRAY<{ANNOTATION}>, site_id STRING, device STRING, age DOUBLE, sex STRING, teeth_present ARRAY<INT>, teeth_present_source STRING, "
    "width INT, height INT, meta MAP<STRING, STRING>"
)
#: Findings, and the stages that each may have. Stage 0 is none, 1-2 enamel, 3-5 dentine and deeper.
FINDINGS = ["healthy", "caries", "deep_caries", "periapical_lesion", "impacted", "other"]


class InvalidRecord(ValueError):
    """A record breaks a constraint."""


def group_key() -> Column:
    return F.concat_ws("/", "dataset", "patient_id")


def flatten(records: DataFrame) -> DataFrame:
    """One row per annotation, with its image and group."""
    return records.select("image_id", group_key().alias("group_key"), F.explode("annotations").alias("a")).select("image_id", "group_key", "a.*")


def findings_by(records: DataFrame, reader: str) -> DataFrame:
    """(image_id, findings) of one reader; images that the reader did not read raise."""
    unread = records.filter(~F.array_contains("readers", reader)).limit(3).collect()
    if unread:
        raise InvalidRecord(f"{reader} did not read e.g. {[r.image_id for r in unread]}")
    own = F.filter("annotations", lambda a: a["annotator_id"] == reader)
    return records.select("image_id", F.array_distinct(F.transform(own, lambda a: a["finding"])).alias("findings"))


def has(records: DataFrame, finding: str, reader: str | None) -> DataFrame:
    """(image_id, has); several readers are not pooled silently."""
    if reader is None:
        if records.filter(F.size("readers") > 1).limit(1).count():
            raise InvalidRecord("several readers: name one, or pool them on purpose")
        return records.select("image_id", F.exists("annotations", lambda a: a["finding"] == finding).alias("has"))
    return findings_by(records, reader).select("image_id", F.array_contains("findings", finding).alias("has"))


def _constraints() -> dict[str, Column]:
    """True where a record breaks the constraint."""
    c, ann = F.col, F.col("annotations")
    any_of = lambda test: F.exists(ann, lambda a: F.coalesce(test(a), F.lit(False)))
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    fdi = F.array(*map(F.lit, FDI))
    box = lambda a: a["bbox"]
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    stage = lambda a: F.coalesce(a["stage"], F.lit(0))
    return {
        "box": any_of(lambda a: box(a).isNotNull() & ~(finite(box(a)["x1"]) & finite(box(a)["y1"]) & finite(box(a)["x2"]) & finite(box(a)["y2"]) & (box(a)["x2"] > box(a)["x1"]) & (box(a)["y2"] > box(a)["y1"]))),
        "annotator": any_of(lambda a: blank(a["annotator_id"])),
        "tooth": any_of(lambda a: a["tooth_fdi"].isNotNull() & ~F.array_contains(fdi, a["tooth_fdi"])),
        "confidence": any_of(lambda a: a["confidence"].isNotNull() & (F.isnan(a["confidence"]) | ~a["confidence"].between(0, 1))),
        "stage": any_of(lambda a: ((a["finding"] == "deep_caries") & stage(a).between(1, 2)) | ((a["finding"] == "healthy") & (stage(a) != 0)) | (~a["finding"].isin("caries", "deep_caries", "healthy") & (stage(a) != 0))),
        "inventory_source": c("teeth_present").isNull() != c("teeth_present_source").isNull(),
        "identity": blank(c("image_id")) | blank(c("path")) | blank(c("patient_id")) | blank(c("dataset")) | c("readers").isNull() | (F.size("readers") == 0),
        "stray_annotator": F.size(F.array_except(F.transform(ann, lambda a: a["annotator_id"]), c("readers"))) > 0,
        "inventory": F.coalesce(F.size(F.array_except("teeth_present", fdi)) > 0, F.lit(False)) | F.coalesce(F.size(F.array_except(F.filter(F.transform(ann, lambda a: a["tooth_fdi"]), lambda t: t.isNotNull()), "teeth_present")) > 0, F.lit(False)),
        "age": F.coalesce(F.isnan("age") | ~c("age").between(0, 120), F.lit(False)),
        "size": F.coalesce((c("width") <= 0) | (c("height") <= 0), F.lit(False)),
    }


def violations(records: DataFrame) -> DataFrame:
    """(name, n) of all constraints, in one scan."""
    found = _constraints()
    one = records.agg(*[F.coalesce(F.sum(F.coalesce(v, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, v in found.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in found])).alias("x")).select("x.*")


def validated(records: DataFrame) -> DataFrame:
    """``records`` if no constraint is broken, else an error with examples."""
    broken = [r.name for r in violations(records).filter("n > 0").collect()]
    if broken:
        test = _constraints()
        examples = {k: [r.image_id for r in records.filter(test[k]).orderBy("image_id").limit(3).collect()] for k in broken}
        raise InvalidRecord(f"invalid records: {examples}")
    return records


def check_inventory(records: DataFrame, min_unflagged: float = 0.2) -> float:
    """Share of inventoried teeth without a finding; an inventory rebuilt from findings has none and raises."""
    flagged = F.array_intersect("teeth_present", F.array_distinct(F.transform("annotations", lambda a: a["tooth_fdi"])))
    one = records.filter("teeth_present IS NOT NULL").agg(F.sum(F.size(flagged)).alias("f"), F.sum(F.size("teeth_present")).alias("n")).first()
    share = 1 - one.f / one.n if one.n else 0.0
    if share < min_unflagged:
        raise InvalidRecord(f"only {share:.1%} of inventoried teeth have no finding: the inventory is not independent")
    return share


def to_json(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct("*")).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", RECORD).alias("r")).select("r.*")


def summary(records: DataFrame) -> DataFrame:
    """One row: counts of images, patients and annotations, and maps of counts by site, finding, stage, source of ids and source of inventories.

    One grouping by patient and one by all that is mapped: the records are read twice, and nothing is joined but single rows.
    """
    lesion = F.filter("annotations", lambda a: a["finding"].isin("caries", "deep_caries"))
    stages = F.transform(lesion, lambda a: F.coalesce(a["stage"].cast("string"), F.lit("unstaged")))
    tag = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))
    one_of = lambda c, none: F.array(F.coalesce(c, F.lit(none)))
    tags = F.concat(
        tag("site_id", F.array_compact(F.array(F.col("site_id")))), tag("finding", F.transform("annotations", lambda a: a["finding"])), tag("stage", stages),
        tag("id_source", one_of(F.col("patient_id_source"), "none")), tag("inventory", one_of(F.col("teeth_present_source"), "none")),
    )
    counted = records.select(F.explode(tags).alias("t")).groupBy("t").agg(F.count("*").alias("c")).select("t.kind", "t.name", "c")
    as_map = lambda kind: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "c")))))).alias(f"by_{kind}")
    maps = counted.agg(*[as_map(k) for k in ("site_id", "finding", "stage", "id_source", "inventory")])
    per_patient = records.groupBy(group_key().alias("g")).agg(F.count("*").alias("k"), F.sum(F.size("annotations")).alias("n"), F.count_if(F.size("readers") > 1).alias("r"))
    one = per_patient.agg(
        F.sum("k").alias("n_images"), F.sum("n").cast("long").alias("n_annotations"), F.sum("r").alias("n_multi_reader"), F.count("*").alias("n_patients"), F.max("k").alias("max_images"),
        (F.sum("k") / F.count("*")).alias("images_per_patient"),
    )
    return one.join(maps)


def region_crosstab(records: DataFrame) -> DataFrame:
    """(finding, region, n, share): findings by part of the mouth, with the share of each part in its finding."""
    rows = flatten(records).groupBy("finding", region(F.col("tooth_fdi")).alias("region")).agg(F.count("*").alias("n"))
    total = rows.groupBy("finding").agg(F.sum("n").alias("total"))
    return rows.join(total, "finding").select("finding", "region", "n", div(F.col("n"), F.col("total")).alias("share"))


def per_image(records: DataFrame) -> DataFrame:
    """(what, median, largest, without): findings and inventoried teeth of an image; images without an inventory count for findings only."""
    each = F.array(F.struct(F.lit("findings").alias("what"), F.size("annotations").alias("n")), F.struct(F.lit("teeth").alias("what"), F.when(F.col("teeth_present").isNotNull(), F.size("teeth_present")).alias("n")))
    sizes = records.select(F.explode(each).alias("x")).select("x.*").filter("n IS NOT NULL")
    return sizes.groupBy("what").agg(F.percentile("n", 0.5).alias("median"), F.max("n").alias("largest"), F.count_if(F.col("n") == 0).alias("without"))


def from_readings(units: DataFrame, readings: DataFrame, teeth: bool = False) -> DataFrame:
    """Records of the fixtures: an annotation per reader and unit with a lesion; with ``teeth`` (``fdi`` of both tables) its tooth and an inventory."""
    tooth = F.col("fdi") if teeth else F.lit(None).cast("int")
    note = F.struct(F.col("uid"), F.col("rater"), F.col("grade"), tooth.alias("fdi"))
    lists = readings.groupBy("image_id").agg(F.array_sort(F.collect_set("rater")).alias("readers"), F.array_sort(F.collect_list(F.when(F.col("grade") > 0, note))).alias("notes"))
    null = lambda kind: F.lit(None).cast(kind)
    shallow = lambda a: a["grade"] == 1
    plain = F.transform("notes", lambda a: F.struct(
        F.when(shallow(a), "caries").otherwise("deep_caries").alias("finding"), a["rater"].alias("annotator_id"), null(BOX).alias("bbox"), a["fdi"].alias("tooth_fdi"),
        F.when(shallow(a), 1).otherwise(4).alias("stage"), F.lit(1.0).alias("confidence"), null("map<string,string>").alias("meta"),
    ))
    images = units.groupBy("image_id").agg(F.min("site").alias("site_id"), F.min("age").alias("age"), F.min("sex").alias("sex"), F.min("group_key").alias("patient_id"), (F.sort_array(F.collect_set("fdi")) if teeth else F.lit(None).cast("array<int>")).alias("inventory"))
    rows = images.join(lists, "image_id")
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "image_id", F.concat(F.lit("/x/"), "image_id", F.lit(".png")).alias("path"), "patient_id", F.lit("provided").alias("patient_id_source"), F.lit("ds").alias("dataset"), F.lit("bitewing").alias("modality"),
        "readers", plain.alias("annotations"), "site_id", none("string").alias("device"), F.when(F.col("age") <= 120, F.col("age")).alias("age"), "sex", F.col("inventory").alias("teeth_present"),
        (F.lit("annotated") if teeth else none("string")).alias("teeth_present_source"), none("int").alias("width"), none("int").alias("height"), none("map<string,string>").alias("meta"),
    )
