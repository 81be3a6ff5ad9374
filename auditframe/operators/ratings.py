"""Ratings and reference tables from annotation records, unit by unit.

A unit is a tooth of an image's inventory. A reader who read an image and marked nothing on a tooth graded it 0; a
reader who did not read the image has no row. What cannot be a unit raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.operators.agreement import consensus
from auditframe.operators.records import InvalidRecord, check_inventory, group_key

Grade = Callable[[Column], Column]


def by_depth(a: Column) -> Column:
    """Grade of an annotation on the depth scale: healthy 0, caries 1, deep caries 2; NULL if it is not on the scale."""
    return F.when(a["finding"] == "caries", 1).when(a["finding"] == "deep_caries", 2).when(a["finding"] == "healthy", 0)


def by_stage(a: Column) -> Column:
    """Grade on the stage scale: the stage of a carious lesion, healthy 0. A lesion without a stage is an error."""
    lesion = a["finding"].isin("caries", "deep_caries")
    missing = F.raise_error(F.concat(F.lit("without a stage, not on this scale: "), a["finding"])).cast("int")
    return F.when(lesion & a["stage"].isNull(), missing).when(lesion, a["stage"]).when(a["finding"] == "healthy", 0)


def unit_id(image_id: Column, fdi: Column) -> Column:
    return F.concat_ws("#", image_id, fdi.cast("string"))


def all_readers(records: DataFrame) -> list[str]:
    """Names of everyone who read a record, sorted: a handful."""
    return [r[0] for r in records.select(F.explode("readers")).distinct().orderBy("col").collect()]


def restrict(rows: DataFrame, images: DataFrame) -> DataFrame:
    """``rows`` (predictions, detections) of the selected images."""
    return rows.join(images.select("image_id").distinct(), "image_id", "left_semi")


def inventoried(records: DataFrame) -> tuple[DataFrame, dict]:
    """Records with an inventory, and a note of how many have none; none at all is an error."""
    n = records.agg(F.count("*").alias("n"), F.count("teeth_present").alias("kept")).first()
    if not n.kept:
        raise InvalidRecord("no record has a tooth inventory: there are no tooth-level units")
    return records.filter("teeth_present IS NOT NULL"), {"kept": n.kept, "excluded": n.n - n.kept}


def _examples(rows: DataFrame, column: str) -> list:
    return [r[0] for r in rows.select(column).orderBy(column).limit(3).collect()]


def tooth_ratings(records: DataFrame, grade: Grade = by_depth, min_unflagged: float = 0.2) -> DataFrame:
    """(uid, image_id, tooth_fdi, group_key, rater, grade): the worst grade of each tooth by each reader of its image."""
    bare = _examples(records.filter("teeth_present IS NULL"), "image_id")
    if bare:
        raise InvalidRecord(f"no tooth inventory in e.g. {bare}: tooth-level units cannot be formed")
    placeless = records.filter(F.exists("annotations", lambda a: a["tooth_fdi"].isNull() & (F.coalesce(grade(a), F.lit(0)) > 0)))
    if found := _examples(placeless, "image_id"):
        raise InvalidRecord(f"a lesion without a tooth number in e.g. {found}")
    check_inventory(records, min_unflagged)
    rows = records.select("image_id", group_key().alias("group_key"), F.explode("teeth_present").alias("tooth_fdi"), "readers", "annotations")
    rows = rows.select("image_id", "group_key", "tooth_fdi", F.explode("readers").alias("rater"), "annotations")
    # The annotations of a tooth are in the record of its image: no join.
    own = F.filter("annotations", lambda a: (a["annotator_id"] == F.col("rater")) & (a["tooth_fdi"] == F.col("tooth_fdi")))
    worst = F.coalesce(F.array_max(F.transform(own, grade)), F.lit(0))
    return rows.select(unit_id(F.col("image_id"), F.col("tooth_fdi")).alias("uid"), "image_id", "tooth_fdi", "group_key", "rater", worst.cast("int").alias("grade"))


def image_ratings(records: DataFrame, grade: Grade = by_depth) -> DataFrame:
    """(uid, image_id, group_key, rater, grade): the worst grade anywhere in the image by each of its readers, 0 if none."""
    rows = records.select("image_id", group_key().alias("group_key"), F.explode("readers").alias("rater"), "annotations")
    own = F.filter("annotations", lambda a: a["annotator_id"] == F.col("rater"))
    worst = F.coalesce(F.array_max(F.transform(own, grade)), F.lit(0))
    return rows.select(F.col("image_id").alias("uid"), "image_id", "group_key", "rater", worst.cast("int").alias("grade"))


def covered(units: DataFrame, predictions: DataFrame, categories: int) -> DataFrame:
    """``units`` (uid, image_id, tooth_fdi, ...) with their ``probs``; each unit needs exactly one prediction, and each prediction a unit."""
    rows = predictions.select(unit_id(F.col("image_id"), F.col("tooth_fdi")).alias("uid"), "probs")
    total = F.aggregate("probs", F.lit(0.0), lambda s, p: s + p)
    wrong = (F.size("probs") != categories) | F.exists("probs", lambda p: p.isNull() | F.isnan(p) | (p < 0)) | (F.abs(total - 1) > 1e-6)
    if examples := _examples(rows.filter(F.coalesce(wrong, F.lit(True))), "uid"):
        raise ValueError(f"not probabilities of the scale: e.g. {examples}")
    marked = units.select("uid", F.lit(0).alias("p"), F.lit(1).alias("u")).unionByName(rows.select("uid", F.lit(1).alias("p"), F.lit(0).alias("u")))
    both = marked.groupBy("uid").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    problems = {"predicted twice": F.col("p") > 1, "without a prediction": F.col("p") == 0, "predicted, but not in the inventory": F.col("u") == 0}
    found = both.agg(*[F.min(F.when(test, F.col("uid"))).alias(what) for what, test in problems.items()]).first()
    for what in problems:
        if found[what] is not None:
            raise ValueError(f"{what}: e.g. {[found[what]]}")
    return units.join(rows, "uid")


def tooth_table(records: DataFrame, predictions: DataFrame, grade: Grade = by_depth, categories: int = 3, reader: str | None = None) -> DataFrame:
    """One row for each tooth: (uid, image_id, tooth_fdi, group_key, site, age, sex, reference, probs).

    The reference is the grade of one ``reader``, or the consensus of all who read the image.
    """
    ratings = tooth_ratings(records, grade)
    if reader is None:
        reference = consensus(ratings, 1).select("uid", F.col("grade").alias("reference"))
    else:
        unread = _examples(records.filter(~F.array_contains("readers", reader)), "image_id")
        if unread:
            raise InvalidRecord(f"{reader} did not read e.g. {unread}")
        reference = ratings.filter(F.col("rater") == reader).select("uid", F.col("grade").alias("reference"))
    rows = records.select("image_id", group_key().alias("group_key"), F.col("site_id").alias("site"), "age", "sex", F.explode("teeth_present").alias("tooth_fdi"))
    units = rows.select(unit_id(F.col("image_id"), F.col("tooth_fdi")).alias("uid"), "image_id", "tooth_fdi", "group_key", "site", "age", "sex")
    return covered(units, predictions, categories).join(reference, "uid").select(*units.columns, "reference", "probs")


def p_lesion(probs: Column) -> Column:
    return 1 - probs[0]


def aligned(ratings: DataFrame, model: DataFrame) -> DataFrame:
    """``ratings`` with the model's grade ``m``; ``model``: (uid, m), one row for each rated unit."""
    lacking = _examples(ratings.select("uid").distinct().join(model, "uid", "left_anti"), "uid")
    if lacking:
        raise ValueError(f"units without a grade of the model: e.g. {lacking}")
    if twice := _examples(model.groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1"), "uid"):
        raise ValueError(f"units with several grades of the model: e.g. {twice}")
    return ratings.join(model.select("uid", "m"), "uid")
