"""Synthetic data sets with parameters: records, a reader study with a latent truth, a simulated model.

Every draw is a hash of (seed, what is drawn, its key), so tables are the same however they are partitioned, and one of any
size is made by its tasks. Nothing is collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.numeric import FDI, uniform
from auditframe.operators import splits as sp
from auditframe.operators.records import ANNOTATION, BOX, group_key

#: Per reader the chance to mark a shallow and a deep lesion, to mark a sound tooth, to call the other depth.
READERS = {"r1": (0.70, 0.94, 0.015, 0.20), "r2": (0.60, 0.92, 0.010, 0.25), "r3": (0.78, 0.95, 0.025, 0.20), "r4": (0.55, 0.90, 0.008, 0.30)}
SITES = ("site_a", "site_b", "site_c")
#: Width and height of a generated image, of a tooth's box and of a lesion's.
IMAGE, TOOTH, LESION = (1100, 500), (52.0, 150.0), 20.0


@dataclass(frozen=True)
class Profile:
    """A model: mean logit of a sound, shallow and deep tooth, its spread, a factor that sharpens it, the least score of a box."""

    means: tuple[float, float, float]
    spread: float
    sharpness: float = 1.3
    floor: float = 0.15


#: At home, on groups it was trained on, elsewhere.
INTERNAL = Profile((-2.2, -0.5, 0.5), 1.1)
MEMORISED = Profile((-4.5, 3.0, 4.0), 0.6)
EXTERNAL = Profile((-2.0, -1.1, 0.2), 1.3)


@dataclass(frozen=True)
class ReaderStudy:
    """``records``; ``truth`` (image_id, group_key, tooth_fdi, level, box), the box NULL on sound teeth."""

    records: DataFrame
    truth: DataFrame


@dataclass(frozen=True)
class Inputs:
    """A data set to evaluate: records, class probabilities of teeth, scored boxes."""

    records: DataFrame
    predictions: DataFrame
    detections: DataFrame


def _draws(seed: int):
    def u(what: str, *keys) -> Column:
        return uniform(F.concat_ws(":", F.lit(f"{seed}:{what}"), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))

    return u


def _normal(u, what: str, *keys) -> Column:
    """Box and Muller's transform of two draws; the first is never 0."""
    return F.sqrt(-2 * F.log(u(f"{what}-r", *keys) + 5e-7)) * F.cos(2 * math.pi * u(f"{what}-a", *keys))


def _box(x: Column, y: Column, width: float, height: float) -> Column:
    return F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + width).cast("double").alias("x2"), (y + height).cast("double").alias("y2"))


def _patients(spark: SparkSession, n: int, u, sites: tuple[str, ...], ages: tuple[int, int], demographics: bool) -> DataFrame:
    site = F.element_at(F.array(*map(F.lit, sites)), (F.col("id") % len(sites) + 1).cast("int")) if sites else F.lit(None).cast("string")
    rows = spark.range(n).select(F.format_string("p%04d", "id").alias("patient_id"), site.alias("site_id"))
    rows = rows.withColumn("true_age", F.floor(u("age", "patient_id") * (ages[1] - ages[0] + 1) + ages[0]).cast("double"))
    shown = F.lit(demographics)
    return rows.withColumn("age", F.when(shown, F.col("true_age"))).withColumn("sex", F.when(shown, F.when(u("sex", "patient_id") < 0.5, "F").otherwise("M")))


def _images(patients: DataFrame, u, dataset: str, per_patient: tuple[int, int]) -> DataFrame:
    lo, hi = per_patient
    if not 0 < lo <= hi:
        raise ValueError(f"images per patient: {per_patient}")
    last = F.least(F.floor(u("images", "patient_id") * (hi - lo + 1)).cast("int"), F.lit(hi - lo)) + (lo - 1)
    rows = patients.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("dataset", F.lit(dataset)).withColumn("image_id", F.concat_ws("-", "dataset", "patient_id", F.col("i").cast("string")))


def _record(rows: DataFrame, modality: str, size: tuple[int, int], inventory: bool) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "image_id", F.concat(F.lit("/synthetic/"), "image_id", F.lit(".png")).alias("path"), "patient_id", F.lit("provided").alias("patient_id_source"), "dataset", F.lit(modality).alias("modality"),
        "readers", F.coalesce(F.col("annotations"), F.array().cast(f"array<{ANNOTATION}>")).alias("annotations"), "site_id", none("string").alias("device"), "age", "sex", (F.col("teeth_present") if inventory else none("array<int>")).alias("teeth_present"),
        (F.lit("annotated") if inventory else none("string")).alias("teeth_present_source"), F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height"), none("map<string,string>").alias("meta"),
    )


def _annotation(finding: Column, reader: Column, box: Column, fdi: Column, stage: Column) -> Column:
    return F.struct(finding.alias("finding"), reader.alias("annotator_id"), box.cast(BOX).alias("bbox"), fdi.cast("int").alias("tooth_fdi"), stage.cast("int").alias("stage"), F.lit(1.0).alias("confidence"), F.lit(None).cast("map<string,string>").alias("meta"))


def make_records(
    spark: SparkSession, n_patients: int = 40, per_patient: tuple[int, int] = (1, 4), sites: tuple[str, ...] = SITES, readers: tuple[str, ...] = ("consensus",), caries_rate: float = 0.3, staged: float = 0.8,
    dataset: str = "synthetic", seed: int = 0,
) -> DataFrame:
    """Records of patients who each belong to one site, with several images; a share of the lesions has no stage."""
    u = _draws(seed)
    rows = _images(_patients(spark, n_patients, u, sites, (18, 79), True), u, dataset, per_patient)
    rows = rows.withColumn("readers", F.array_sort(F.array(*map(F.lit, readers))))

    def note(name: str) -> Column:
        key = (F.col("image_id"), F.lit(name))
        fdi = F.element_at(F.array(*map(F.lit, FDI)), (F.floor(u("tooth", *key) * len(FDI)) + 1).cast("int"))
        stage = F.when(u("staged", *key) < staged, F.floor(u("stage", *key) * 5) + 1)
        lesion = _annotation(F.lit("caries"), F.lit(name), _box(u("x", *key) * 400, u("y", *key) * 400, 40.0, 40.0), fdi, stage)
        return F.when(u("lesion", *key) < caries_rate, lesion)

    return _record(rows.withColumn("annotations", F.array_compact(F.array(*map(note, readers)))), "bitewing", (512, 512), False)


def _tooth_corner(fdi: Column) -> tuple[Column, Column]:
    quadrant, place = F.floor(fdi / 10), fdi % 10
    return F.when(quadrant.isin(1, 4), (8 - place) * 62 + 10).otherwise(560 + (place - 1) * 62), F.when(quadrant.isin(1, 2), 60).otherwise(280)


def _within(u, what: str, *keys) -> Column:
    """A lesion's box somewhere in the box of the tooth."""
    x, y = _tooth_corner(F.col("tooth_fdi"))
    return _box(x + u(f"{what}-x", *keys) * (TOOTH[0] - LESION), y + u(f"{what}-y", *keys) * (TOOTH[1] - LESION), LESION, LESION)


def _shifted(box: str, u, what: str, *keys, most: float = 2.0) -> Column:
    return F.struct(*[(F.col(f"{box}.{side}") + (2 * u(f"{what}-{side}", *keys) - 1) * most).alias(side) for side in ("x1", "y1", "x2", "y2")])


def make_reader_study(
    spark: SparkSession, n_patients: int, seed: int, per_patient: tuple[int, int] = (1, 2), readers: dict[str, tuple[float, float, float, float]] = READERS, full: float = 0.8, sites: tuple[str, ...] = SITES, demographics: bool = True,
    caries_rate: float = 0.06, deep_rate: float = 0.03, dataset: str = "synthetic",
) -> ReaderStudy:
    """Panoramic images with a truth that no reader sees.

    Deep lesions and missing teeth grow with age, also where the age is not shown. The images of a patient share teeth and
    lesions. A share ``full`` of the images is read by all, the rest by all but one. Wisdom teeth are there by a half, the
    28 others each miss with a chance of age / 25 / 28 (at most 10 in the mean).
    """
    u = _draws(seed)
    patients = _patients(spark, n_patients, u, sites, (18, 80), demographics)
    tooth = ("patient_id", "tooth_fdi")
    teeth = patients.select("patient_id", "true_age", F.explode(F.array(*map(F.lit, FDI))).alias("tooth_fdi"))
    gone = F.when(F.col("tooth_fdi") % 10 == 8, 0.5).otherwise(F.least(F.col("true_age") / 25, F.lit(10.0)) / 28)
    teeth = teeth.filter(u("gone", *tooth) >= gone)
    deep = deep_rate * (0.4 + F.col("true_age") / 50)
    level = F.when(u("level", *tooth) < deep, 2).when(u("level", *tooth) < deep + caries_rate, 1).otherwise(0)
    teeth = teeth.withColumn("level", level).withColumn("box", F.when(F.col("level") > 0, _within(u, "at", *tooth)))

    images = _images(patients, u, dataset, per_patient)
    names = sorted(readers)
    left_out = F.element_at(F.array(*map(F.lit, names)), F.least(F.floor(u("who", "image_id") * len(names)) + 1, F.lit(len(names))).cast("int"))
    read = F.when(u("full", "image_id") < full, F.array(*map(F.lit, names))).otherwise(F.array_remove(F.array(*map(F.lit, names)), left_out))
    images = images.withColumn("readers", read)
    seen = images.select("patient_id", "dataset", "image_id", "readers").join(teeth, "patient_id")

    marks = seen.withColumn("reader", F.explode("readers"))
    of = lambda i: F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(readers[n][i]))]), F.col("reader"))
    key = ("image_id", "tooth_fdi", "reader")
    found = F.when(F.col("level") == 1, of(0)).when(F.col("level") == 2, of(1)).otherwise(of(2))
    marks = marks.filter(u("mark", *key) < found)
    called = F.when(F.col("level") == 0, 1).when(u("depth", *key) < of(3), 3 - F.col("level")).otherwise(F.col("level"))
    box = F.when(F.col("level") > 0, _shifted("box", u, "shift", *key)).otherwise(_within(u, "false", *key))
    note = _annotation(F.when(called == 1, "caries").otherwise("deep_caries"), F.col("reader"), box, F.col("tooth_fdi"), F.lit(None))
    order = F.struct(F.col("reader"), F.col("tooth_fdi"), note.alias("note"))
    # A map cannot be ordered: notes are sorted by reader and tooth, which are unique within an image.
    lists = marks.groupBy("image_id").agg(F.collect_list(order).alias("notes"))
    before = lambda a, b: F.when(a["reader"] < b["reader"], -1).when(a["reader"] > b["reader"], 1).otherwise(a["tooth_fdi"] - b["tooth_fdi"])
    lists = lists.select("image_id", F.transform(F.array_sort("notes", before), lambda x: x["note"]).alias("annotations"))
    inventory = teeth.groupBy("patient_id").agg(F.sort_array(F.collect_set("tooth_fdi")).alias("teeth_present"))
    rows = images.join(lists, "image_id", "left").join(inventory, "patient_id", "left")
    rows = rows.withColumn("teeth_present", F.coalesce("teeth_present", F.array().cast("array<int>")))
    truth = seen.select("image_id", group_key().alias("group_key"), "tooth_fdi", F.col("level").cast("int").alias("level"), "box")
    return ReaderStudy(_record(rows, "panoramic", IMAGE, True), truth)


def simulate_model(study: ReaderStudy, profile: Profile, seed: int, memorised: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(predictions, detections)`` of every tooth of the truth.

    ``memorised`` lists group keys that the model was trained on: there it recognises teeth rather than reading them.
    Detections are boxes of teeth with a probability of a lesion of ``profile.floor`` or more.
    """
    u = _draws(seed)
    rows, key = study.truth, ("image_id", "tooth_fdi")
    if memorised is None:
        rows = rows.withColumn("known", F.lit(False))
    else:
        rows = rows.join(memorised.select("group_key", F.lit(True).alias("known")).distinct(), "group_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    pick = lambda f: F.when(F.col("known"), f(MEMORISED)).otherwise(f(profile))
    mean = pick(lambda p: F.element_at(F.array(*map(F.lit, p.means)), F.col("level") + 1))
    z = mean + pick(lambda p: F.lit(p.spread)) * _normal(u, "z", *key)
    rows = rows.withColumn("z", z).withColumn("p", 1 / (1 + F.exp(-pick(lambda p: F.lit(p.sharpness)) * F.col("z"))))
    deep = 1 / (1 + F.exp(-2.0 * (F.col("z") - 0.8)))
    predictions = rows.select("image_id", "tooth_fdi", F.array(1 - F.col("p"), F.col("p") * (1 - deep), F.col("p") * deep).alias("probs"))
    box = F.when(F.col("level") > 0, _shifted("box", u, "det", *key)).otherwise(_within(u, "ghost", *key))
    kept = rows.filter(F.col("p") >= pick(lambda p: F.lit(p.floor)))
    detections = kept.select("image_id", "group_key", F.concat_ws("#", "image_id", F.col("tooth_fdi").cast("string")).alias("det_id"), F.col("p").alias("score"), box.alias("box"))
    return predictions, detections


def synthetic_inputs(spark: SparkSession, seed: int, internal_patients: int, external_patients: int, per_patient: tuple[int, int] = (1, 2), external_demographics: bool = True, memorise_train: bool = False, split: str = "patient") -> tuple[Inputs, Inputs]:
    """``(internal, external)``. With ``memorise_train`` the model knows the groups of the training part that the study itself makes."""
    home = make_reader_study(spark, internal_patients, seed, per_patient)
    away = make_reader_study(spark, external_patients, seed + 1, dataset="synthetic_external", sites=("site_ext",), demographics=external_demographics)
    known = None
    if memorise_train:
        make = sp.group_split if split == "patient" else sp.naive_image_split
        known = make(home.records.select("image_id", group_key().alias("group_key")), seed).filter("partition = 'train'").select("group_key")
    return Inputs(home.records, *simulate_model(home, INTERNAL, seed, known)), Inputs(away.records, *simulate_model(away, EXTERNAL, seed + 1))
