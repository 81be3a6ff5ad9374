"""Evaluation fixtures derived from the star-schema tables, deterministic in any SQL engine.

Pseudo-random numbers are hashes of keys, so no generator state is needed and every
partition computes its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.numeric import uniform

READERS = ["r1", "r2", "r3", "r4"]
CATEGORIES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per graded unit: image, group, site, age, sex, reference level (0-2), lesion probability."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    uid = F.concat_ws("#", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.withColumn("uid", uid)
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    level = F.when(uniform(F.concat(F.lit("lv:"), "uid")) < 0.8, 0).otherwise(flag)
    rows = rows.withColumn("level", level)
    raw = F.lit(0.15) + F.lit(0.2) * F.col("level") + F.lit(0.5) * (uniform(F.concat(F.lit("sc:"), "uid")) - F.lit(0.5))
    age = F.when(F.col("c_acctbal") >= 0, F.floor(F.lit(5.0) + F.col("c_acctbal") / F.lit(110.0)).cast("double"))
    return rows.select(
        "uid",
        F.col("l_orderkey").cast("string").alias("image_id"),
        F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("group_key"),
        F.col("l_suppkey").alias("group_no"),
        F.col("c_mktsegment").alias("site"),
        age.alias("age"),
        F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("M").alias("sex"),
        F.col("level").cast("int").alias("level"),
        F.greatest(F.lit(0.001), F.least(F.lit(0.999), raw)).alias("p_lesion"),
        F.col("l_partkey").alias("part"),
        F.col("l_linenumber").cast("int").alias("line"),
    )


def readings(unit_rows: DataFrame) -> DataFrame:
    """Long ratings: (uid, image_id, group_key, rater, grade); a reader skips whole images."""
    rows = unit_rows.select("uid", "image_id", "group_key", "group_no", "level", F.explode(F.array(*map(F.lit, READERS))).alias("rater"))
    rows = rows.filter(uniform(F.concat(F.lit("ms:"), "image_id", F.lit(":"), "rater")) >= 0.2)
    noisy = uniform(F.concat(F.lit("ng:"), "uid", F.lit(":"), "rater")) < 0.15
    other = F.pmod(F.floor(uniform(F.concat(F.lit("nv:"), "uid", F.lit(":"), "rater")) * 1_000_000), F.lit(CATEGORIES))
    return rows.select("uid", "image_id", "group_key", "group_no", "rater", F.when(noisy, other).otherwise(F.col("level")).cast("int").alias("grade"))


def with_teeth(unit_rows: DataFrame) -> DataFrame:
    """Units with a tooth number; several units of an image may be on one tooth."""
    return unit_rows.withColumn("fdi", (F.col("part") % 4 * 10 + 10 + (F.col("line") - 1) % 8 + 1).cast("int"))


def predictions(unit_rows: DataFrame) -> DataFrame:
    """(image_id, tooth_fdi, probs): class probabilities of each tooth, by its likeliest lesion."""
    p = F.max(F.floor(F.col("p_lesion") * 1000.0) / 1000.0)
    rows = unit_rows.groupBy("image_id", F.col("fdi").alias("tooth_fdi")).agg(p.alias("p"))
    return rows.select("image_id", "tooth_fdi", F.array(1 - F.col("p"), F.col("p") * 0.75, F.col("p") * 0.25).alias("probs"))


def lesions(unit_rows: DataFrame) -> DataFrame:
    """Reference boxes of units with a lesion: (image_id, group_key, lesion_id, level, box)."""
    x, y = F.col("part") % 50 * 8.0, F.col("line") * 40.0
    box = F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 30.0).cast("double").alias("x2"), (y + 30.0).cast("double").alias("y2"))
    return unit_rows.filter("level > 0").select("image_id", "group_key", "group_no", F.col("uid").alias("lesion_id"), "level", box.alias("box"))


def detections(unit_rows: DataFrame) -> DataFrame:
    """Boxes of a detector: jittered boxes of lesions, and background boxes of some sound units."""
    jitter = F.floor(uniform(F.concat(F.lit("jx:"), "uid")) * 20.0).cast("double")
    x, y = F.col("part") % 50 * 8.0, F.col("line") * 40.0
    background = (F.col("level") == 0) & (uniform(F.concat(F.lit("bg:"), "uid")) < 0.1)
    box = F.struct((x + jitter).cast("double").alias("x1"), y.cast("double").alias("y1"), (x + jitter + 30.0).cast("double").alias("x2"), (y + 30.0).cast("double").alias("y2"))
    score = F.floor(F.col("p_lesion") * 1000.0) / 1000.0
    return unit_rows.filter((F.col("level") > 0) | background).select("image_id", "group_key", "group_no", F.col("uid").alias("det_id"), score.alias("score"), box.alias("box"))


def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as binary predictions: (group_key, y, p)."""
    events = table(spark, sf_dir, "events").filter(F.col("value").isNotNull())
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.floor(F.col("value") / F.lit(500.0) * F.lit(1000.0)) / F.lit(1000.0)))
    return events.select("event_id", F.col("user_id").alias("group_no"), F.col("user_id").cast("string").alias("group_key"), (F.col("event_type") == "error").cast("int").alias("y"), p.alias("p"))


def content_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored items by content: (subset, file, sha)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("subset"), F.col("doc_id").alias("file"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label", (F.col("vec_id") % 50).alias("group_no"), (F.col("label") % 3).alias("site"))
