"""Group-level splits and leakage checks. A split that leaks raises; it does not warn."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions.numeric import uniform

FRACTIONS = {"train": 0.6, "val": 0.2, "test": 0.2}


class LeakageError(ValueError):
    """A group spans partitions, or an image stands in several."""


def check_fractions(fractions: dict[str, float]) -> None:
    if len(fractions) < 2 or min(fractions.values()) <= 0 or abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError(f"fractions must be two or more positive shares that sum to one: {fractions}")


def leakage(rows: DataFrame) -> DataFrame:
    """One row over (image_id, group_key, partition): n_groups, leaked_groups, leaked_share, repeated_images, unverifiable_groups.

    An image that stands in the split twice is repeated, wherever. Groups are unverifiable if their ids are merely assumed
    (``patient_id_source``, where the column is given).
    """
    assumed = F.max((F.col("patient_id_source") == "assumed_unique").cast("int")) if "patient_id_source" in rows.columns else F.lit(0)
    per_group = rows.groupBy("group_key").agg(F.min("partition").alias("lo"), F.max("partition").alias("hi"), assumed.alias("assumed"))
    groups = per_group.agg(F.count("*").alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("leaked_groups"), F.count_if(F.col("assumed") > 0).alias("unverifiable_groups"))
    images = rows.groupBy("image_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_images"))
    share = F.col("leaked_groups") / F.nullif(F.col("n_groups").cast("double"), F.lit(0.0))
    return groups.join(images).select("n_groups", "leaked_groups", share.alias("leaked_share"), "repeated_images", "unverifiable_groups")


def checked(rows: DataFrame, allow_leakage: bool = False) -> DataFrame:
    """``rows`` if clean; leaking groups raise unless a measured leak is the purpose, repeated images always raise."""
    found = leakage(rows).first()
    if found.repeated_images:
        raise LeakageError(f"{found.repeated_images} image(s) stand in the split more than once")
    if found.leaked_groups and not allow_leakage:
        several = F.size(F.collect_set("partition")) > 1
        worst = [r.group_key for r in rows.groupBy("group_key").agg(several.alias("s")).filter("s").orderBy("group_key").limit(3).collect()]
        raise LeakageError(f"{found.leaked_groups} of {found.n_groups} groups span partitions, e.g. {worst}")
    return rows


def _allocated(units: DataFrame, key: str, size: Column, stratum: Column, seed: int, fractions: dict[str, float]) -> DataFrame:
    """``partition`` of each key by the midpoint of its share in hash order; an edge belongs to the next partition."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    rows = units.withColumn("_n", size).withColumn("_s", F.coalesce(stratum.cast("string"), F.lit("\0"))).withColumn("_o", order)
    rows = rows.withColumn("_b", F.substring("_o", 1, 3))
    # Running sums in two levels: over the 4,096 hash buckets of a stratum, and within a bucket. No window holds all rows.
    run, whole = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_s")
    buckets = rows.groupBy("_s", "_b").agg(F.sum("_n").alias("_m"))
    buckets = buckets.select("_s", "_b", F.coalesce(F.sum("_m").over(run), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("_all"))
    within = Window.partitionBy("_s", "_b").orderBy("_o", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(buckets, ["_s", "_b"])
    middle = (F.col("_before") + F.sum("_n").over(within) - F.col("_n") / F.lit(2.0)) / F.col("_all")
    bounds, total = [], 0.0
    for name, share in list(fractions.items())[:-1]:
        total += share
        bounds.append((name, round(total, 9)))
    out = F.when(middle < bounds[0][1], bounds[0][0])
    for name, bound in bounds[1:]:
        out = out.when(middle < bound, name)
    return rows.withColumn("partition", out.otherwise(list(fractions)[-1])).drop("_n", "_s", "_o", "_b", "_before", "_all")


def group_split(images: DataFrame, seed: int, fractions: dict[str, float] = FRACTIONS, stratum: Column | None = None) -> DataFrame:
    """``images`` (image_id, group_key, ...) with a partition; whole groups, weighted by their number of images.

    ``stratum``: an aggregate over the images of a group. The windows run over groups.
    """
    check_fractions(fractions)
    groups = images.groupBy("group_key").agg(F.count("*").alias("size"), (stratum if stratum is not None else F.lit(0)).alias("stratum"))
    placed = _allocated(groups, "group_key", F.col("size"), F.col("stratum"), seed, fractions)
    return images.join(placed.select("group_key", "partition"), "group_key")


def naive_image_split(images: DataFrame, seed: int, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """The leaky split by image, for measuring what it does."""
    check_fractions(fractions)
    return _allocated(images, "image_id", F.lit(1), F.lit(0), seed, fractions)


KINDS = ("patient", "image_naive", "site_holdout")


def split(rows: DataFrame, kind: str, allow_leakage: bool = False) -> DataFrame:
    """``rows`` (image_id, group_key, partition) as a split of that kind, checked here and now.

    No partition may be empty; leaking groups are allowed for the naive split alone, whose purpose they are, and which warns if nothing leaks.
    """
    if kind not in KINDS:
        raise ValueError(f"no such kind of split: {kind}")
    if allow_leakage and kind != "image_naive":
        raise ValueError(f"only the naive split may leak, not {kind}")
    if rows.select("partition").distinct().count() < 2:
        raise ValueError("a split needs two partitions or more that are not empty")
    checked(rows, allow_leakage)
    if allow_leakage and not leakage(rows).first().leaked_groups:
        warnings.warn("the naive split leaks no group: it measures nothing", stacklevel=2)
    return rows


def group_kfold(images: DataFrame, seed: int, n_splits: int = 5, stratum: Column | None = None) -> DataFrame:
    """``images`` with a fold: whole groups, in hash order of equal total size within each ``stratum`` (an aggregate over a group's images).

    Each image is in one fold, and no group in two: checked after the fact.
    """
    groups = images.groupBy("group_key").agg(F.count("*").alias("size"), (stratum if stratum is not None else F.lit(0)).alias("stratum"))
    n = groups.count()
    if not 2 <= n_splits <= n:
        raise ValueError(f"{n_splits} folds need as many groups at least, and there are {n}")
    names = {f"fold{i}": 1.0 / n_splits for i in range(n_splits)}
    placed = _allocated(groups, "group_key", F.col("size"), F.col("stratum"), seed, names)
    rows = images.join(placed.select("group_key", F.col("partition").alias("fold")), "group_key")
    checked(rows.select("image_id", "group_key", F.col("fold").alias("partition")))
    if rows.count() != images.filter("group_key IS NOT NULL").count() or images.filter("group_key IS NULL").limit(1).count():
        raise LeakageError("the folds do not cover all images")
    return rows


def leave_one_site_out(images: DataFrame) -> DataFrame:
    """``images`` once per site: (holdout, partition); images without a site, a single site, and groups at two sites raise."""
    missing = images.filter(F.col("site").isNull()).limit(3).collect()
    if missing:
        raise ValueError(f"record(s) have no site, e.g. {[r.image_id for r in missing]}")
    sites = images.select(F.col("site").alias("holdout")).distinct()
    if sites.count() < 2:
        raise ValueError("at least two sites are needed to hold one out")
    checked(images.select("image_id", "group_key", F.col("site").alias("partition")))
    return images.join(F.broadcast(sites)).withColumn("partition", F.when(F.col("site") == F.col("holdout"), "test").otherwise("train"))


def disjoint_groups(fitted: DataFrame, rows: DataFrame, allow_overlap: bool = False) -> int:
    """How many groups of ``rows`` an operating point was ``fitted`` on; any is an error unless measured on purpose."""
    both = rows.select("group_key").distinct().join(fitted.select("group_key").distinct(), "group_key", "left_semi")
    n = both.count()
    if n and not allow_overlap:
        raise LeakageError(f"fitted on {n} group(s) of the evaluation set, e.g. {[r.group_key for r in both.orderBy('group_key').limit(3).collect()]}")
    return n


def training_sets(candidates: DataFrame, held_out: DataFrame, seed: int) -> DataFrame:
    """(file, set) of the honest, swap and naive training sets over (file, sha, group_key).

    Honest: what shares neither content nor group with the held-out files. Naive: all candidates. Swap: as large as the honest set, with as
    many of its files replaced by held-out copies as there are; the invariants are checked.
    """
    honest = eligible_training(candidates, held_out).select("file")
    leaked = candidates.join(held_out.select("sha").distinct(), "sha", "left_semi").select("file")
    n, m = honest.count(), leaked.count()
    if m > n:
        raise ValueError(f"{m} leaked files cannot replace {n} honest ones")
    order = uniform(F.concat(F.lit(f"{seed}:"), F.col("file").cast("string")))
    swap = honest.orderBy(order, "file").limit(n - m).unionByName(leaked)
    if swap.count() != n or swap.distinct().count() != n or honest.join(leaked, "file", "left_semi").limit(1).count():
        raise LeakageError("the swapped set is not of the size of the honest one")
    sets = {"honest": honest, "swap": swap, "naive": candidates.select("file")}
    return reduce(DataFrame.unionByName, [rows.withColumn("set", F.lit(name)) for name, rows in sets.items()])


def seen_rate(rows: DataFrame) -> DataFrame:
    """Share of test images whose group is also in another partition."""
    seen = rows.filter("partition <> 'test'").select("group_key").distinct().withColumn("seen", F.lit(1))
    return rows.filter("partition = 'test'").join(seen, "group_key", "left").agg(F.count("*").alias("n_test"), F.sum(F.coalesce("seen", F.lit(0))).alias("n_seen"))


def eligible_training(candidates: DataFrame, held_out: DataFrame) -> DataFrame:
    """Candidates that share neither content nor group with what is held out."""
    return candidates.join(held_out.select("sha"), "sha", "left_anti").join(held_out.select("group_key"), "group_key", "left_anti")


def matched_swap(held_in: DataFrame, pool: DataFrame, seed: int, key: str, n: int) -> DataFrame:
    """``n`` rows of the pool without replacement, in hash order."""
    return pool.join(held_in.select(key), key, "left_anti").orderBy(uniform(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
