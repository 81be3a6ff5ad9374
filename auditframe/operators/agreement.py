"""Inter-rater agreement over long ratings (uid, group_key, rater, grade). An absent row is an unread unit."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.numeric import div
from auditframe.operators.bootstrap import Resampled, estimate


def consensus(ratings: DataFrame, min_raters: int = 2) -> DataFrame:
    """(uid, n_raters, grade): the lower median; NULL below ``min_raters`` ratings."""
    grades = F.array_sort(F.collect_list("grade"))
    rows = ratings.groupBy("uid").agg(F.count("*").alias("n_raters"), grades.alias("g"))
    middle = F.get(F.col("g"), F.floor((F.col("n_raters") - 1) / 2).cast("int"))
    return rows.select("uid", "n_raters", F.when(F.col("n_raters") >= min_raters, middle).alias("grade"))


def image_ratings(ratings: DataFrame) -> DataFrame:
    """(image_id, rater, grade): the worst grade of the image by each reader who read it."""
    return ratings.groupBy("image_id", "rater").agg(F.max("grade").alias("grade"))


def by_unit(ratings: DataFrame) -> DataFrame:
    """(uid, group_key, rs): the ratings of each unit as (rater, grade), in order of raters. A unit has a handful."""
    return ratings.groupBy("uid", "group_key").agg(F.array_sort(F.collect_list(F.struct("rater", "grade"))).alias("rs"))


def pairs(ratings: DataFrame) -> DataFrame:
    """Units that two readers share: (uid, group_key, rater_a, rater_b, a, b). One grouping by unit, no join."""
    def follow(x: Column, i: Column) -> Column:
        return F.transform(F.slice("rs", i + 2, F.size("rs")), lambda y: F.struct(x["rater"].alias("rater_a"), y["rater"].alias("rater_b"), x["grade"].alias("a"), y["grade"].alias("b")))

    return by_unit(ratings).select("uid", "group_key", F.explode(F.flatten(F.transform("rs", follow))).alias("p")).select("uid", "group_key", "p.*")


def contingency(rows: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(keys, a, b, n) with zero cells filled in."""
    spark = rows.sparkSession
    grid = rows.select(*keys).distinct().join(F.broadcast(spark.range(k).select(F.col("id").cast("int").alias("a")))).join(F.broadcast(spark.range(k).select(F.col("id").cast("int").alias("b"))))
    counted = rows.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    return grid.join(counted, [*keys, "a", "b"], "left").select(*keys, "a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def disagreement(a: Column, b: Column, k: int, weights: str) -> Column:
    """Weight of a cell: 0 on the diagonal."""
    gap = F.abs(a - b) / F.lit(float(k - 1))
    return {"none": (a != b).cast("double"), "linear": gap, "quadratic": gap * gap}[weights]


def cell_sums(k: int) -> dict[str, Column]:
    """Additive statistics of a kappa: the k x k cell counts."""
    return {f"c{i}{j}": ((F.col("a") == i) & (F.col("b") == j)).cast("long") for i in range(k) for j in range(k)}


def kappa_of_cells(k: int, weights: str) -> Column:
    """Cohen's kappa from summed cells: 1 - sum(w O) / sum(w E); NULL without overlap or without expected disagreement."""
    w = lambda i, j: {"none": float(i != j), "linear": abs(i - j) / (k - 1), "quadratic": ((i - j) / (k - 1)) ** 2}[weights]
    cell = lambda i, j: F.col(f"c{i}{j}").cast("double")
    total = sum((cell(i, j) for i in range(k) for j in range(k)), F.lit(0.0))
    row = [sum((cell(i, j) for j in range(k)), F.lit(0.0)) for i in range(k)]
    col = [sum((cell(i, j) for i in range(k)), F.lit(0.0)) for j in range(k)]
    observed = sum((cell(i, j) * w(i, j) for i in range(k) for j in range(k) if w(i, j)), F.lit(0.0))
    expected = sum((row[i] * col[j] * w(i, j) for i in range(k) for j in range(k) if w(i, j)), F.lit(0.0))
    return F.lit(1.0) - div(observed * total, expected)


class IncompleteDesign(ValueError):
    """Not every reader graded every unit."""


def fleiss_sums(ratings: DataFrame, k: int) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Rows, sums and final of Fleiss' kappa for ``Resampled``; every reader must have graded every unit."""
    units = by_unit(ratings)
    shape = units.agg(F.min(F.size("rs")).alias("lo"), F.max(F.size("rs")).alias("hi")).first()
    readers = ratings.agg(F.count_distinct("rater")).first()[0]
    if shape.lo != readers or shape.hi != readers or readers < 2:
        short = [r.uid for r in units.filter(F.size("rs") != readers).orderBy("uid").limit(3).collect()]
        raise IncompleteDesign(f"Fleiss' kappa needs two readers or more and a complete design; e.g. {short} lack some of {readers} readers")
    given = lambda c: F.size(F.filter("rs", lambda x: x["grade"] == c))
    rows = units.select("uid", "group_key", *[given(c).alias(f"n{c}") for c in range(k)])
    sums = {"units": F.lit(1), "same": sum((F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in range(k)), F.lit(0)), **{f"t{c}": F.col(f"n{c}") for c in range(k)}}
    all_ = sum((F.col(f"t{c}") for c in range(k)), F.lit(0))
    item = div(F.col("same"), F.col("units") * F.lit(readers * (readers - 1)))
    chance = div(sum((F.col(f"t{c}") * F.col(f"t{c}") for c in range(k)), F.lit(0)), all_ * all_)
    return rows, {n: c.cast("long") for n, c in sums.items()}, {"kappa": div(item - chance, 1 - chance)}


def fleiss(ratings: DataFrame, k: int) -> DataFrame:
    """One row (n_units, kappa) of a complete design; an incomplete one raises."""
    rows, sums, final = fleiss_sums(ratings, k)
    return rows.agg(*[F.sum(c).alias(n) for n, c in sums.items()]).select(F.col("units").alias("n_units"), final["kappa"].alias("kappa"))


def complete(ratings: DataFrame) -> DataFrame:
    """The ratings of the units that all readers graded."""
    readers = ratings.agg(F.count_distinct("rater")).first()[0]
    return by_unit(ratings).filter(F.size("rs") == readers).select("uid", "group_key", F.explode("rs").alias("r")).select("uid", "group_key", "r.*")


def coincidences(ratings: DataFrame) -> DataFrame:
    """(a, b, o): coincidence matrix of units with two or more ratings."""
    counts = ratings.groupBy("uid", "grade").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("uid").agg(F.sum("n").alias("m")).filter("m >= 2")
    rows = counts.join(sizes, "uid")
    left = rows.select("uid", F.col("grade").alias("a"), F.col("n").alias("na"), "m")
    right = rows.select("uid", F.col("grade").alias("b"), F.col("n").alias("nb"))
    both = F.col("na") * (F.col("nb") - F.when(F.col("a") == F.col("b"), 1).otherwise(0))
    # Sums of integers by number of ratings keep the result independent of order.
    by_size = left.join(right, "uid").groupBy("a", "b", "m").agg(F.sum(both).alias("s"))
    return by_size.groupBy("a", "b").agg(F.sum(F.col("s") / (F.col("m") - 1)).alias("o"))


def krippendorff(ratings: DataFrame, metric: str, k: int) -> DataFrame:
    """One row (alpha). Metrics: nominal, ordinal, interval."""
    o = coincidences(ratings)
    cells = o.agg(*[F.coalesce(F.sum(F.when((F.col("a") == i) & (F.col("b") == j), F.col("o"))), F.lit(0.0)).alias(f"o{i}{j}") for i in range(k) for j in range(k)])
    return cells.select(alpha_of_cells(metric, k, 1).alias("alpha"))


def alpha_of_cells(metric: str, k: int, scale: int) -> Column:
    """Krippendorff's alpha of coincidences in columns o00, o01, ..., each ``scale`` times its value."""
    cell = lambda i, j: F.col(f"o{i}{j}") / F.lit(float(scale))
    n_c = [sum((cell(i, j) for j in range(k)), F.lit(0.0)) for i in range(k)]
    n = sum(n_c, F.lit(0.0))

    def delta(i: int, j: int) -> Column:
        if metric == "nominal":
            return F.lit(float(i != j))
        if metric == "interval":
            return F.lit(float((i - j) ** 2))
        lo, hi = min(i, j), max(i, j)
        between = sum(n_c[lo : hi + 1], F.lit(0.0)) - (n_c[i] + n_c[j]) / 2.0
        return between * between

    pairs_of = [(i, j) for i in range(k) for j in range(k) if i != j]
    observed = div(sum((cell(i, j) * delta(i, j) for i, j in pairs_of), F.lit(0.0)), n)
    expected = div(sum((n_c[i] * n_c[j] * delta(i, j) for i, j in pairs_of), F.lit(0.0)), n * (n - 1))
    return F.lit(1.0) - div(observed, expected)


def alpha_intervals(ratings: DataFrame, k: int, metrics: list[str], seed: int, n_boot: int = 2000, level: float = 0.95) -> DataFrame:
    """(statistic, value, lo, hi, n_valid) of Krippendorff's alpha, groups drawn with replacement.

    Coincidences are sums over units, so a resample is a weighted sum of its groups' tables. They are counted in parts of
    the least common multiple of the numbers of partners, so the sums are whole numbers in any order.
    """
    each = [F.count_if(F.col("grade") == i).alias(f"n{i}") for i in range(k)]
    units = ratings.groupBy("uid", "group_key").agg(*each).withColumn("m", sum((F.col(f"n{i}") for i in range(k)), F.lit(0))).filter("m >= 2")
    most = units.agg(F.max("m")).first()[0] or 2
    scale = math.lcm(*range(1, most))
    part = F.lit(scale) / (F.col("m") - 1)
    sums = {f"o{i}{j}": (F.col(f"n{i}") * (F.col(f"n{j}") - int(i == j)) * part).cast("long") for i in range(k) for j in range(k)}
    return Resampled(units, sums, {m: alpha_of_cells(m, k, scale) for m in metrics}, [], seed, n_boot).estimates(level)


def leave_one_out(ratings: DataFrame, min_consensus: int = 2) -> DataFrame:
    """(uid, group_key, rater, grade, loo, others, given): each reader beside the lower median of the others, whose ratings are ``given``."""
    rows = by_unit(ratings).select("uid", "group_key", "rs", F.explode("rs").alias("r"))
    rows = rows.select("uid", "group_key", "r.*", F.filter("rs", lambda x: x["rater"] != F.col("r.rater")).alias("given")).filter(F.size("given") >= min_consensus)
    gs = F.array_sort(F.transform("given", lambda x: x["grade"]))
    return rows.select("uid", "group_key", "rater", "grade", F.get(gs, F.floor((F.size("given") - 1) / 2).cast("int")).alias("loo"), F.size("given").alias("others"), "given")


def named_cells(name: str, value: Column, given: Column, k: int) -> dict[str, Column]:
    """Additive cell counts ``<name>ij`` of a grade ``value`` against ``given``."""
    return {f"{name}{i}{j}": F.coalesce(((value == i) & (given == j)).cast("long"), F.lit(0)) for i in range(k) for j in range(k)}


def kappa_of(name: str, k: int, weights: str) -> Column:
    """``kappa_of_cells`` of the cells called ``name``."""
    w = lambda i, j: {"none": float(i != j), "linear": abs(i - j) / (k - 1), "quadratic": ((i - j) / (k - 1)) ** 2}[weights]
    cell = lambda i, j: F.col(f"{name}{i}{j}").cast("double")
    add = lambda xs: sum(xs, F.lit(0.0))
    span = range(k)
    row, col = [add(cell(i, j) for j in span) for i in span], [add(cell(i, j) for i in span) for j in span]
    off = [(i, j) for i in span for j in span if w(i, j)]
    return F.lit(1.0) - div(add(cell(i, j) * w(i, j) for i, j in off) * add(row), add(row[i] * col[j] * w(i, j) for i, j in off))


def enough_readers(ratings: DataFrame, min_consensus: int) -> list[str]:
    readers = [r[0] for r in ratings.select("rater").distinct().orderBy("rater").collect()]
    if len(readers) < min_consensus + 1:
        raise ValueError(f"a ceiling by leaving one reader out needs at least {min_consensus + 1} readers; got {readers}")
    return readers


def model_vs_readers(ratings: DataFrame, k: int, weights: str, seed: int, n_boot: int = 2000, min_consensus: int = 2, level: float = 0.95) -> DataFrame:
    """The model beside each reader: (rater, n, model, ceiling, individual, difference, lo, hi, exceeds_ceiling, below_ceiling).

    ``ratings`` has the model's grade ``m`` on every row (``ratings.aligned``). ``ceiling``: kappa of the others' consensus with the
    reader; ``individual``: mean kappa of each other reader; ``difference``: model minus ceiling, resample by resample. All
    four are of the same units, those that the reader and ``min_consensus`` others graded.
    """
    readers = enough_readers(ratings, min_consensus)
    rows = leave_one_out(ratings, min_consensus).join(ratings.select("uid", "m").distinct(), "uid")
    others = F.array_except(F.array(*map(F.lit, readers)), F.array("rater"))
    theirs = lambda i: F.get(F.transform(F.filter("given", lambda x: x["rater"] == F.get(others, F.lit(i))), lambda x: x["grade"]), F.lit(0))
    names = {"m": F.col("m"), "l": F.col("loo"), **{f"o{i}_": theirs(i) for i in range(len(readers) - 1)}}
    sums = {"n": F.lit(1)}
    for name, value in names.items():
        sums |= named_cells(name, value, F.col("grade"), k)
    each = F.filter(F.array(*[kappa_of(f"o{i}_", k, weights) for i in range(len(readers) - 1)]), lambda x: x.isNotNull())
    mean = div(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.size(each))
    model, ceiling = kappa_of("m", k, weights), kappa_of("l", k, weights)
    found = Resampled(rows, sums, {"n": F.col("n"), "model": model, "ceiling": ceiling, "individual": mean, "difference": model - ceiling}, ["rater"], seed, n_boot).estimates(level)
    pick = lambda name, column: F.max(F.when(F.col("statistic") == name, F.col(column)))
    out = found.groupBy("rater").agg(pick("n", "value").cast("long").alias("n"), *[pick(x, "value").alias(x) for x in ("model", "ceiling", "individual", "difference")], pick("difference", "lo").alias("lo"), pick("difference", "hi").alias("hi"))
    return out.select("*", (F.col("lo") > 0).alias("exceeds_ceiling"), (F.col("hi") < 0).alias("below_ceiling"))


def sweep_curve(ratings: DataFrame, thresholds: DataFrame, grade: Callable[[Column], Column], k: int, weights: str, min_consensus: int = 2) -> DataFrame:
    """(t, kappa): mean kappa of the model with the readers at each threshold.

    ``ratings`` has the model's score ``s``, ``thresholds`` a column t of few rows; ``grade(t)`` gives the model's grade. Scores are
    counted before they meet the thresholds, so the cost follows the number of distinct scores.
    """
    counts = leave_one_out(ratings, min_consensus).join(ratings.select("uid", "s").distinct(), "uid").groupBy("rater", "s", F.col("grade").alias("b")).agg(F.count("*").alias("n"))
    cells = counts.join(F.broadcast(thresholds)).withColumn("a", grade(F.col("t")))
    summed = cells.groupBy("t", "rater").agg(*[F.sum(c * F.col("n")).alias(x) for x, c in cell_sums(k).items()])
    return summed.select("t", "rater", kappa_of_cells(k, weights).alias("kappa")).groupBy("t").agg(F.avg("kappa").alias("kappa"))


def sweep_summary(ratings: DataFrame, curve: DataFrame, operating: float, grade: Callable[[Column], Column], k: int, weights: str, seed: int, n_boot: int = 2000, min_consensus: int = 2) -> DataFrame:
    """(statistic, value, lo, hi, n_valid, best, reaches_ceiling, operating_costs_agreement) of ceiling, at_operating, at_best and best_minus_operating.

    Means over the readers within each resample; the best threshold (the first on ties) is chosen on the same data, so ``at_best`` is optimistic.
    """
    enough_readers(ratings, min_consensus)
    top = curve.agg(F.max_by("t", F.struct("kappa", -F.col("t"))).alias("t"), F.max("kappa").alias("kappa")).first()
    rows = leave_one_out(ratings, min_consensus).join(ratings.select("uid", "s").distinct(), "uid")
    values = {"l": F.col("loo"), "x": grade(F.lit(operating)), "y": grade(F.lit(top.t))}
    sums: dict[str, Column] = {}
    for name, value in values.items():
        sums |= named_cells(name, value, F.col("grade"), k)
    finals = {n: kappa_of(c, k, weights) for n, c in (("ceiling", "l"), ("at_operating", "x"), ("at_best", "y"))}
    found = Resampled(rows, sums, finals, ["rater"], seed, n_boot)

    def mean(listed: DataFrame, by: list[str]) -> DataFrame:
        wide = listed.groupBy(*by).agg(*[F.avg(F.when(F.col("statistic") == n, F.col("v"))).alias(n) for n in finals])
        wide = wide.withColumn("best_minus_operating", F.col("at_best") - F.col("at_operating"))
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("v")) for n in (*finals, "best_minus_operating")]))
        return wide.select(*by, each.alias("e")).select(*by, "e.*")

    out = estimate(mean(found.values(), []), mean(found.samples(), ["b"]), [])
    verdict = out.agg(F.max(F.when(F.col("statistic") == "ceiling", F.col("lo"))).alias("_edge"), F.max(F.when(F.col("statistic") == "best_minus_operating", F.col("lo"))).alias("_gain"))
    return out.join(F.broadcast(verdict)).select(*out.columns, F.lit(top.t).alias("best"), (F.lit(top.kappa) >= F.col("_edge")).alias("reaches_ceiling"), (F.col("_gain") > 0).alias("operating_costs_agreement"))
