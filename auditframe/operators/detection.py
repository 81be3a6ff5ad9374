"""Box matching and detection metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions import draws
from auditframe.functions.numeric import div, iou
from auditframe.operators.bootstrap import Resampled, difference, estimate, group_index, weights
from auditframe.operators.running import running
from auditframe.operators.storage import written

#: Scores of groups that are broadcast to make whole resamples in a task (some 20 bytes each on the driver, a third of it in a worker), and how many of them are summed at once.
IN_ARRAYS, AT_ONCE = 16_000_000, 1 << 18


def overlaps(lesions: DataFrame, detections: DataFrame, threshold: float) -> DataFrame:
    """(image_id, det_id, lesion_id, iou) of boxes of one image that overlap enough: an equi-join on the image."""
    pairs = detections.select("image_id", "det_id", F.col("box").alias("d")).join(lesions.select("image_id", "lesion_id", F.col("box").alias("g")), "image_id")
    return pairs.select("image_id", "det_id", "lesion_id", iou(F.col("d"), F.col("g")).alias("iou")).filter(F.col("iou") >= threshold)


def greedy_match(lesions: DataFrame, detections: DataFrame, threshold: float = 0.5, target: int | None = None) -> DataFrame:
    """``detections`` with the lesion that each claims, or NULL.

    Highest score first; a detection takes the unclaimed lesion of largest overlap. With a
    ``target`` level, lesions of other levels are claimed only if no target lesion is left.
    A fold over the detections of an image, on preference lists made by the join above.
    """
    known = lesions.select("image_id", "lesion_id", "level")
    found = overlaps(lesions, detections, threshold).join(known, ["image_id", "lesion_id"])
    ignored = (F.col("level") != target).cast("int") if target is not None else F.lit(0)
    choice = F.struct(ignored.alias("ignored"), (-F.col("iou")).alias("minus_iou"), F.col("lesion_id").alias("lesion_id"))
    prefer = found.groupBy("image_id", "det_id").agg(F.transform(F.array_sort(F.collect_list(choice)), lambda x: x["lesion_id"]).alias("choices"))
    rows = detections.join(prefer, ["image_id", "det_id"])
    item = F.struct((-F.col("score")).alias("minus_score"), F.col("det_id").alias("det_id"), F.col("choices").alias("choices"))
    lists = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.lit(None).cast("string")

    def take(acc: Column, x: Column) -> Column:
        free = F.filter(x["choices"], lambda c: ~F.exists(acc, lambda a: F.coalesce(a["lesion_id"] == c, F.lit(False))))
        return F.concat(acc, F.array(F.struct(x["det_id"].alias("det_id"), F.coalesce(F.get(free, F.lit(0)), none).alias("lesion_id"))))

    empty = F.filter(F.array(F.struct(F.lit("").alias("det_id"), none.alias("lesion_id"))), lambda x: F.lit(False))
    taken = lists.select("image_id", F.explode(F.aggregate("items", empty, take)).alias("t")).select("image_id", "t.*").filter("lesion_id IS NOT NULL")
    return detections.join(taken, ["image_id", "det_id"], "left")


def average_precision(rows: DataFrame, positives: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_pos, ap): all-point interpolated; ``rows``: (keys, score, det_id, tp), ``positives``: (keys, n_pos).

    The envelope is the largest precision at this rank or behind it. Ranks and envelopes run over
    distinct scores in two levels; a window sorts the detections of one score only.
    """
    by_score = rows.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum(F.col("tp").cast("long")).alias("hits"))
    start = running(by_score, keys, "score", ["n", "hits"], descending=True).select(*keys, "score", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("hits_before", F.lit(0)).alias("hits_before"))
    tied = Window.partitionBy(*keys, "score")
    seen = tied.orderBy("det_id").rowsBetween(Window.unboundedPreceding, 0)
    rank = (F.col("n_before") + F.count("*").over(seen)).cast("double")
    ranked = rows.join(start, [*keys, "score"]).select(*keys, "score", "det_id", "tp", ((F.col("hits_before") + F.sum(F.col("tp").cast("long")).over(seen)) / rank).alias("precision"))
    peak = running(ranked.groupBy(*keys, "score").agg(F.max("precision").alias("peak")), keys, "score", ["peak"], largest=True).select(*keys, "score", F.col("peak_before").alias("behind"))
    best = F.max("precision").over(tied.orderBy(F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0))
    gains = ranked.select(*keys, "score", "tp", best.alias("best")).filter("tp").join(peak, [*keys, "score"])
    area = gains.groupBy(*keys).agg(F.sum(F.greatest("best", "behind")).alias("gain"))
    joined = positives.join(area, keys, "left") if keys else positives.join(area)
    value = F.when(F.col("n_pos") > 0, F.coalesce("gain", F.lit(0.0)) / F.col("n_pos"))
    return joined.select(*keys, "n_pos", value.alias("ap"))


def resampled_average_precision(rows: DataFrame, lesions: DataFrame, keys: list[str], seed: int, n_boot: int, in_arrays: int = IN_ARRAYS) -> tuple[DataFrame, DataFrame]:
    """``(values, samples)`` of the average precision by groups drawn with replacement: (keys, statistic, v), (keys, b, statistic, v).

    ``rows``: (keys, group_key, score, tp), ``lesions``: one row for each positive, (keys, group_key). Detections of one
    score enter together, so a resample costs as many rows as there are distinct scores. No detections: 0; no
    positives in a resample: NULL. Without keys, and with no more than ``in_arrays`` scores of groups, these are broadcast
    and a task makes whole resamples; else weights are joined to them, which gives the same.
    """
    # What the rows come from is computed once.
    counts = written(rows.groupBy(*keys, "group_key", "score").agg(F.count("*").alias("n"), F.sum(F.col("tp").cast("long")).alias("hits")))
    positives = written(lesions.groupBy(*keys, "group_key").agg(F.count("*").alias("n_pos")))
    index = written(group_index(counts.select("group_key").unionByName(positives.select("group_key"))))
    n = index.count()
    counts, positives = counts.join(index, "group_key"), positives.join(index, "group_key")
    if not keys and n > 1 and counts.count() <= in_arrays:
        ap = _resampled_in_arrays(counts, positives, n, seed, n_boot)
        return ap.filter("b < 0").drop("b"), ap.filter("b >= 0")
    w = weights(index, n, seed, n_boot).unionByName(index.select(F.lit(-1).alias("b"), "g", F.lit(1).cast("long").alias("w")))

    times = lambda c: F.sum(F.col(c) * F.col("w")).alias(c)
    curve = counts.join(w, "g").groupBy(*keys, "b", "score").agg(times("n"), times("hits"))
    total = positives.join(w, "g").groupBy(*keys, "b").agg(times("n_pos"))
    down = Window.partitionBy(*keys, "b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys, "b").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    curve = curve.select(*keys, "b", "score", "hits", (F.sum("hits").over(down) / F.sum("n").over(down)).alias("precision"))
    area = curve.select(*keys, "b", (F.col("hits") * F.max("precision").over(up)).alias("gain")).groupBy(*keys, "b").agg(F.sum("gain").alias("gain"))
    ap = total.join(area, [*keys, "b"], "left").select(*keys, "b", F.lit("ap").alias("statistic"), div(F.coalesce("gain", F.lit(0.0)), F.col("n_pos")).alias("v"))
    return ap.filter("b < 0").drop("b"), ap.filter("b >= 0")


def _resampled_in_arrays(counts: DataFrame, positives: DataFrame, n_groups: int, seed: int, n_boot: int) -> DataFrame:
    """(b, statistic, v), b = -1 for the data itself, from ``counts`` (g, score, n, hits) and ``positives`` (g, n_pos)."""
    spark = counts.sparkSession
    table = counts.select(F.col("g").cast("int").alias("g"), F.col("score").cast("double").alias("score"), "n", F.coalesce("hits", F.lit(0)).alias("hits")).toArrow()
    score, known = table.column("score").fill_null(0.0).to_numpy(), table.column("score").is_valid().to_numpy()
    order = np.lexsort((score, known))[::-1]  # from the highest score; NULL is the lowest, as in Spark
    score, known = score[order], known[order]
    same = (known[1:] == known[:-1]) & ((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))
    ends = np.flatnonzero(np.append(~same, True)) if len(order) else np.empty(0, np.int64)
    lean = lambda x: x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x
    g, n, hits = (lean(table.column(c).to_numpy()[order]) for c in ("g", "n", "hits"))
    found = positives.select("g", "n_pos").toArrow()
    n_pos = np.zeros(n_groups, np.int64)
    n_pos[found.column("g").to_numpy()] = found.column("n_pos").to_numpy()
    shared = spark.sparkContext.broadcast((g, n, hits, ends, n_pos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n, hits, ends, n_pos = shared.value
        slots = [np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1) for _, texts in draws.numbered(n_groups, "{}")]
        for batch in batches:
            kept, values = [], []
            for b in batch.column("id").to_pylist():
                w = np.ones(n_groups, np.int64)
                if b >= 0:
                    drawn = [d.ravel() % np.uint32(n_groups) for tails in slots for _, d in draws.digests([f"{seed}:{b}:".encode()], tails)]
                    w = np.bincount(np.concatenate(drawn), minlength=n_groups)
                if (total := int(w @ n_pos)) > 0:
                    kept.append(b)
                    values.append(_area(w, g, n, hits, ends) / total)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(values, pa.float64())], ["b", "v"])

    tasks = min(n_boot + 1, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(-1, n_boot, 1, tasks).mapInArrow(run, "b int, v double").select("b", F.lit("ap").alias("statistic"), "v")


def _area(w: np.ndarray, g: np.ndarray, n: np.ndarray, hits: np.ndarray, ends: np.ndarray) -> float:
    """Sum over scores of the hits of each by the best precision there or below; rows from the highest score, ``ends``: the last row of each score."""
    upto = np.zeros((2, len(ends)), np.int64)
    carry, done = np.zeros(2, np.int64), 0
    for lo in range(0, len(g), AT_ONCE):
        times = w[g[lo : lo + AT_ONCE]]
        stop = int(np.searchsorted(ends, lo + len(times)))
        for k, x in enumerate((n, hits)):
            sums = np.cumsum(times * x[lo : lo + AT_ONCE])
            upto[k, done:stop] = carry[k] + sums[ends[done:stop] - lo]
            carry[k] += sums[-1]
        done = stop
    precision = upto[1] / np.maximum(upto[0], 1)
    return float(np.diff(upto[1], prepend=0) @ np.maximum.accumulate(precision[::-1])[::-1])


def false_positives(images: DataFrame, matched: DataFrame, threshold: float) -> DataFrame:
    """(image_id, group_key, fp) of every image, those without boxes included."""
    counted = matched.filter(F.col("lesion_id").isNull() & (F.col("score") >= threshold)).groupBy("image_id").agg(F.count("*").alias("fp"))
    return images.join(counted, "image_id", "left").select("image_id", "group_key", F.coalesce("fp", F.lit(0)).alias("fp"))


def froc(lesions: DataFrame, matched: DataFrame, n_images: int, rates: list[float]) -> DataFrame:
    """(level, fp_rate, sensitivity) at the lowest threshold within each false-positive budget per image."""
    spark = lesions.sparkSession
    by_score = matched.groupBy("score").agg(F.sum(F.col("lesion_id").isNull().cast("long")).alias("fp"))
    steps = running(by_score, [], "score", ["fp"], descending=True)
    budget = spark.createDataFrame([(float(r),) for r in rates], "fp_rate double")
    cut = F.broadcast(budget).join(steps, F.col("fp") / F.lit(float(n_images)) <= F.col("fp_rate"), "left").groupBy("fp_rate").agg(F.min("score").alias("threshold"))
    scored = lesions.join(matched.filter("lesion_id IS NOT NULL").select("image_id", "lesion_id", "score"), ["image_id", "lesion_id"], "left")
    counted = scored.groupBy("level", "score").agg(F.count("*").alias("n"))
    rows = counted.join(F.broadcast(cut))
    hit = F.when(F.col("threshold").isNotNull() & (F.col("score") >= F.col("threshold")), F.col("n")).otherwise(0)
    return rows.groupBy("level", "fp_rate").agg(div(F.sum(hit), F.sum("n")).alias("sensitivity"))


def enumeration(truth: DataFrame, predicted: DataFrame, threshold: float) -> DataFrame:
    """One row (n_true, n_pred, correct): a predicted tooth counts if its number is true in the image and the boxes overlap."""
    both = predicted.select("image_id", "fdi", F.col("box").alias("p")).join(truth.select("image_id", "fdi", F.col("box").alias("t")), ["image_id", "fdi"])
    correct = both.filter(iou(F.col("p"), F.col("t")) >= threshold).agg(F.count("*").alias("correct"))
    return truth.agg(F.count("*").alias("n_true")).join(predicted.agg(F.count("*").alias("n_pred"))).join(correct)


def enumeration_counts(images: DataFrame, truth: DataFrame, predicted: DataFrame, threshold: float) -> DataFrame:
    """(image_id, group_key, n_true, n_pred, correct) of every image: the sums that precision and recall over images are ratios of."""
    both = predicted.select("image_id", "fdi", F.col("box").alias("p")).join(truth.select("image_id", "fdi", F.col("box").alias("t")), ["image_id", "fdi"])
    correct = both.filter(iou(F.col("p"), F.col("t")) >= threshold).groupBy("image_id").agg(F.count("*").alias("correct"))
    sizes = [rows.groupBy("image_id").agg(F.count("*").alias(name)) for rows, name in ((truth, "n_true"), (predicted, "n_pred"))]
    out = images
    for part in (*sizes, correct):
        out = out.join(part, "image_id", "left")
    return out.select("image_id", "group_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "n_pred", "correct")])


def copy_effect(honest: DataFrame, swapped: DataFrame, seed: int, n_boot: int = 2000) -> DataFrame:
    """(statistic, value, lo, hi, n_valid): precision and recall of a model that saw copies of the test images minus one that did not.

    Both are counts of the same images (``enumeration_counts``); rates are ratios of sums within each resample, and the
    resamples are shared, so a difference is paired.
    """
    sums = {c: F.col(c) for c in ("n_true", "n_pred", "correct")}
    finals = {"precision": div(F.col("correct"), F.col("n_pred")), "recall": div(F.col("correct"), F.col("n_true"))}
    with_copies, without = (Resampled(rows, sums, finals, [], seed, n_boot) for rows in (swapped, honest))
    return estimate(*difference(with_copies, without, paired=True), [])


def inventory(boxes: DataFrame, min_score: float) -> DataFrame:
    """Best box per (image, tooth) with enough score; the first id on ties."""
    best = F.max_by(F.struct("box", "score"), F.struct("score", (-F.col("ordinal")).alias("o")))
    return boxes.filter(F.col("score") >= min_score).groupBy("image_id", "fdi").agg(best.alias("b")).select("image_id", "fdi", "b.*")
