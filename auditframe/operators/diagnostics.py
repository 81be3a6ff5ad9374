"""Is a low rate of deep lesions a matter of detection or of a rare class? Rates, margins and a verdict from intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.numeric import div
from auditframe.operators.bootstrap import Resampled

#: With at most this share of deep lesions called deep, the depth call fails by imbalance.
RARELY = 0.1


def depth_rates(units: DataFrame, threshold: float, binary: float, seed: int, n_boot: int = 2000) -> DataFrame:
    """(statistic, value, lo, hi, n_valid) over units (group_key, level, p_lesion, called_deep, p_binary).

    detected_k: a lesion of level k reaches the threshold, whatever depth is called; correct_k: and its depth is right;
    binary_k: a head of two classes reaches its own threshold; gain_k: binary_k - detected_k, paired. A level
    without lesions has no values.
    """
    seen, called, two = F.col("p_lesion") >= threshold, F.col("called_deep"), F.col("p_binary") >= binary
    sums: dict[str, Column] = {}
    finals: dict[str, Column] = {}
    for k, right in ((1, ~called), (2, called)):
        here = F.col("level") == k
        parts = {"n": here, "detected": here & seen, "correct": here & seen & right, "binary": here & two}
        sums |= {f"{name}_{k}": test.cast("long") for name, test in parts.items()}
        rate = {name: div(F.col(f"{name}_{k}"), F.col(f"n_{k}")) for name in ("detected", "correct", "binary")}
        finals |= {f"{name}_{k}": value for name, value in rate.items()} | {f"gain_{k}": rate["binary"] - rate["detected"]}
    return Resampled(units, sums, {name: finals[name] for name in sorted(finals)}, [], seed, n_boot).estimates()


def margins(units: DataFrame, threshold: float, level: int = 2) -> DataFrame:
    """One row: lesions of the level, how many are called deep, how many are missed, the share of these within half of the threshold, their median."""
    rows, p = units.filter(F.col("level") == level), F.col("p_lesion")
    missed = p < threshold
    return rows.agg(
        F.count("*").alias("n"), F.count_if("called_deep").alias("called_deep"), F.count_if(missed).alias("missed"),
        div(F.count_if(missed & (p >= threshold / 2)), F.count_if(missed)).alias("just_below"), F.percentile(F.when(missed, p), 0.5).alias("median_missed"),
    )


def verdicts(gain: tuple[float | None, float | None], gap: tuple[float | None, float | None], n: int, called_deep: int) -> dict[str, str]:
    """What the bounds say: ``gain`` of the head of two classes on deep lesions, ``gap`` of the AUC of deep minus shallow lesions."""
    depth = "imbalance" if n and called_deep <= RARELY * n else "called"
    if n == 0:
        return {"depth": "no deep lesions", "detection": "no deep lesions"}
    if gain[0] is not None and gain[0] > 0:
        return {"depth": depth, "detection": "imbalance"}
    if gap[1] is not None and gap[1] < 0:
        return {"depth": depth, "detection": "difficulty"}
    return {"depth": depth, "detection": "unresolved"}
