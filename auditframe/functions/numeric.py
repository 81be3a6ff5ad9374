"""Scalar column functions. Undefined results are NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-digit FDI tooth numbers, quadrants 1-4 with teeth 1-8.
FDI = [10 * q + t for q in range(1, 5) for t in range(1, 9)]
#: Quadrants facing each other when an image is mirrored.
MIRRORED_QUADRANT = {1: 2, 2: 1, 3: 4, 4: 3}


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up rounding that two engines compute alike."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def uniform(text: Column) -> Column:
    """Deterministic number in [0, 1) from a string, in steps of one millionth."""
    return draw(text, F.lit(1_000_000)) / F.lit(1_000_000.0)


def draw(text: Column, n: Column) -> Column:
    """Deterministic integer in [0, n) from a string."""
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), n.cast("long"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2)."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return div(width * height, area(a) + area(b) - width * height)


def band(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the interval of a value; an edge belongs to the upper interval, NULL stays NULL."""
    out = F.when(value < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:]):
        out = out.when(value < edge, name)
    return out.when(value >= edges[-1], names[-1])


def age_band(age: Column) -> Column:
    return band(age, [18, 35, 50, 65], ["<18", "18-34", "35-49", "50-64", "65+"])


def mirror_fdi(fdi: Column) -> Column:
    """The tooth number seen at the same place in a mirrored image."""
    quadrant = F.floor(fdi / 10)
    return sum((F.when(quadrant == q, F.lit(10 * m)).otherwise(F.lit(0)) for q, m in MIRRORED_QUADRANT.items()), F.lit(0)) + fdi % 10


def fdi_label(fdi: Column) -> Column:
    """Class index 1-32 of a tooth number."""
    return (F.floor(fdi / 10) - 1) * 8 + fdi % 10


def label_fdi(label: Column) -> Column:
    return (F.floor((label - 1) / 8) + 1) * 10 + (label - 1) % 8 + 1


def region(fdi: Column) -> Column:
    """Part of the mouth, by the tooth's place in its quadrant."""
    place = fdi % 10
    return F.when(place <= 2, "incisor").when(place == 3, "canine").when(place <= 5, "premolar").otherwise("molar")


def grade_at(probs: Column, threshold: Column | float) -> Column:
    """Grade from class probabilities: sound below the threshold, else the likeliest lesion grade, the milder on ties."""
    lesion = F.slice(probs, F.lit(2), F.size(probs) - 1)
    return F.when(1 - probs[0] >= threshold, F.array_position(lesion, F.array_max(lesion)).cast("int")).otherwise(F.lit(0))


def p_of_z(z: float) -> float:
    """Two-sided p-value of a standard normal deviate."""
    return math.erfc(abs(z) / math.sqrt(2))


def p_of_chi_square(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by its finite sums for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        return min(1.0, math.fsum(math.exp(-half + i * math.log(half) - math.lgamma(i + 1)) for i in range(df // 2)))
    tail = (math.exp(-half + (i - 0.5) * math.log(half) - math.lgamma(i + 0.5)) for i in range(1, (df + 1) // 2))
    return min(1.0, math.erfc(math.sqrt(half)) + math.fsum(tail))
