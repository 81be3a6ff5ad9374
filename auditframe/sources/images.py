"""Signatures and fingerprints of images by content: one decoding per distinct content, in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import pixels

SIGNATURE = "sha string, sig long, thumb array<double>"
FINGERPRINT = "id string, height int, width int, bits int, format string, tables string, histogram array<double>, spectrum array<double>"
#: Rows of an Arrow batch of images.
BATCH = 64


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for sha, content in zip(batch["sha"].to_pylist(), batch["content"]):
            image = pixels.grey(content.as_py())
            rows.append((sha, pixels.perceptual_bits(image), pixels.thumbnail(image).tolist()))
        yield pa.RecordBatch.from_pydict(dict(zip(("sha", "sig", "thumb"), map(list, zip(*rows)) if rows else ([], [], []))), pa.schema([("sha", pa.string()), ("sig", pa.int64()), ("thumb", pa.list_(pa.float64()))]))


def signatures(contents: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(sha, sig, thumb) of each distinct content over (sha, content); those in ``cache`` are taken from there.

    Signatures are those that ``near_pairs`` compares. Bytes that are no readable image raise.
    """
    one = contents.groupBy("sha").agg(F.any_value("content").alias("content"))
    if cache is None:
        return one.mapInArrow(_signed, SIGNATURE)
    new = one.join(cache.select("sha"), "sha", "left_anti").mapInArrow(_signed, SIGNATURE)
    return cache.select("sha", "sig", "thumb").join(contents.select("sha"), "sha", "left_semi").unionByName(new)


def _printed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for key, content in zip(frame["id"], frame["content"]):
            content = bytes(content)
            head = pixels.header(content)
            image = pixels.grey(content) if head["format"] == "PNG" else None
            rows.append((key, head["height"], head["width"], head["bits"], head["format"], head["tables"], None if image is None else pixels.histogram(image).tolist(), None if image is None else pixels.noise_spectrum(image).tolist()))
        yield pd.DataFrame(rows, columns=["id", "height", "width", "bits", "format", "tables", "histogram", "spectrum"])


def fingerprints(files: DataFrame) -> DataFrame:
    """Acquisition fingerprint of each file over (id, content): size, depth, format, quantisation tables; histogram and noise spectrum of PNG files."""
    return files.select(F.col("id").cast("string").alias("id"), "content").mapInPandas(_printed, FINGERPRINT)


class NoStructure(ValueError):
    """Every feature is constant: nothing tells sites apart."""


def fingerprint_features(prints: DataFrame) -> DataFrame:
    """(id, v): features in six blocks, standardised, each block of one weight; constant columns fall away.

    Blocks: size and shape, depth, format, tables (one column per value), root of the histogram, spectrum. Files without
    pixels have zeros, the means, in the last two. A column is constant if its spread is below 1e-9 of its mean.
    """
    values = {c: sorted(r[0] for r in prints.select(c).distinct().limit(1001).collect()) for c in ("format", "tables")}
    if max(map(len, values.values()), default=0) > 1000:
        raise ValueError("more than 1,000 formats or tables: not a property of devices")
    widths = prints.agg(F.max(F.size("histogram")).alias("h"), F.max(F.size("spectrum")).alias("s")).first()
    blocks: list[list[Column]] = [
        [F.log("height"), F.log("width"), F.col("width") / F.col("height")], [F.col("bits").cast("double")],
        *[[(F.col(c) == v).cast("double") for v in values[c]] for c in ("format", "tables")],
        [F.sqrt(F.col("histogram")[i]) for i in range(max(widths.h or 0, 0))], [F.col("spectrum")[i] for i in range(max(widths.s or 0, 0))],
    ]
    named = [[f"c{b}_{i}" for i in range(len(block))] for b, block in enumerate(blocks)]
    flat = prints.select("id", *[c.alias(n) for block, names in zip(blocks, named) for c, n in zip(block, names)])
    names = reduce(list.__add__, named, [])
    found = flat.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    features = []
    for block in named:
        kept = [n for n in block if found[f"s_{n}"] is not None and found[f"s_{n}"] > 1e-9 * max(1.0, abs(found[f"m_{n}"]))]
        features += [F.coalesce((F.col(n) - found[f"m_{n}"]) / found[f"s_{n}"], F.lit(0.0)) / math.sqrt(len(kept)) for n in kept]
    if not features:
        raise NoStructure("every fingerprint feature is constant")
    return flat.select("id", F.array(*features).alias("v"))
