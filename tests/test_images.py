from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.functions import pixels
from auditframe.operators import dedup as dd
from auditframe.sources import images


def png(samples: np.ndarray, bits: int, colour: int, kinds: list[int]) -> bytes:
    """A PNG file of whole samples (rows, cols, n), its lines filtered by the given kinds in turn, straight from the format's definition."""
    height, width, n = samples.shape
    step = n * bits // 8
    lines = samples.astype(">u2" if bits == 16 else np.uint8).reshape(height, -1).view(np.uint8).reshape(height, -1)
    raw, above = b"", np.zeros(lines.shape[1], int)
    for y, line in enumerate(lines.astype(int)):
        kind = kinds[y % len(kinds)]
        out = []
        for x, v in enumerate(line):
            a, b, c = (line[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        raw += bytes([kind, *out])
        above = line
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    return pixels.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_every_filter(kinds):
    rng = np.random.default_rng(1)
    for bits, colour, n in ((8, 0, 1), (8, 2, 3), (16, 0, 1), (8, 4, 2), (8, 6, 4)):
        samples = rng.integers(0, 2**bits, (9, 7, n))
        want = samples[..., : 3 if n > 2 else 1].mean(axis=2) / (2**bits - 1)
        assert np.allclose(pixels.grey(png(samples, bits, colour, kinds)), want)


def test_unreadable():
    good = pixels.encode_png(np.ones((4, 4)))
    assert np.allclose(pixels.grey(good), 1)
    for bad in (b"", b"text", good[:20], good[:40]):
        with pytest.raises((pixels.UnreadableImage, struct.error)):
            pixels.grey(bad)
    jpeg = b"\xff\xd8\xff\xdb\x00\x05abc\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00\xff\xda\x00\x02"
    head = pixels.header(jpeg)
    assert (head["format"], head["height"], head["width"], head["bits"], len(head["tables"])) == ("JPEG", 16, 32, 8, 12)


def test_transforms():
    rng = np.random.default_rng(2)
    image = rng.random((40, 50))
    assert np.allclose(pixels.cosines(8) @ pixels.cosines(8).T, np.eye(8))
    assert np.allclose(pixels.shrunk(image, 4, 5), image.reshape(4, 10, 5, 10).mean(axis=(1, 3)))
    assert np.isclose(pixels.shrunk(image, 7, 9).mean(), image.mean()) and np.allclose(pixels.blurred(np.ones((5, 6))), 1)
    assert np.isclose(pixels.histogram(image).sum(), 1) and not pixels.thumbnail(np.ones((9, 9))).any()
    small = pixels.thumbnail(image)
    assert np.isclose(small.mean(), 0) and np.isclose(small.std(), 1)


def picture(seed: int, shape=(96, 128)) -> np.ndarray:
    rng = np.random.default_rng(seed)
    coarse = rng.random((6, 8))
    return np.clip(np.kron(coarse, np.ones((shape[0] // 6, shape[1] // 8))), 0, 1)


def test_signatures_find_edited_copies(spark):
    """A copy of another brightness and size is a near pair by both signals; other images are not; cached ones are not read again."""
    first = picture(1)
    contents = {"a": first, "b": np.clip(first * 0.9 + 0.02, 0, 1), "c": np.kron(first, np.ones((2, 2))), "d": picture(2), "e": picture(3)}
    rows = spark.createDataFrame([(k, bytearray(pixels.encode_png(v))) for k, v in contents.items()] * 2, "sha string, content binary")
    found = images.signatures(rows)
    assert found.count() == 5
    pairs = dd.near_pairs(found.withColumnRenamed("sha", "id"), 6, correlation=0.9)
    members = {r.id: r.representative for r in dd.members(found.withColumnRenamed("sha", "id")).collect()}
    alike = {frozenset((r.a, r.b)) for r in pairs.collect()} | {frozenset(x) for x in members.items() if x[0] != x[1]}
    assert alike and all(x <= {"a", "b", "c"} for x in alike)
    cache = spark.createDataFrame([("a", 7, [0.0])], images.SIGNATURE)
    assert {r.sha: r.sig for r in images.signatures(rows, cache).collect()}["a"] == 7
    assert images.signatures(rows.limit(0)).count() == 0


def test_fingerprint_features(spark):
    files = [(str(i), bytearray(pixels.encode_png(np.clip(picture(i, (48, 64) if i < 3 else (96, 128)) + np.random.default_rng(i).normal(0, 0.05, (48, 64) if i < 3 else (96, 128)), 0, 1)))) for i in range(6)]
    prints = images.fingerprints(spark.createDataFrame(files, "id string, content binary"))
    rows = {r.id: np.array(r.v) for r in images.fingerprint_features(prints).collect()}
    v = np.array([rows[str(i)] for i in range(6)])
    assert np.allclose(v.mean(axis=0), 0) and v.shape[1] > 10
    # Depth, format and tables are constant, and so is the shape's ratio: three blocks are left, each of weight one.
    assert np.isclose((v**2).sum() / len(v), 3)
    with pytest.raises(images.NoStructure):
        images.fingerprint_features(prints.filter(F.col("id") == "0"))
