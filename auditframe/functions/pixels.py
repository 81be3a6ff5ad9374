"""Grey images from PNG bytes, and what is read off them: perceptual bits, thumbnails, histograms, noise spectra.

Plain numpy, for use within Arrow batches. PNG is lossless and simple enough to read here (8 and 16 bits, grey, colour and
palette, with or without alpha, not interlaced); JPEG files give their header and quantisation tables only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GRID, LOW = 32, 8


class UnreadableImage(ValueError):
    """Bytes that are no image of a form that is read here."""


def _chunks(data: bytes):
    at = len(MAGIC)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Scan lines without their filters: by row, as each depends on the one above; left-going ones by pixel."""
    rows = np.frombuffer(raw, np.uint8)
    if rows.size < height * (stride + 1):
        raise UnreadableImage("image data ends early")
    rows = rows[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            lanes = np.zeros(-(-stride // step) * step, np.uint8)
            lanes[:stride] = line
            out[y] = np.cumsum(lanes.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            now = bytearray(stride)
            up, given = above.tobytes(), line.tobytes()
            for x in range(stride):
                left = now[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) >> 1
                else:
                    corner = up[x - step] if x >= step else 0
                    near = [abs(up[x] - corner), abs(left - corner), abs(left + up[x] - 2 * corner)]
                    guess = (left, up[x], corner)[near.index(min(near))]
                now[x] = (given[x] + guess) & 255
            out[y] = np.frombuffer(bytes(now), np.uint8)
        else:
            raise UnreadableImage(f"unknown filter {kind}")
        above = out[y]
    return out


def grey(data: bytes) -> np.ndarray:
    """Values in [0, 1] of a PNG image: colours are averaged, alpha is ignored, 65535 is one if the file has 16 bits."""
    if not data or data[: len(MAGIC)] != MAGIC:
        raise UnreadableImage("not a PNG image")
    head, body, palette = None, [], None
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[3] not in SAMPLES or head[6] or not head[0] or not head[1]:
        raise UnreadableImage("an interlaced, empty or headless PNG image")
    width, height, bits, colour = head[:4]
    n = SAMPLES[colour]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise UnreadableImage(str(e)) from e
    stride = -(-width * n * bits // 8)
    lines = _unfiltered(raw, height, stride, max(1, n * bits // 8))
    if bits == 16:
        values = lines.reshape(height, width * n, 2).astype(np.float64) @ (256.0, 1.0)
    elif bits == 8:
        values = lines.astype(np.float64)
    else:
        ones = np.unpackbits(lines, axis=1)[:, : width * n * bits].reshape(height, width * n, bits)
        values = ones.astype(np.float64) @ (2.0 ** np.arange(bits - 1, -1, -1))
    pixels = values.reshape(height, width, n)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise UnreadableImage("a palette without its colours")
        return palette[pixels[..., 0].astype(int)].mean(axis=2) / 255.0
    return pixels[..., : 3 if n > 2 else 1].mean(axis=2) / (2.0**bits - 1)


def header(data: bytes) -> dict:
    """Format, size, depth and a digest of the quantisation tables (empty if not JPEG) without decoding a pixel."""
    if data[: len(MAGIC)] == MAGIC and len(data) >= 33:
        width, height, bits = struct.unpack_from(">IIB", data, 16)
        return {"format": "PNG", "width": width, "height": height, "bits": bits, "tables": ""}
    if data[:2] != b"\xff\xd8":
        raise UnreadableImage("neither PNG nor JPEG")
    at, tables, size = 2, [], None
    while at + 4 <= len(data) and data[at] == 255:
        kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if kind == 0xDB:
            tables.append(data[at + 4 : at + 2 + n])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            size = struct.unpack_from(">BHH", data, at + 4)
        if kind == 0xDA:
            break
        at += 2 + n
    if size is None:
        raise UnreadableImage("a JPEG image without a frame")
    return {"format": "JPEG", "width": size[2], "height": size[1], "bits": size[0], "tables": hashlib.sha1(b"".join(sorted(tables))).hexdigest()[:12] if tables else ""}


def shrunk(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over a grid of equal areas; pixels on a border of the grid count for both sides in their shares."""

    def share(size: int, parts: int) -> np.ndarray:
        edges = np.linspace(0, size, parts + 1)
        lo, hi = np.arange(size), np.arange(size) + 1
        part = np.minimum(hi[None], edges[1:, None]) - np.maximum(lo[None], edges[:-1, None])
        return np.clip(part, 0, None) * (parts / size)

    return share(image.shape[0], rows) @ image @ share(image.shape[1], cols).T


def cosines(n: int) -> np.ndarray:
    """The orthonormal matrix of the cosine transform."""
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def perceptual_bits(image: np.ndarray) -> int:
    """64 bits: which of the lowest 8 x 8 frequencies lie above their median (that of all but the constant one)."""
    c = cosines(GRID)
    low = (c @ shrunk(image, GRID, GRID) @ c.T)[:LOW, :LOW].ravel()
    bits = np.packbits(low > np.median(low[1:]))
    return int(np.frombuffer(bits.tobytes(), ">i8")[0])


def thumbnail(image: np.ndarray, rows: int = 32, cols: int = 64) -> np.ndarray:
    """Small image with mean 0 and spread 1; all zeros if it is flat."""
    small = shrunk(image, rows, cols).ravel()
    spread = small.std()
    return (small - small.mean()) / spread if spread > 1e-12 else np.zeros_like(small)


def histogram(image: np.ndarray, bins: int = 32) -> np.ndarray:
    counts = np.bincount(np.minimum((image.ravel() * bins).astype(int), bins - 1), minlength=bins)
    return counts / counts.sum()


def blurred(image: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Gaussian blur, the image mirrored at its edges."""
    reach = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=axis)
        image = windows @ weight
    return image


def noise_spectrum(image: np.ndarray, bins: int = 16, tile: int = 64) -> np.ndarray:
    """Log power of what a blur removes, averaged over tiles and over rings of equal frequency."""
    rest = image - blurred(image)
    h, w = min(tile, rest.shape[0]), min(tile, rest.shape[1])
    tiles = [rest[y : y + h, x : x + w] for y in range(0, rest.shape[0] - h + 1, h) for x in range(0, rest.shape[1] - w + 1, w)]
    power = np.mean([np.abs(np.fft.fft2(t - t.mean())) ** 2 for t in tiles], axis=0)
    fy, fx = np.fft.fftfreq(h) * h, np.fft.fftfreq(w) * w
    ring = np.minimum((np.hypot(fy[:, None], fx[None]) / (min(h, w) / 2) * bins).astype(int), bins - 1).ravel()
    total = np.bincount(ring, weights=power.ravel(), minlength=bins) / np.maximum(np.bincount(ring, minlength=bins), 1)
    return np.log(total + 1e-12)


def encode_png(values: np.ndarray) -> bytes:
    """A grey 8-bit PNG file of values in [0, 1]."""
    pixels = np.rint(np.clip(values, 0, 1) * 255).astype(np.uint8)
    raw = np.pad(pixels, [(0, 0), (1, 0)]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
