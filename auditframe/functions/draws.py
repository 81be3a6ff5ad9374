"""The draws of ``numeric.draw`` for many texts at once, in NumPy: MD5 of every text made of one of some heads and one of some tails."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts hashed at once, so that the state stays in the cache.
AT_ONCE = 8192
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PLACES = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(state: list[np.ndarray], words: list, last: bool) -> None:
    """One block of 16 ``words`` (numbers, or arrays as long as those of ``state``) into ``state``, in place; of the ``last`` block only the first number is right."""
    a, b, c, d = (x.copy() for x in state)
    t, u = np.empty_like(a), np.empty_like(a)
    for i in range(61 if last else 64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif turn == 1:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif turn == 2:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        word = words[_PLACES[turn](i)]
        t += a
        if isinstance(word, np.ndarray):
            t += word
            word = 0
        t += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        shift = _SHIFTS[turn][i % 4]
        np.left_shift(t, np.uint32(shift), out=u)
        np.right_shift(t, np.uint32(32 - shift), out=t)
        np.bitwise_or(t, u, out=t)
        t += b
        a, b, c, d, t = d, t, b, c, a
    if last:
        state[0] += b
    else:
        for x, y in zip(state, (a, b, c, d)):
            x += y


def digests(heads: list[bytes], tails: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((k, l), array): for the heads from k on (rows) and the tails from l on (columns), the first 32 bits of the MD5 of each head (all of one length) followed by each row of bytes of ``tails``."""
    n, width = tails.shape
    size = len(heads[0]) + width
    blocks = (size + 8) // 64 + 1
    ends = np.zeros((n, 64 * blocks), np.uint8)
    ends[:, len(heads[0]) : size] = tails
    ends[:, size] = 0x80
    ends[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    begins = np.zeros((len(heads), 64 * blocks), np.uint8)
    begins[:, : len(heads[0])] = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), -1)
    ends, begins = (np.ascontiguousarray(x.view("<u4").T).astype(np.uint32) for x in (ends, begins))
    for lo in range(0, n, AT_ONCE):
        part = ends[:, lo : lo + AT_ONCE]
        step = max(1, AT_ONCE // part.shape[1])
        tiled = [int(x[0]) if (x == x[0]).all() else np.tile(x, step) for x in part]
        for k in range(0, len(heads), step):
            some = begins[:, k : k + step]
            m = some.shape[1] * part.shape[1]
            words = []
            for x, y in zip(some, tiled):
                if isinstance(y, np.ndarray):
                    y = y[:m] | np.repeat(x, part.shape[1]) if x.any() else y[:m]
                elif (x == x[0]).all():
                    y |= int(x[0])
                else:
                    y = np.repeat(x, part.shape[1]) | np.uint32(y)
                words.append(y)
            state = [np.full(m, s, np.uint32) for s in _START]
            for block in range(blocks):
                _block(state, words[16 * block : 16 * block + 16], block == blocks - 1)
            yield (k, lo), state[0].byteswap().reshape(some.shape[1], -1)


def of_one_length(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, their bytes as rows) of ``texts`` of each length."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([texts[i] for i in at]), np.uint8).reshape(len(at), int(size))


def numbered(n: int, form: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first, texts) of the numbers 0 to ``n`` - 1 in ``form``, by their number of digits."""
    first = 0
    while first < n:
        upto = min(n, 10 ** len(str(first)))
        yield first, [form.format(b).encode() for b in range(first, upto)]
        first = upto
