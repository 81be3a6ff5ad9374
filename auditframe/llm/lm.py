"""Language-model scoring with an Elias-Fano n-gram trie of order 3.

*Counting.* One pass counts words by hash; the sorted hashes of a range are a vocabulary
piece, and a word's id is its rank. A second pass counts trigrams of ids. Map tasks
aggregate slices of the corpus and send sorted, packed count lists, so a frequent word or
n-gram is one entry per slice; a trigram belongs to the piece that the cumulative count of
its first word and its second id give, so the successors of a frequent word are spread
over pieces. All training rows are counted, and every n-gram counted is kept: only those
seen fewer than ``PRUNE`` times, none as it is set, would leave levels 2 and 3.

*Trie.* A piece is one file in the shared folder, memory-mapped by its readers: levels 2 and 3
are monotone sequences of (context base + word id) in Elias-Fano form, cumulative word counts
are monotone pointers in the same form, and smoothed probabilities and backoff weights are
quantised to 8 bits (rounded down), spread over the range that occurs in the piece; backoff
weights are what the quantised probabilities leave, so no mass is lost to the codes. An n-gram is found by successor search relative to the
base of its context: two selects on the upper bits, and bisection of the lower bits between.

*Smoothing.* Interpolated absolute discounting: p(w|c) = max(n - D, 0)/n(c) + backoff(c) p(w|c'),
down to the add-one word model; a context starts with the end token of the text before.

Defined results: a null text is the empty text, one end token; with no training rows all
probabilities are those of the base model; a null id counts as training row; repeated rows
count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.common import give_back, shared_dir, table, tidy

PRUNE, DISCOUNT = 1, 0.75
#: Tokens counted at once in a map task; bytes of text per vocabulary piece, tokens per trie piece.
SLICE_TOKENS, PIECE_BYTES, PIECE_TOKENS = 1_200_000, 24_000_000, 4_000_000
#: Mapped files that a worker keeps open.
MAPPED = 1024
#: Entries that a merge orders, and an encoder packs, at once: their working arrays are as large as this, not as a piece.
AT_ONCE = 1 << 18
#: Backoff of a context whose successors leave nothing but a rounding error.
LEAST = 1e-12
#: Quantisation of log10: codes from 0 (one) to 254 (the least value of the array); code 255 means none.
NONE = 255
END = b""
U64 = np.uint64
END_HASH = xxhash.xxh3_64_intdigest(END)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes split at exactly the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: Bytes hashed at once; longer words are hashed alone.
HASH_BYTES, BASE = 1 << 20, 0x9E3779B97F4A7C15
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: A number for each byte, the same for upper and lower case.
BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([i]).lower(), 1) for i in range(256)], U64)


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    both = [np.full(HASH_BYTES + 1, x & (2**64 - 1), U64) for x in (BASE, pow(BASE, -1, 2**64))]
    for x in both:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return both[0], both[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (as ``words_of``) of texts that lie in ``data`` one after the other, and how many each text has.

    A word b of n bytes has the hash of sum(BYTE[b(i)] * BASE^-i): a difference of prefix sums, so no word is touched by itself.
    """
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = inside[1:-1][edges]
    end[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    out, k = np.empty(len(starts), U64), 0
    forward, inverse = powers()
    while k < len(starts):
        at = starts[k]
        last = int(np.searchsorted(ends, at + HASH_BYTES, "right"))
        if last == k:
            out[k] = xxhash.xxh3_64_intdigest(data[at : ends[k]].tobytes().lower())
            k += 1
            continue
        part = BYTE[data[at : ends[last - 1]]]
        part *= inverse[: len(part)]
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(part, dtype=U64)])
        s, e = starts[k:last] - at, ends[k:last] - at
        h = (sums[e] - sums[s]) * forward[s] + (e - s).astype(U64)
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        out[k:last] = h ^ (h >> U64(32))
        k = last
    return out, np.diff(np.searchsorted(starts, offsets))


# --- Elias-Fano -----------------------------------------------------------------------------------


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit in each word."""
    word, k, at = word.copy(), k.astype(np.int64), np.zeros(len(word), np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & U64((1 << shift) - 1)).astype(np.int64)
        go = k >= ones
        k -= np.where(go, ones, 0)
        at += np.where(go, shift, 0)
        word = np.where(go, word >> U64(shift), word)
    return at


class EliasFano:
    """A monotone sequence of n values: packed lower bits, upper bits in unary with the number of ones before each word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[dict, list[np.ndarray]]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, U64)
        size = (top >> bits) + n + 2
        high = np.zeros(size // 64 + 1, U64)
        for a in range(0, n, AT_ONCE):
            part, index = values[a : a + AT_ONCE], np.arange(a, min(a + AT_ONCE, n))
            place = (part >> U64(bits)).astype(np.int64) + index
            np.bitwise_or.at(high, place >> 6, U64(1) << (place & 63).astype(U64))
            if bits:
                part = part & U64((1 << bits) - 1)
                at = index.astype(U64) * U64(bits)
                word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
                np.bitwise_or.at(low, word, part << shift)
                over = shift > U64(64 - bits)
                np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return {"n": n, "bits": bits}, [low, high, ones]

    def lower(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i.astype(U64) * U64(self.bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        value = self.low[word] >> shift
        over = shift > U64(64 - self.bits)
        if over.any():
            value[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return value & U64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = (word << 6) + _select(self.high[word], i - self.ones[word])
        return ((place - i).astype(U64) << U64(self.bits)) | self.lower(i)

    def _zero(self, k: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, bits, place) of the zero behind the values whose upper part is k: the ones before it, the zeros of its word, its place there."""
        word = np.minimum(np.searchsorted(zeros, k, "right") - 1, len(self.high) - 1)
        bits = ~self.high[word]
        place = _select(bits, k - zeros[word])
        return (word << 6) + place - k, bits, place

    def _bucket(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the values whose upper part is k: the ones between two zeros."""
        zeros = (np.arange(len(self.ones), dtype=np.int64) << 6) - self.ones
        end, bits, place = self._zero(k, zeros)
        bits &= (U64(1) << place.astype(U64)) - U64(1)
        for shift in (1, 2, 4, 8, 16, 32):
            bits |= bits >> U64(shift)
        begin = end - place + np.bitwise_count(bits).astype(np.int64)  # behind the zero before, if it is in this word
        far = np.flatnonzero((bits == 0) & (k > 0))
        begin[(bits == 0) & (k == 0)] = 0
        if len(far):
            begin[far] = self._zero(k[far] - 1, zeros)[0]  # in an earlier word; no further, however long the runs of ones
        return begin, end

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is absent."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        upper = (values >> U64(self.bits)).astype(np.int64)
        most = len(self.high) * 64 - self.n - 1  # zeros there are
        inside = np.flatnonzero(upper < most)
        upper, goal = upper[inside], values[inside] & U64((1 << self.bits) - 1)
        at, end = self._bucket(upper)
        end = np.minimum(end, self.n)
        # Most buckets hold one value or two: look at the first ones in turn, and bisect what is left.
        live = np.flatnonzero(at < end)
        at, end, goal, where = at[live], end[live], goal[live], inside[live]
        for _ in range(3):
            low = self.lower(at)
            hit = low == goal
            out[where[hit]] = at[hit]
            live = np.flatnonzero((low < goal) & (at + 1 < end))
            at, end, goal, where = at[live] + 1, end[live], goal[live], where[live]
            if not len(at):
                return out
        a, b = at, end.copy()
        live = np.arange(len(a))
        while len(live):
            middle = (a[live] + b[live]) >> 1
            less = self.lower(middle) < goal[live]
            a[live[less]] = middle[less] + 1
            b[live[~less]] = middle[~less]
            live = live[a[live] < b[live]]
        hit = np.flatnonzero(a < end)
        hit = hit[self.lower(a[hit]) == goal[hit]]
        out[where[hit]] = a[hit]
        return out


# --- Files ----------------------------------------------------------------------------------------


def write_arrays(uri: str, head: dict, arrays: list[np.ndarray]) -> None:
    """One file, written aside and renamed, so that a repeated task leaves the same file."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    head = json.dumps(head | {"arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    aside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(len(head).to_bytes(8, "little") + head + bytes(-(8 + len(head)) % 64))
        for a in arrays:
            data = np.ascontiguousarray(a).tobytes()
            out.write(data + bytes(-len(data) % 64))
    system.move(aside, path)


@lru_cache(MAPPED)
def mapped(uri: str) -> tuple[dict, list[np.ndarray]]:
    """The arrays of a file, memory-mapped.

    A file of a store without local paths is copied to the worker's temporary folder first, and unlinked
    there: its space is free again when ``MAPPED`` other files were read, or the worker ends.
    """
    system, path = fs.FileSystem.from_uri(uri)
    if not isinstance(system, fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), uuid.uuid4().hex)
        fs.copy_files(path, local, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        data = np.memmap(local, np.uint8, "r")
        os.unlink(local)
    else:
        data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(bytes(data[:8]), "little")
    head = json.loads(bytes(data[8 : 8 + size]))
    at, arrays = -(-(8 + size) // 64) * 64, []
    for kind, n in head["arrays"]:
        end = at + n * np.dtype(kind).itemsize
        arrays.append(np.asarray(data[at:end]).view(kind))
        at = -(-end // 64) * 64
    return head, arrays


def _packed(*columns: np.ndarray) -> bytes:
    """Byte planes of each column, compressed. The first column is sorted and sent as differences."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in (first, *columns[1:]))
    return zstandard.ZstdCompressor(1).compress(planes)


def _unpacked(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind)[:, 0])
        at += n * size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


# --- Counting -------------------------------------------------------------------------------------


def _taken(parts: list[np.ndarray]) -> np.ndarray:
    """All ``parts`` in one array, out of the list, so that who gets it holds it alone."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(hashes of all words with an end after each text, words per text with the end, ids of the texts) of slices of whole texts."""
    parts, sizes, ids, held = [], [], [], 0
    for batch in batches:
        text = batch.column(1).cast(pa.large_binary())
        if not len(text):
            continue
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        begin = 0
        while begin < len(text):  # texts of about four times HASH_BYTES
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + 4 * HASH_BYTES, "right")) - 1)
            flat, counts = word_hashes(data, offsets[begin : end + 1])
            flat, counts, docs = np.insert(flat, np.cumsum(counts), U64(END_HASH)), counts + 1, batch.column(0).slice(begin, end - begin).to_pylist()
            begin = end
            ends, start = np.cumsum(counts), 0
            while start < len(docs):
                before = int(ends[start - 1]) if start else 0
                stop = min(int(np.searchsorted(ends, before + SLICE_TOKENS - held)) + 1, len(docs))
                parts.append(flat[before : int(ends[stop - 1])])
                sizes.append(counts[start:stop])
                ids += docs[start:stop]
                held, start = held + len(parts[-1]), stop
                if held >= SLICE_TOKENS:
                    yield _taken(parts), _taken(sizes), ids
                    ids, held = [], 0
    if ids:
        yield _taken(parts), _taken(sizes), ids


ROWS = "piece int, n int, blob binary"


def _rows(pieces: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each run of equal ``pieces``."""
    cut = np.flatnonzero(np.diff(pieces, prepend=-1))
    ends = [*cut[1:].tolist(), len(pieces)]
    blobs = [_packed(*(c[a:b] for c in columns)) for a, b in zip(cut.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(pieces[cut], pa.int32()), pa.array(np.array(ends) - cut, pa.int32()), pa.array(blobs, pa.binary())], ["piece", "n", "blob"])


def vocabulary_piece(hashes: np.ndarray, pieces: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(pieces) >> U64(32)).astype(np.int64)


def _count_words(pieces: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, _, _ in _token_slices(batches):
            keys, counts = np.unique(flat, return_counts=True)
            yield _rows(vocabulary_piece(keys, pieces), [keys, counts.astype(np.int64)])

    return run


def _merge_words(path: str) -> Callable:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        try:
            return merge(key[0].as_py(), group)
        finally:
            give_back()

    def merge(piece: int, group: pa.Table) -> pa.Table:
        parts = [_unpacked(b, n, U64, np.int64) for n, b in zip(group.column("n").to_pylist(), group.column("blob").to_pylist())]
        keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
        cumulative = np.concatenate([[0], np.cumsum(counts)]).astype(U64)
        (words, a), (totals, b) = EliasFano.arrays(keys), EliasFano.arrays(cumulative)
        write_arrays(f"{path}/words-{piece}", {"words": words, "totals": totals}, a + b)
        return pa.table({"piece": pa.array([piece], pa.int32()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    return run


class Words:
    """The first level: ids, counts and cumulative counts of words."""

    def __init__(self, path: str, types: list[int], tokens: list[int]):
        self.path, self.pieces = path, len(types)
        self.first = np.concatenate([[0], np.cumsum(types)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(tokens)]).astype(np.int64)
        self.types, self.tokens = int(self.first[-1]), int(self.before[-1])

    def _piece(self, i: int) -> tuple[EliasFano, EliasFano]:
        head, arrays = mapped(f"{self.path}/words-{i}")
        return tuple(EliasFano(head[k]["n"], head[k]["bits"], *arrays[3 * j : 3 * j + 3]) for j, k in enumerate(("words", "totals")))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each (sorted) hash; ``types`` where it is unknown."""
        out = np.full(len(hashes), self.types, np.int64)
        place = vocabulary_piece(hashes, self.pieces)
        for i in np.unique(place):
            if self.first[i] == self.first[i + 1]:
                continue
            at = np.flatnonzero(place == i)
            found = self._piece(i)[0].find(hashes[at])
            out[at[found >= 0]] = found[found >= 0] + self.first[i]
        return out

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, count of all words before) of each id; zero and all for unknown ones."""
        count, before = np.zeros(len(ids), np.int64), np.full(len(ids), self.tokens, np.int64)
        place = np.searchsorted(self.first, ids, "right") - 1
        place[ids >= self.types] = -1
        for i in np.unique(place[place >= 0]):
            at = np.flatnonzero(place == i)
            totals, local = self._piece(i)[1], ids[at] - self.first[i]
            begin = totals.access(local).astype(np.int64)
            count[at], before[at] = totals.access(local + 1).astype(np.int64) - begin, begin + self.before[i]
        return count, before


def trie_piece(count: np.ndarray, before: np.ndarray, second: np.ndarray, words: Words, pieces: int) -> np.ndarray:
    """Piece of (first word, second word): by the cumulative count, divided further by the second id."""
    at = (before + count * (second / (words.types + 1.0))) / max(words.tokens, 1)
    return np.minimum((at * pieces).astype(np.int64), pieces - 1)


@dataclass
class Sequence:
    """Texts of a slice, each with an end before and behind it: places in a table of the slice's distinct words."""

    at: np.ndarray
    begins: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, lengths: np.ndarray, words: Words) -> Sequence:
        keys, inverse = np.unique(flat, return_inverse=True)
        ids = words.ids(keys)
        ends = np.cumsum(lengths)
        at = np.insert(inverse.astype(np.int32), ends - lengths, np.searchsorted(keys, U64(END_HASH)))
        return Sequence(at, ends - lengths + np.arange(len(lengths)), ids, *words.counts(ids))


def _count_trigrams(words: Words, pieces: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, lengths, _ in _token_slices(batches):
            slice_ = Sequence.of(flat, lengths, words)
            del flat
            s = slice_.ids[slice_.at]
            third = np.append(s[2:], [words.types, words.types]).astype(np.uint32)
            last = np.append(slice_.begins[1:], len(s)) - 1  # each text's final end begins nothing
            third[last - 1] = words.types  # and nothing follows it
            keep = np.ones(len(s), bool)
            keep[last] = False
            keep = np.flatnonzero(keep)
            second, first, third = s[keep + 1], slice_.at[keep], third[keep]
            del s, keep
            piece = trie_piece(slice_.counts[first], slice_.before[first], second, words, pieces).astype(np.int32)
            pair = slice_.ids[first].astype(U64)
            pair *= U64(words.types + 1)
            pair += second.astype(U64)
            del slice_, first, second
            order = np.lexsort((third, pair))
            piece, pair, third = piece[order], pair[order], third[order]
            del order
            new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
            seen = np.diff(np.append(new, len(pair))).astype(np.uint32)
            piece, pair, third = piece[new], pair[new], third[new]
            by_piece = np.argsort(piece, kind="stable")
            rows = _rows(piece[by_piece], [pair[by_piece], third[by_piece], seen[by_piece]])
            del piece, pair, third, seen, new, by_piece
            yield rows

    return run


def quantised(p: np.ndarray) -> tuple[np.ndarray, float]:
    """8-bit codes of positive probabilities, rounded down, and their steps per power of ten: 1/40 or less as long as the least fits, so none reads as zero."""
    most = max(0.0, -float(np.log10(p.min()))) if len(p) else 0.0
    steps = min(40.0, (NONE - 1) / most) if most > 0 else 40.0
    codes = np.empty(len(p), np.uint8)
    for a in range(0, len(p), AT_ONCE):
        cost = np.maximum(-np.log10(p[a : a + AT_ONCE]), 0.0)
        codes[a : a + AT_ONCE] = np.minimum(np.ceil(cost * steps - 1e-9), NONE - 1)
    return codes, steps


def levels(steps: float) -> np.ndarray:
    return np.append(10.0 ** (-np.arange(NONE) / steps), 0.0)


def merged(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, third, count) of count lists, each sorted by pair and third; every n-gram once, in order.

    Ranges of the key are put in order one after the other; a pair of more entries than ``AT_ONCE`` is ranges of its thirds.
    """
    n = sum(len(p[0]) for p in parts)
    out, size = (np.empty(n, U64), np.empty(n, np.uint32), np.empty(n, np.int64)), 0

    def ranges(parts: list[list[np.ndarray]], by: int) -> Iterator[list[list[np.ndarray]]]:
        step = max(1, AT_ONCE // 4096)
        sample = np.sort(np.concatenate([p[by][::step] for p in parts]))
        cuts = np.unique(sample[AT_ONCE // step :: AT_ONCE // step])
        ends = [[0, *np.searchsorted(p[by], cuts, "left").tolist(), len(p[by])] for p in parts]
        for i in range(len(cuts) + 1):
            here = [[x[e[i] : e[i + 1]] for x in p] for p, e in zip(parts, ends) if e[i] < e[i + 1]]
            if not here:
                continue
            if by == 0 and sum(len(p[0]) for p in here) > 2 * AT_ONCE and min(p[0][0] for p in here) == max(p[0][-1] for p in here):
                yield from ranges(here, 1)
            else:
                yield here

    for here in ranges(parts, 0) if n else ():
        pair, third, seen = (np.concatenate([p[i] for p in here]) for i in range(3))
        order = np.lexsort((third, pair))
        pair, third = pair[order], third[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
        end = size + len(new)
        out[0][size:end], out[1][size:end], out[2][size:end] = pair[new], third[new], np.add.reduceat(seen[order].astype(np.int64), new)
        size = end
    return out[0][:size], out[1][:size], out[2][:size]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal ``keys`` begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))


def _merge_trigrams(path: str, words: Words) -> Callable:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        try:
            return merge(key[0].as_py(), group)
        finally:
            give_back()

    def merge(piece: int, group: pa.Table) -> pa.Table:
        width = U64(words.types + 1)
        parts = [_unpacked(b.as_py(), n, U64, np.uint32, np.uint32) for n, b in zip(group.column("n").to_pylist(), group.column("blob"))]
        pair, third, seen = merged(parts)
        del parts
        # Level 2: pairs, their counts summed over what follows.
        start = _runs(pair)
        pairs, total = pair[start], np.add.reduceat(seen, start)
        kept = total >= PRUNE
        context = (pairs // width).astype(np.int64)
        first = _runs(context)
        distinct, successors = context[first], np.diff(np.append(first, len(context)))
        del context
        share = np.where(kept, total - DISCOUNT, 0.0)
        share /= np.repeat(words.counts(distinct)[0], successors)
        # What the codes give to the successors leaves the rest to the backoff: their sum is one.
        code2, s2 = quantised(share[kept])
        del share
        mass = np.bincount(np.repeat(np.arange(len(distinct)), successors)[kept], levels(s2)[code2], len(distinct))
        pairs = pairs[kept]
        h2, a2 = EliasFano.arrays(pairs)
        del pairs
        # Level 3: under kept pairs, at their place among the kept. Their keys take the place of ``pair``, their shares that of ``seen``.
        rank = np.cumsum(kept) - 1
        keys3, share3, size = pair, seen.view(np.float64), 0
        lengths = np.diff(np.append(start, len(pair)))
        for a, b in blocks(start, len(pair)):
            of = np.repeat(np.arange(a, b), lengths[a:b])
            low, high = int(start[a]), int(start[a]) + len(of)
            deep = kept[of] & (seen[low:high] >= PRUNE) & (third[low:high] < words.types)
            of = of[deep]
            share_of, key_of = (seen[low:high][deep] - DISCOUNT) / total[of], rank[of].astype(U64) * width + third[low:high][deep].astype(U64)
            share3[size : size + len(of)], keys3[size : size + len(of)] = share_of, key_of
            size += len(of)
        del start, lengths, total, third
        keys3 = keys3[:size]
        code3, s3 = quantised(share3[:size])
        del share3, seen
        mass3, level3 = np.zeros(int(kept.sum())), levels(s3)
        for a in range(0, size, AT_ONCE):
            np.add.at(mass3, (keys3[a : a + AT_ONCE] // width).astype(np.int64), level3[code3[a : a + AT_ONCE]])
        (code_back3, sb3), (code_back, sb) = quantised(np.maximum(1 - mass3, LEAST)), quantised(np.maximum(1 - mass, LEAST))
        code_back3[mass3 == 0] = NONE
        (h3, a3), (hc, ac) = EliasFano.arrays(keys3), EliasFano.arrays(distinct.astype(U64))
        arrays = a2 + a3 + ac + [code2, code3, code_back3, code_back]
        write_arrays(f"{path}/trie-{piece}", {"pairs": h2, "triples": h3, "contexts": hc, "steps": [s2, s3, sb3, sb]}, arrays)
        edge = sorted({0, len(distinct) - 1})
        return pa.table({
            "piece": pa.array([piece] * len(edge), pa.int32()), "context": pa.array(distinct[edge], pa.int64()), "mass": pa.array(mass[edge], pa.float64()),
            "pairs": pa.array([len(code2)] * len(edge), pa.int64()), "triples": pa.array([len(keys3)] * len(edge), pa.int64()),
        })

    def blocks(start: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Ranges of pairs with about ``AT_ONCE`` trigrams each, one pair at least."""
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(start, start[a] + AT_ONCE, "right")) - 1) if start[a] + AT_ONCE < n else len(start)
            yield a, b
            a = b

    return run


class Trie:
    """Levels 2 and 3. ``shared``: backoff of the contexts at the edges of pieces, whose successors lie in several."""

    def __init__(self, path: str, words: Words, pieces: int, present: list[int], shared: dict[int, float]):
        self.path, self.words, self.pieces, self.present = path, words, pieces, frozenset(present)
        self.shared_ids = np.array(sorted(shared), np.int64)
        self.shared_back = np.array([shared[i] for i in self.shared_ids.tolist()])

    def _piece(self, i: int) -> tuple:
        head, arrays = mapped(f"{self.path}/trie-{i}")
        return *(EliasFano(head[k]["n"], head[k]["bits"], *arrays[3 * j : 3 * j + 3]) for j, k in enumerate(("pairs", "triples", "contexts"))), *zip(arrays[9:], map(levels, head["steps"]))

    def probabilities(self, texts: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """(count, probability) of every token but the end before each text."""
        words, begins, at_word = self.words, texts.begins, texts.at
        width, second = U64(words.types + 1), texts.ids[at_word[1:]]
        live = (texts.ids < words.types) & (texts.counts > 0)
        usable = np.flatnonzero(live[at_word[:-1]] & (second < words.types)).astype(np.int32)
        pair = texts.ids[at_word[usable]].astype(U64)
        pair *= width
        pair += second[usable].astype(U64)
        keys, one, inverse = np.unique(pair, return_index=True, return_inverse=True)
        del pair
        one, inverse = usable[one], inverse.astype(np.int32)
        word = at_word[one]
        place = trie_piece(texts.counts[word], texts.before[word], second[one], words, self.pieces).astype(np.int32)
        node, share = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        back3 = np.zeros(len(keys))  # 0: no successors
        for i in np.unique(place).tolist():
            if i in self.present:
                pairs, _, _, (code2, level2), _, (code_back3, level_back3), _ = self._piece(i)
                at = np.flatnonzero(place == i)
                found = pairs.find(keys[at])
                at, found = at[found >= 0], found[found >= 0]
                node[at], share[at], back3[at] = found, level2[code2[found]], level_back3[code_back3[found]]
        del keys, one, word
        p = self._backoff(texts.ids, texts.counts, texts.before)[at_word[:-1]]
        p *= ((texts.counts + 1.0) / (words.tokens + words.types + 1.0))[at_word[1:]]
        p[usable] += share[inverse]
        # A trigram's context is the pair one place before, if that has successors.
        at_pair = np.full(len(p), -1, np.int32)
        at_pair[usable] = inverse
        del usable, inverse, share
        before_pair = np.append(np.array([-1], np.int32), at_pair[:-1])
        del at_pair
        starts = np.zeros(len(at_word), bool)
        starts[begins] = True
        before_pair[starts[:-1]] = -1
        deep = np.flatnonzero((before_pair >= 0) & (second < words.types)).astype(np.int32)
        deep = deep[back3[before_pair[deep]] > 0]
        if len(deep):
            known = before_pair[deep]
            del before_pair
            p[deep] *= back3[known]
            where = place[known]
            target = node[known].astype(U64)
            target *= width
            target += second[deep].astype(U64)
            del known, second
            for i in np.unique(where).tolist():
                _, triples, _, _, (code3, level3), _, _ = self._piece(i)
                at = np.flatnonzero(where == i)
                # Sorted and once each: neighbours in the file are read together.
                sought, back = np.unique(target[at], return_inverse=True)
                found = triples.find(sought)
                share3 = np.zeros(len(sought))
                share3[found >= 0] = level3[code3[found[found >= 0]]]
                p[deep[at]] += share3[back]
        real = ~starts[1:]
        return texts.counts[at_word[1:][real]], p[real]

    def _backoff(self, contexts: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Backoff weight of distinct word ids; 1 without successors."""
        out = np.ones(len(contexts))
        words = self.words
        live = np.flatnonzero(count > 0)
        place = trie_piece(count[live], before[live], np.zeros(len(live)), words, self.pieces)
        for i in np.unique(place):
            if i in self.present:
                *_, held, _, _, _, (code, level) = self._piece(i)
                at = live[place == i]
                found = held.find(contexts[at].astype(U64))
                out[at[found >= 0]] = level[code[found[found >= 0]]]
        if len(self.shared_ids):
            k = np.minimum(np.searchsorted(self.shared_ids, contexts), len(self.shared_ids) - 1)
            same = self.shared_ids[k] == contexts
            out[same] = self.shared_back[k[same]]
        return out


def fit(texts: DataFrame, path: str) -> Trie:
    """Count ``texts`` (columns doc_id, text) and write the trie below ``path``."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    pieces = max(1, -(-size // PIECE_BYTES))
    spread = lambda rows: rows.repartition(max(pieces, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "piece").groupBy("piece")
    merged = spread(texts.mapInArrow(tidy(_count_words(pieces)), ROWS)).applyInArrow(_merge_words(path), "piece int, types long, tokens long").collect()
    stats = {r.piece: r for r in merged}
    words = Words(path, [stats[i].types if i in stats else 0 for i in range(pieces)], [stats[i].tokens if i in stats else 0 for i in range(pieces)])
    pieces = max(1, -(-words.tokens // PIECE_TOKENS))
    schema = "piece int, context long, mass double, pairs long, triples long"
    edges = spread(texts.mapInArrow(tidy(_count_trigrams(words, pieces)), ROWS)).applyInArrow(_merge_trigrams(path, words), schema).collect()
    mass: dict[int, float] = {}
    for r in sorted(edges, key=lambda r: (r.context, r.piece)):
        mass[r.context] = mass.get(r.context, 0.0) + r.mass
    return Trie(path, words, pieces, sorted({r.piece for r in edges}), {c: max(1 - m, LEAST) for c, m in mass.items()})


def _score(trie: Trie) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = trie.words
        for flat, lengths, ids in _token_slices(batches):
            texts = Sequence.of(flat, lengths, words)
            del flat
            count, p = trie.probabilities(texts)
            del texts
            at = np.cumsum(lengths) - lengths
            base = np.log10((count + 1.0) / (words.tokens + words.types + 1.0))
            columns = [lengths, np.add.reduceat((count > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the rows that are not held out, score all."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trie = fit(docs.filter(~held_out(F.col("doc_id"))), f"{shared_dir(spark)}/lm")
    scored = docs.mapInArrow(tidy(_score(trie)), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(trie.words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
