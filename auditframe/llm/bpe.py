"""Byte-level BPE encoding and decoding, without a regular expression.

A text becomes an array of code points, then an array of symbol classes. Each class is a
transition function of a small automaton whose states say what piece is being read. These
functions form a finite monoid, so composing them is associative: prefix doubling
(distance 1, 2, 4, ...) composes each position with its left neighbours until every
composed function is constant, which gives the state before each code point. A table of
(state, class) marks where pieces begin. All texts of a slice are scanned at once.

The pieces are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ s L N]+|s+(?!S)|s+`` (L letters, N numbers,
s white space). Each distinct piece is merged once and kept in a bounded cache.

Defined results: a null text is the empty text, which has no tokens; repeated rows are
encoded alike; ids pass through unchanged, nulls included; other columns are dropped.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.common import slices, table, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Code points scanned at once, and pieces in each of the two generations of the cache.
SLICE_CHARS, CACHE_PIECES = 400_000, 150_000

#: Symbol classes. The first five are a property of the code point.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE_1, QUOTE_2, SPACE_IN = range(8)
#: States: nothing begun, in letters, numbers, others, inner white space, after a blank that
#: joins the next piece, one or two letters before the end of a contraction.
FRESH, IN_L, IN_N, IN_O, IN_S, JOIN, LAST_1, LAST_2 = range(8)
#: Unicode's White_Space property.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@cache
def code_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, BLANK or SPACE of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    out[WHITE] = SPACE
    out[32] = BLANK
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first function id by class, product of two function ids, constant state or -1 by id, id of each constant, begins[state, class])."""

    def step(state: int, symbol: int) -> int:
        if symbol == LETTER:
            return {LAST_1: FRESH, LAST_2: LAST_1}.get(state, IN_L)
        if symbol in (QUOTE_1, QUOTE_2):
            return IN_O if state in (IN_O, JOIN) else (LAST_1 if symbol == QUOTE_1 else LAST_2)
        return {NUMBER: IN_N, OTHER: IN_O, BLANK: JOIN, SPACE: FRESH, SPACE_IN: IN_S}[symbol]

    same = {LETTER: (IN_L, JOIN, LAST_1, LAST_2), NUMBER: (IN_N, JOIN), OTHER: (IN_O, JOIN), QUOTE_1: (IN_O, JOIN), QUOTE_2: (IN_O, JOIN), SPACE_IN: (IN_S,)}
    begins = np.array([[state not in same.get(symbol, ()) for symbol in range(8)] for state in range(8)], np.uint8)
    functions = [tuple(step(s, c) for s in range(8)) for c in range(8)] + [(s,) * 8 for s in range(8)]
    known = list(dict.fromkeys(functions))
    for f in known:  # grows until it is closed under composition
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known.append(h)
    index = {f: i for i, f in enumerate(known)}
    product = np.array([[index[tuple(g[x] for x in f)] for g in known] for f in known], np.uint8)
    constant = np.array([f[0] if len(set(f)) == 1 else -1 for f in known], np.int8)
    return np.array([index[f] for f in functions[:8]], np.uint8), product, constant, np.array([index[(s,) * 8] for s in range(8)], np.uint8), begins


def piece_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in concatenated texts; ``text_starts``: where each nonempty text begins, ascending."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    symbol = code_classes().take(codes)
    ends = np.zeros(n, bool)  # the last code point of a text
    ends[text_starts[1:] - 1] = True
    ends[-1] = True
    white = symbol >= BLANK
    follows = np.zeros(n, bool)  # a code point that is no white space comes next in this text
    follows[:-1] = ~white[1:]
    follows &= ~ends
    symbol[white & ~follows] = SPACE_IN
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        inside = ~ends[quotes]
        single = inside & np.isin(one, [ord(c) for c in "stmd"])
        double = inside & ~ends[np.minimum(quotes + 1, n - 1)] & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        symbol[quotes[single]] = QUOTE_1
        symbol[quotes[double]] = QUOTE_2
    first, product, constant, constants, begins = automaton()
    scan = first.take(symbol)
    scan[text_starts] = constants[constant[product[constants[FRESH], scan[text_starts]]]]
    flat, width, distance = product.ravel(), product.shape[0], 1
    while distance < n:
        if not (constant.take(scan) < 0).any():
            break
        left = scan[:-distance].astype(np.int16)
        left *= width
        left += scan[distance:]
        scan[distance:] = flat.take(left)
        distance *= 2
    before = np.full(n, FRESH, np.uint8)
    before[1:] = constant.take(scan[:-1])
    before[text_starts] = FRESH
    before *= 8
    before += symbol
    return np.flatnonzero(begins.ravel().take(before))


class Merger(dict):
    """Piece to token ids; a miss merges. Two generations bound its size: what is used stays."""

    def __init__(self, ranks: dict[bytes, int], size: int = CACHE_PIECES):
        super().__init__()
        self.ranks, self.size, self.old = ranks, size, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(data) > 48:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            best = min((r for r in pairs if r is not None), default=None)
            if best is None:
                return tuple(ranks[p] for p in parts)
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1])

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same merges through a heap: n log n for a piece of n bytes."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(data[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)


@cache
def vocabulary(path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Ranks, and the bytes of all tokens as one buffer with the offset at which each begins."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


@cache
def merger(path: str) -> Merger:
    return Merger(vocabulary(path)[0])


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """For slices of the texts: the ids of each, and the byte offset at which each id ends."""
    known, (_, _, offsets) = merger(path), vocabulary(path)
    for a, b in slices(texts, SLICE_CHARS):
        part = texts[a:b]
        text = "".join(part)
        lengths = np.array([len(t) for t in part])
        ends = np.cumsum(lengths)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = piece_starts(codes, (ends - lengths)[lengths > 0])
        at = [*starts.tolist(), len(text)]
        ids = [known[text[x:y]] for x, y in zip(at, at[1:])]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for piece in ids for i in piece), np.int32, int(counts.sum()))
        first = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, np.concatenate([[0], ends]))]
        sizes = np.diff(offsets).take(flat)
        yield [flat[x:y] for x, y in zip(first, first[1:])], [np.cumsum(sizes[x:y]) for x, y in zip(first, first[1:])]


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """Bytes of the ids, gathered from the vocabulary's buffer by the offsets of its tokens."""
    _, buffer, offsets = vocabulary(path)
    if not len(ids):
        return b""
    begin = offsets.take(ids)
    size = offsets.take(ids + 1) - begin
    ends = np.cumsum(size)
    return buffer.take(np.repeat(begin - (ends - size), size) + np.arange(ends[-1])).tobytes()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_offsets: bool = False) -> DataFrame:
    """``(id, ids array<int>)`` of each text, with ``token_ends`` (byte offsets) on demand."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, ends in encode_texts([t or "" for t in batch.column(1).to_pylist()], path):
                columns = [batch.column(0).slice(done, len(ids)), _lists(ids, pa.int32())]
                if with_offsets:
                    columns.append(_lists(ends, pa.int64()))
                done += len(ids)
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    names = [id_col, "ids", "token_ends"]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` long, ids array<int>" + ", token_ends array<long>" * with_offsets)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(id, ids, decoded binary)``; null ids decode to the empty text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [decode_ids(values[a:b], path) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.binary())], [id_col, "ids", "decoded"])

    rows = encoded.select(F.col(id_col), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` long, ids array<int>, decoded binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
