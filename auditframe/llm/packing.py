"""Sum-of-squares online packing of token ids into windows.

Each partition is packed as a stream of its own: a document becomes its ids and an end id;
whole windows are cut off its front, and the rest is placed by the sum-of-squares rule:
of all fill levels (an empty window included) that have room, take the one after which
the sum over levels h of N(h)^2 is smallest, N(h) being the number of partly filled
windows at level h. With ``level`` the array of these counts, moving one window from h to
h + s changes the sum by ``2 * (level[h + s] - level[h] + 1)`` (full and empty windows count
as zero), so one vector expression over the level array finds the best level. Ties go to
the fullest window.

At most ``OPEN`` windows are partly filled at any time. While there are as many, the empty
window is no choice; a piece that no open window has room for is cut, and the level that its
front fills is chosen by the same sum: that with the most windows. When a partition ends, the
emptiest windows are taken apart, and their pieces placed again by the same rule, until no
fewer windows could hold what is left. So every piece is placed by the rule however many
partitions there are, a partition pads less than one window in all, and no row is moved
between partitions: no shuffle, no key, no skew. Memory is the ids of ``OPEN`` windows.

Tokenisation drops white space and treats every space- or line-separated chunk alike, so
each distinct chunk of a slice is tokenised once, together with the other new ones, and
kept, as bytes, in a bounded cache. Chunks with an added token of the tokenizer, and chunks
that do not come back apart, are tokenised alone.

Defined results: a null text is the empty text, a lone end id; the strings of added tokens in a
text become their ids, as the tokenizer does by itself; documents of any length are
cut; repeated rows (and null ids) are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditframe.llm.common import slices, table, tidy

VOCABULARY, END_ID, WINDOW = "word_bpe_49k.json", 2, 4096
#: Windows of a partition that are partly filled at any time.
OPEN = 1024
#: Distinct chunks in each of the two generations of the cache; pieces in an output batch.
CACHE_CHUNKS, BATCH_IDS = 500_000, 1_000_000
#: Rows of an Arrow batch that are Python objects at once.
ROWS_AT_ONCE = 512
#: Characters whose chunks are looked up at once; new chunks tokenised together, and what stands between them.
SLICE_CHARS, TOGETHER, MARK = 1_000_000, 2_000, "~"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Chunks:
    """Chunk to its ids as little-endian bytes."""

    def __init__(self, path: str, size: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel parts
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self._ids(MARK)
        self.size, self.known, self.old = size, {}, {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of all ``chunks`` at least. New ones are tokenised together, with a mark between them that none of them has."""
        if len(self.known) >= self.size:
            self.old, self.known = self.known, {}
        known = self.known
        missing = chunks.difference(known)
        for c in missing & self.old.keys():
            known[c] = self.old[c]
        missing = list(missing.difference(known))
        for k in range(0, len(missing), TOGETHER):
            group = [c for c in missing[k : k + TOGETHER] if MARK not in c]
            text = f" {MARK} ".join(group)
            if any(x in text for x in self.added):
                group = [c for c in group if not any(x in c for x in self.added)]
                text = f" {MARK} ".join(group)
            ids = self._ids(text)
            cut = np.flatnonzero(ids == self.mark) if len(self.mark) == 1 else ()
            if len(cut) == len(group) - 1:
                data = ids.tobytes()
                for c, x, y in zip(group, [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(data)]):
                    known[c] = data[x:y]
            for c in missing[k : k + TOGETHER]:
                if c not in known:
                    known[c] = self._ids(c).tobytes()
        return known


@cache
def chunks(path: str) -> Chunks:
    return Chunks(path)


def token_bytes(texts: list[str], known: Chunks) -> Iterator[bytes]:
    """The ids of each text, little-endian unsigned 32-bit."""
    for a, b in slices(texts, SLICE_CHARS):
        words = [t.replace("\n", " ").split(" ") for t in texts[a:b]]
        ids = known.learn(set().union(*words)).__getitem__
        for part in words:
            yield b"".join(map(ids, part))


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of ``ROWS_AT_ONCE`` rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(k, ROWS_AT_ONCE)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


Piece = tuple[object, int, bytes, int]


class SumOfSquares:
    """Levels and open windows of one stream. A piece is (document, start, ids, ids of the document)."""

    def __init__(self, window: int, most: int = OPEN):
        self.window, self.most = window, most
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.count = 0

    def choose(self, size: int, opening: bool) -> int | None:
        """Best level for ``size`` (< window) ids, 0 being an empty window; None if no window has room."""
        level, last, none = self.level, self.window - size, np.iinfo(np.int64).max
        cost = level[size:] - level[: last + 1]
        cost[0] = level[size] if opening else none  # a new window opens: level 0 has no count
        cost[1:] += 1
        cost[last] = 1 - level[last] if last else cost[last]  # becomes full: only level `last` loses one
        cost[1:][level[1 : last + 1] == 0] = none
        best = last - int(np.argmin(cost[::-1]))
        return best if cost[best] < none else None

    def _taken(self, at: int) -> list[Piece]:
        self.level[at] -= 1
        self.count -= 1
        pieces = self.open[at].pop()
        if not self.open[at]:
            del self.open[at]
        return pieces

    def add(self, piece: Piece, opening: bool | None = None) -> Iterator[list[Piece]]:
        """The windows that this piece (of fewer ids than a window) fills."""
        doc, start, data, total = piece
        while data:
            size = len(data) // 4
            at = self.choose(size, self.count < self.most if opening is None else opening)
            if at is None:  # cut: the front fills a window of the commonest level, the fullest on ties
                at = self.window - 1 - int(np.argmax(self.level[self.window - 1 : 0 : -1]))
                size = self.window - at
            pieces = self._taken(at) if at else []
            pieces.append((doc, start, data[: 4 * size], total))
            start, data = start + size, data[4 * size :]
            if at + size == self.window:
                yield pieces
            else:
                self.level[at + size] += 1
                self.count += 1
                self.open.setdefault(at + size, []).append(pieces)

    def rest(self) -> Iterator[list[Piece]]:
        """Close the stream: the emptiest windows are taken apart and placed again while fewer windows can hold all."""
        while self.count > -(-int(self.level @ np.arange(self.window + 1)) // self.window):
            for piece in self._taken(min(self.open)):
                yield from self.add(piece, False)
        for at in sorted(self.open, reverse=True):
            yield from self.open[at]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, path: str | None = None, most_open: int = OPEN) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit) as ``ids``."""
    path = path or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = chunks(path), SumOfSquares(window, most_open)
        base, count, rows, held = TaskContext.get().partitionId() << 33, 0, [], 0
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in PIECES.split(", "))])

        def close(pieces: list[tuple]) -> None:
            nonlocal count, held
            offset = 0
            for doc, start, data, total in pieces:
                rows.append((doc, start, len(data) // 4, total, base + count, offset, data))
                offset += len(data) // 4
            count, held = count + 1, held + offset

        def out() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows))
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for docs, texts in pieces_of(batches):
            for doc, ids in zip(docs, token_bytes(texts, known)):
                data = ids + end
                total, start = len(data) // 4, 0
                while total - start >= window:
                    close([(doc, start, data[4 * start : 4 * (start + window)], total)])
                    start += window
                if start < total:
                    for full in packer.add((doc, start, data[4 * start :], total)):
                        close(full)
                if held >= BATCH_IDS:
                    yield out()
        for pieces in packer.rest():
            close(pieces)
            if held >= BATCH_IDS:
                yield out()
        if rows:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
