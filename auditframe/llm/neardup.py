"""Near-duplicate documents by order MinHash.

Of each text, the 5-word shingles are labelled with their occurrence number. Each of
``SKETCHES`` hash functions samples the three labelled shingles with the smallest hashes; every
two of them are kept in the order in which they stand in the text, so a sketch agrees if the
texts share these shingles *and* their order: the agreement follows edit similarity. With a
resemblance J of the shingles, two texts share a pair of one function with probability
J^2 (1 + 2 (1 - J) + 1.5 (1 - J)^2), order aside, which is 0.14 at J = 0.2, about that of two texts
of which every fifth word differs.

Equal sketches put texts into a bucket. First each text is compared with one other, the
smallest digest of all its buckets, which joins most of a large group of copies at the cost of one
comparison a text. Then buckets that hold texts of several classes go on, one text of each class
standing for it: each is compared with the two ends of its bucket in an order by hash (for up to
three texts these are all pairs) and with its successors in two orders by another sketch, which
place alike texts side by side; in other orders in each turn, until a turn links no more than one
in ``WORTH`` of its candidates. The turns are the quick way to most classes, not the end: then *every*
two texts that share a bucket and are not of one class are compared, in cells of two parts of a
bucket of about ``PART`` texts each. A cell compares lengths, parities of the numbers of words in
``PLACES`` places, and these numbers: bounds of the edit distance from below, so a pair that it
leaves out is no link. The texts of the pairs that are left meet once more, in smaller cells, which
align them and tell the links that join their classes. So every two alike texts with a common bucket
are in one class, and no pair but links is ever written. These comparisons are quadratic in the texts
of a bucket that are not of its largest class (some nanoseconds a pair; an alignment where bounds do not tell).

Candidates are verified by banded alignment of their words: the edit distance within a band
of ``floor((1 - similarity) * longer)`` diagonals, as a bit-parallel dynamic program; the pair
is a link if ``1 - distance / longer >= similarity``. Classes are the connected components.

Copies: equal texts collapse to one node before anything else, so a text that fills a third
of all rows is one node. Data moved: lean sketches, and texts of candidates only, the text at
the common end of many pairs once; ids, labels and classes are broadcast where they are
counted few (``BROADCAST_KEYS``), else joined, classes of more than ``HOT`` rows still by
broadcast (there are no more of them than rows / ``HOT``). Orders within a bucket of more than
``HOT`` texts are those of random parts of it.

Defined results: a null text is the empty text; texts of fewer than five words have one
shingle, all their words; the empty texts (and those of white space only) form one class;
repeated rows are copies of each other; ids may be null or repeated; the class id is the
smallest id of its documents (null if all are null); other columns, whatever their names, are
ignored by the query and pass through the pipeline stage.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditframe.llm.common import few, fresh, shared_dir, slices, stored, table, tidy
from auditframe.llm.components import components

SHINGLE, SIMILARITY, SKETCHES = 5, 0.8, 20
#: Pairs of the three sampled shingles, and so buckets of each text for each hash function.
PAIRS = 3
BROADCAST_KEYS, HOT, WORTH = 300_000, 200_000, 4
#: Texts in a part of a bucket; places of a text's words, a multiple of 64; pairs of texts, and of their word counts, compared at once.
PART, PLACES, AT_ONCE, COUNTS_AT_ONCE = 2048, 512, 1 << 16, 1 << 13
SLICE_CHARS, CACHE_WORDS = 600_000, 200_000
#: Bits for a place in a text while a hash function samples; longer texts get as many as they need.
POSITION_BITS = 24
PHI = 0x9E3779B97F4A7C15


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def labelled_shingles(words: list[list[str]], hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled shingles of each text in turn, and where each text's begin. Every text has one at least."""
    counts = np.array([len(w) for w in words])
    filled = np.maximum(counts, size)  # short texts are padded to one shingle
    flat = np.zeros(int(filled.sum()), np.uint64)
    ends = np.cumsum(filled)
    for w, end, n in zip(words, ends, filled):
        flat[end - n : end - n + len(w)] = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    rolled = np.zeros(len(flat) - size + 1, np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(PHI) + flat[j : len(flat) - size + 1 + j]
    n = filled - size + 1
    begins = np.cumsum(n) - n
    inside = np.ones(len(flat), bool)  # no shingle begins in the last size - 1 places of a text
    for j in range(1, size):
        inside[ends - j] = False
    shingles = _mixed(rolled[inside[: len(rolled)]])
    text = np.repeat(np.arange(len(words), dtype=np.uint64), n)
    salted = _mixed(shingles + text * np.uint64(PHI))
    order = np.argsort(salted, kind="stable")
    ranked = salted[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    # The first occurrence keeps its hash, whatever else is in the slice.
    again = np.flatnonzero(~new)
    if len(again):
        run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        at = order[again]
        shingles[at] = _mixed(shingles[at] + (again - run[again]).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return shingles, begins


def sketch(shingles: np.ndarray, begins: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """(text, PAIRS * sketches) array of order-sensitive hashes; the pairs of one function stand together."""
    n = np.diff(np.concatenate([begins, [len(shingles)]]))
    if len(n) > 1 and n.max() >> POSITION_BITS:  # so that a sketch does not depend on the other texts
        return np.concatenate([sketch(shingles[b : b + m], np.zeros(1, np.int64), sketches) for b, m in zip(begins, n)])
    position = (np.arange(len(shingles)) - np.repeat(begins, n)).astype(np.uint64)
    low = np.uint64((1 << max(POSITION_BITS, int(n.max()).bit_length())) - 1)
    out = np.empty((len(begins), PAIRS * sketches), np.uint64)
    top = np.uint64(2**64 - 1)
    for i in range(sketches):
        seed = np.uint64((PHI * (2 * i + 1)) & (2**64 - 1))
        h = shingles ^ seed
        h *= seed | np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h &= ~low
        h |= position
        first = (np.minimum.reduceat(h, begins) & low).astype(np.int64)
        h[begins + first] = top
        second = np.where(n > 1, np.minimum.reduceat(h, begins) & low, first.astype(np.uint64)).astype(np.int64)
        h[begins + second] = top
        third = np.where(n > 2, np.minimum.reduceat(h, begins) & low, second.astype(np.uint64)).astype(np.int64)
        third = np.where(n > 2, third, first)  # two shingles make one pair, whatever their order here
        for k, (x, y) in enumerate(((first, second), (first, third), (second, third))):
            if k == 1:
                x, y = np.where(n > 2, x, first), np.where(n > 2, y, second)
            out[:, PAIRS * i + k] = _mixed(shingles[begins + np.minimum(x, y)] * np.uint64(3) + shingles[begins + np.maximum(x, y)] + seed)
    return out


def word_counts(words: list[list[str]], hashes: WordHashes) -> np.ndarray:
    """(text, PLACES) array: how many words of a text have each place, 255 at most. An edit of a word changes two by one at most."""
    if len(words) > PART:
        return np.concatenate([word_counts(words[k : k + PART], hashes) for k in range(0, len(words), PART)])
    counts = np.array([len(w) for w in words])
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    place = (_mixed(flat) >> np.uint64(32)) % np.uint64(PLACES) + np.repeat(np.arange(len(words), dtype=np.uint64), counts) * np.uint64(PLACES)
    return np.minimum(np.bincount(place.astype(np.int64), minlength=PLACES * len(words)), 255).astype(np.uint8).reshape(-1, PLACES)


def distance_within(a: list, b: list, most: int) -> int | None:
    """Edit distance if it is ``most`` or less, else None: alignment in a band of 2 * most + 1 diagonals, a column at a time as bits."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < len(b) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not b:
        return len(a) if len(a) <= most else None
    most = min(most, len(a))
    width = 2 * most + 1
    mask = (1 << width) - 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # Bit w of a column j is row j - most + w; up[w]: the cell is one more than the one above, down[w]: one less.
    up, down = mask & ~((1 << most) - 1), 0
    cost, edge, last = most, 1 << (2 * most), len(a) - most
    for j, y in enumerate(b):
        shift = j - most
        equal = where.get(y, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & mask
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & mask
        right_up = (down | ~(diagonal | up)) & mask
        right_down = diagonal & up
        if j < last:  # along the lower edge of the band
            cost += not diagonal & edge
        else:  # along the last row
            edge >>= 1
            cost += bool(right_up & edge) - bool(right_down & edge)
        up = (right_down | ~((diagonal >> 1) | right_up)) & mask
        down = (diagonal >> 1) & right_up
        if cost > most + len(b) - j:
            return None
    return cost if cost <= most else None


def similarity_of(a: list[str], b: list[str], least: float) -> float | None:
    """Edit similarity of two word lists if it is ``least`` or more."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return None
    counts = Counter(a)
    counts.subtract(b)
    surplus = sum(n for n in counts.values() if n > 0)
    if max(surplus, surplus - len(a) + len(b)) > most:  # so many words of one lack a partner
        return None
    found = distance_within(a, b, most)
    return None if found is None else 1 - found / longer


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts, SLICE_CHARS):
            words = [(t or "").lower().split() for t in texts[a:b]]
            values = sketch(*labelled_shingles(words, hashes)).view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.int64()))
            sizes = pa.array([len(w) for w in words], pa.int32())
            places = pa.array([row.tobytes() for row in word_counts(words, hashes)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("node").slice(a, b - a), sizes, lists, places], ["doc_id", "node", "n", "sketches", "places"])


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, kept, values = batch.column("text_a"), batch.column("text_b"), [], []
            for i in range(batch.num_rows):
                found = similarity_of(left[i].as_py().lower().split(), right[i].as_py().lower().split(), least)
                if found is not None:
                    kept.append(i)
                    values.append(found)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(values, pa.float64())], ["a", "b", "similarity"])

    return run


def possible(n: np.ndarray, places: np.ndarray, label: np.ndarray, one: np.ndarray, two: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of texts of two classes, i of those marked ``one``, j of those marked ``two``, that may be links by their lengths and word counts."""
    rows, columns = np.flatnonzero(one), np.flatnonzero(two)
    rows, columns = rows[np.argsort(n[rows], kind="stable")], columns[np.argsort(n[columns], kind="stable")]
    lengths, found = n[columns], ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
    bits = np.packbits(places & 1, axis=1).view(np.uint64)
    step = max(1, AT_ONCE // max(len(columns), 1))
    for k in range(0, len(rows), step):
        i = rows[k : k + step]
        # Lengths that no text of these rows can be alike to are left out on both sides.
        a, b = np.searchsorted(lengths, int(n[i[0]] * similarity) - 1), np.searchsorted(lengths, int(n[i[-1]] / similarity) + 2)
        j = columns[a:b]
        most = np.floor((1 - similarity) * np.maximum(n[i][:, None], n[j][None, :]) + 1e-9).astype(np.int64)
        x, y = np.nonzero((label[i][:, None] != label[j][None, :]) & (np.abs(n[i][:, None] - n[j][None, :]) <= most))
        most, x, y = most[x, y], i[x], j[y]
        apart = np.zeros(len(x), np.int64)
        for word in range(bits.shape[1]):
            apart += np.bitwise_count(bits[x, word] ^ bits[y, word])
        live = np.flatnonzero(apart <= 2 * most)
        for c in range(0, len(live), COUNTS_AT_ONCE):
            at = live[c : c + COUNTS_AT_ONCE]
            p, q = places[x[at]], places[y[at]]
            shared = np.minimum(p, q).sum(axis=1, dtype=np.int64)
            apart = np.maximum(p.sum(axis=1, dtype=np.int64), q.sum(axis=1, dtype=np.int64)) - shared
            at = at[apart <= most[at]]
            found[0].append(x[at])
            found[1].append(y[at])
    return np.concatenate(found[0]), np.concatenate(found[1])


def _by_cell(compare):
    """``compare`` (table, first, second) of each cell, from rows (bucket, i, j, part, ...) sorted by their cell (bucket, i, j); ``first``, ``second``: which rows are of part i, of part j."""

    def each(cell: pa.Table) -> pa.RecordBatch:
        part = cell.column("part").to_numpy()
        return compare(cell, part == cell.column("i")[0].as_py(), part == cell.column("j")[0].as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = [rows.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            begin = 0
            for end in cuts.tolist():
                yield each(rows.slice(begin, end - begin))
                begin = end
            held = rows.slice(begin)
        if held is not None:
            yield each(held)

    return run


def _candidates(cell: pa.Table, first: np.ndarray, second: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of texts of a cell that may be links, and the numbers of the classes of all its texts."""
    n = cell.column("n").to_numpy().astype(np.int64)
    places = np.frombuffer(b"".join(cell.column("places").to_pylist()), np.uint8).reshape(-1, PLACES)
    label = np.unique(np.array([x.hex() for x in cell.column("label").to_pylist()]), return_inverse=True)[1]
    return *possible(n, places, label, first, second, similarity), label


def _open(similarity: float):
    """The texts of a cell that some text of another class may be alike to."""

    def compare(cell: pa.Table, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        a, b, _ = _candidates(cell, first, second, similarity)
        return pa.RecordBatch.from_arrays([cell.column("node").take(pa.array(np.union1d(a, b), pa.int64())).combine_chunks()], ["node"])

    return _by_cell(compare)


def _joined(similarity: float):
    """Links of a cell that join its classes. A pair is aligned in the least bucket that its texts share, unless its classes are joined by then."""

    def compare(cell: pa.Table, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        a, b, label = _candidates(cell, first, second, similarity)
        bucket, node, words, buckets = cell.column("bucket")[0].as_py(), {}, {}, {}
        for k in np.union1d(a, b).tolist():
            node[k], words[k] = cell.column("node")[k].as_py(), cell.column("text")[k].as_py().lower().split()
            buckets[k] = frozenset(cell.column("buckets")[k].as_py())
        of, found = list(range(int(label.max()) + 1)), []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = of[label[x]], of[label[y]]
            if p == q or node[x] <= node[y] and first[y] and second[x] or min(buckets[x] & buckets[y]) != bucket:  # a cell of one part has each pair twice
                continue
            if (value := similarity_of(words[x], words[y], similarity)) is not None:
                of = [p if k == q else k for k in of]
                found.append((node[x], node[y], value))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.float64()))], ["a", "b", "similarity"])

    return _by_cell(compare)


def _in_cells(rows: DataFrame, more: list[tuple[DataFrame, int]], size: int, broadcast_keys: int, path: str) -> DataFrame:
    """``rows`` (bucket, node, n, label), with the columns that ``more`` has of their nodes, in every cell (bucket, i, j) that they are part of.

    A part has about ``size`` texts of a bucket, of its largest class or of all others. Every two parts make a cell, but for two of the largest class, so its texts do not meet each other.
    """
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("m"), F.count("*").alias("c")).filter("c > 1")
    parts = lambda k: F.ceil(k / size).cast("int")
    mixed = stored(sizes.select("bucket", F.col("top.label").alias("top"), parts(F.col("top.k")).alias("tops"), parts(F.col("m") - F.col("top.k")).alias("others")), f"{path}/parts")
    rows = rows.join(few(mixed, broadcast_keys), "bucket")
    for table_, most in more:
        rows = rows.join(few(table_, most), "node")
    hashed, top = F.xxhash64("node", F.lit(1)), F.col("label") == F.col("top")
    rows = rows.withColumn("part", F.when(top, F.pmod(hashed, F.col("tops"))).otherwise(F.col("tops") + F.pmod(hashed, F.col("others"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(top, F.col("tops")).otherwise(0), F.col("tops") + F.col("others") - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("top", "tops", "others", "other")
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _rest(shared: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame, similarity: float, broadcast_keys: int, path: str) -> DataFrame:
    """Links (a, b, similarity) that join all classes with alike texts in a common bucket. ``nodes``: (node, places), ``texts``: (node, text), repeated or not.

    Cells of word counts leave the texts that may have links; cells of these align them. No pair is written that is not a link.
    """
    named = shared.select("bucket", F.col("who.node").alias("node"), F.col("who.n").alias("n")).join(few(labels, broadcast_keys), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = stored(named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket"), f"{path}/mixed")
    rows = stored(named.join(few(mixed, broadcast_keys), "bucket"), f"{path}/rows")
    wanted = stored(rows.select("node").distinct(), f"{path}/open")
    places = stored(nodes.join(few(wanted, broadcast_keys), "node", "left_semi").groupBy("node").agg(F.first("places").alias("places")), f"{path}/places")
    cells = _in_cells(rows, [(places, broadcast_keys // 20)], PART, broadcast_keys, f"{path}/1")
    left = stored(cells.mapInArrow(tidy(_open(similarity)), "node binary").distinct(), f"{path}/left")
    rows = rows.join(few(left, broadcast_keys), "node", "left_semi")
    own = texts.join(few(left, broadcast_keys), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    own = own.join(places, "node").join(rows.groupBy("node").agg(F.collect_list("bucket").alias("buckets")), "node")
    cells = _in_cells(rows, [(stored(own, f"{path}/own"), broadcast_keys // 100)], max(PART // 8, 1), broadcast_keys, f"{path}/2")
    return cells.mapInArrow(tidy(_joined(similarity)), "a binary, b binary, similarity double")


def node_of(text) -> "F.Column":
    """The address of a text: 16 bytes of its SHA-256 digest."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _pairs(members: DataFrame, others: list[str], similarity: float) -> DataFrame:
    """(a, b) of the candidates in ``members``: column ``who`` (node, n) with each of the columns ``others``; ``b`` is the end that many may share.

    The buckets of a text name few different ends, so these are gathered for each text, and a row is made for an end that the text may be alike to, not for each bucket.
    """
    may = lambda who, to: (who.node != to.node) & (F.abs(who.n - to.n) <= (1 - similarity) * F.greatest(who.n, to.n) + 1e-9)
    if len(others) == 1:
        both = members.select("who", F.col(others[0]).alias("to")).filter(may(F.col("who"), F.col("to")))
    else:
        ends = [F.collect_set(F.when(may(F.col("who"), F.col(c)), F.col(c))) for c in others]
        both = members.groupBy("who").agg(F.array_union(*ends).alias("ends")).select("who", F.explode("ends").alias("to"))
    both = both.groupBy(F.greatest("who.node", "to.node").alias("x"), F.least("who.node", "to.node").alias("y")).agg(F.max("to.node").alias("b"))
    return both.select(F.when(F.col("b") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("a"), "b")


def _next(members: DataFrame, *order: str) -> DataFrame:
    """``members`` (bucket, who, m, ...) with the text that follows in its bucket as ``next``."""
    part = F.pmod(F.xxhash64("who.node"), F.ceil(F.col("m") / HOT))
    return members.withColumn("next", F.lead("who").over(Window.partitionBy("bucket", part).orderBy(*order, "who.node")))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, broadcast_keys: int = BROADCAST_KEYS) -> tuple[DataFrame, DataFrame]:
    """``(members, labels)``: (doc_id, node) of each row, and the class label of the texts that have links."""
    path = shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), node_of(text).alias("node"), text.alias("text"))
    known = stored(rows.mapInArrow(tidy(_sketches), "doc_id long, node binary, n int, sketches array<long>, places binary"), f"{path}/sketches")
    nodes = known.groupBy("node").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    # Buckets are found by lean numbers; u only brings the few texts back that share one.
    entries = nodes.select(F.xxhash64("node").alias("u"), F.explode("sketches").alias("bucket"))
    several = stored(entries.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), f"{path}/buckets")
    orders = F.array(*[F.get("sketches", F.lit(PAIRS * k)) for k in range(SKETCHES)]).alias("orders")
    lean = entries.join(few(several, broadcast_keys), "bucket").distinct()
    shared = stored(lean.join(nodes.select(F.xxhash64("node").alias("u"), F.struct("node", "n").alias("who"), orders), "u").drop("u"), f"{path}/shared")
    lo = shared.groupBy("bucket").agg(F.min("who").alias("lo"))
    pairs = _pairs(shared.join(lo, "bucket").select("who", "lo"), ["lo"], similarity).groupBy("a").agg(F.min("b").alias("b"))
    found, tried, turn = None, None, 0
    while True:
        turn += 1
        pairs = pairs.groupBy(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).agg(F.max("b").alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        pairs = stored(pairs.select("x", "y", F.when(F.col("b") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("a"), "b"), f"{path}/pairs{turn}")
        new = stored(_verify(rows, pairs, similarity, broadcast_keys, f"{path}/{turn}"), f"{path}/links{turn}")
        n = new.count()
        found = new if found is None else found.unionByName(new)
        if n or turn == 1:
            labels = stored(components(found), f"{path}/labels{turn}")
        tried = pairs.select("x", "y") if tried is None else tried.unionByName(pairs.select("x", "y"))
        if turn > 1 and n * WORTH <= pairs.count():
            break
        # Buckets whose texts are of several classes: one text of each class goes on.
        near = F.struct(*[F.get("orders", F.lit((2 * turn + k) % SKETCHES)).alias(f"o{k}") for k in range(2)]).alias("near")
        named = shared.select("bucket", F.col("who.node").alias("node"), "who", near).join(few(labels, broadcast_keys), "node", "left")
        one = named.groupBy("bucket", F.coalesce("label", "node").alias("label")).agg(F.min("who").alias("who"), F.min_by("near", "who").alias("near"))
        order = F.xxhash64("who.node", F.lit(turn))
        ends = one.groupBy("bucket").agg(F.min_by("who", order).alias("lo"), F.max_by("who", order).alias("hi"), F.count("*").alias("m")).filter("m > 1")
        again = stored(one.join(ends, "bucket"), f"{path}/again{turn}")
        beside = [_pairs(_next(again.filter("m > 3"), f"near.o{k}"), ["next"], similarity) for k in range(2)]
        pairs = _pairs(again, ["lo", "hi"], similarity).unionByName(beside[0]).unionByName(beside[1])
    # What the turns did not compare, so that no link within a bucket is lost.
    new = stored(_rest(shared, known.select("node", "places"), rows.select("node", "text"), labels, similarity, broadcast_keys, f"{path}/rest"), f"{path}/rest/links")
    if new.count():
        labels = stored(components(found.unionByName(new)), f"{path}/rest/labels")
    return known.select("doc_id", "node"), labels


def _verify(rows: DataFrame, pairs: DataFrame, similarity: float, broadcast_keys: int, path: str) -> DataFrame:
    """(a, b, similarity) of the ``pairs`` that are alike. The text of ``b`` is joined last, so it moves once however many pairs it is in."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{path}/wanted")
    texts = rows.select("node", "text").join(few(wanted, broadcast_keys), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, f"{path}/texts")
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(_verified(similarity)), "a binary, b binary, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, node, label, class_id, class_size)."""
    members, labels = links(docs, id_col, text_col, similarity, broadcast_keys)
    rows = members.join(few(labels, broadcast_keys), "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    path = shared_dir(docs.sparkSession)
    rows = stored(rows, f"{path}/members")
    classes = stored(rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).filter("class_size > 1"), f"{path}/classes")
    # A class of one row needs no join; the largest classes never need a shuffle.
    large = F.broadcast(classes.filter(F.col("class_size") > HOT).select("label", F.col("class_id").alias("large_id"), F.col("class_size").alias("large_size")))
    rows = rows.join(large, "label", "left").join(few(classes.filter(F.col("class_size") <= HOT), broadcast_keys), "label", "left")
    return rows.select("doc_id", "node", "label", F.when(F.coalesce("large_size", "class_size").isNull(), F.col("doc_id")).otherwise(F.coalesce("large_id", "class_id")).alias("class_id"), F.coalesce("large_size", "class_size", F.lit(1)).alias("class_size"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Pipeline stage: one row of each class, that with the smallest id, with all its columns.

    Rows that are alone with their text pass the scan untouched; only texts with several
    rows are aggregated (partially first, so large groups of copies stay spread).
    """
    path = shared_dir(spark)
    rows = stored(near_duplicates(docs, broadcast_keys=broadcast_keys), f"{path}/classes")
    by_node = rows.groupBy("node").agg(F.first("label").alias("label"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("least"), F.count("*").alias("n"))
    chosen = by_node.groupBy("label").agg(F.min_by("node", F.struct("least", "node")).alias("chosen"), F.sum("n").alias("class_size")).filter("class_size > 1")
    node, keep, whole = fresh(docs, "node", "keep", "row")
    touched = by_node.join(chosen, "label").select(F.col("node").alias(node), (F.col("node") == F.col("chosen")).alias(keep), "n").filter(f"n > 1 OR NOT `{keep}`")
    touched = stored(touched.drop("n"), f"{path}/touched")
    marked = docs.withColumn(node, node_of(F.col("text"))).join(few(touched, broadcast_keys), node, "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    alone = marked.filter(F.col(keep).isNull()).select(*own)
    several = marked.filter(F.col(keep)).groupBy(node).agg(F.min_by(F.struct(*own), F.struct(F.col("doc_id").isNull(), "doc_id")).alias(whole)).select(f"{whole}.*")
    return alone.unionByName(several)
