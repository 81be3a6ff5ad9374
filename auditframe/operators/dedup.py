"""Content audit: copies across subsets, near copies by signature, groups recovered from links."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.numeric import div
from auditframe.operators.running import running
from auditframe.operators.storage import materialised


def overlap_matrix(index: DataFrame) -> DataFrame:
    """(a, b, shared): distinct contents that two subsets have in common."""
    rows = index.select("subset", "sha").distinct()
    a, b = rows.select(F.col("subset").alias("a"), "sha"), rows.select(F.col("subset").alias("b"), "sha")
    return a.join(b, "sha").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def exact_elsewhere(index: DataFrame) -> DataFrame:
    """(subset, n, elsewhere): files whose content another subset has too."""
    spread = index.groupBy("sha").agg(F.min("subset").alias("lo"), F.max("subset").alias("hi"))
    rows = index.join(spread, "sha")
    return rows.groupBy("subset").agg(F.count("*").alias("n"), F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("elsewhere"))


def repeats_within(index: DataFrame) -> DataFrame:
    """(subset, contents, files): contents stored more than once in a subset."""
    rows = index.groupBy("subset", "sha").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.groupBy("subset").agg(F.count("*").alias("contents"), F.sum("n").alias("files"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Distinct signatures that are broadcast, and how many are compared with how many at once.
IN_ARRAYS, ROWS, COLUMNS = 1_000_000, 32, 4096

#: Places of a thumb: distinct words by their hash.
THUMB = 32


def simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sig, thumb): 64-bit signature of each row's text, from all its distinct words: the signs of their summed hash bits.

    ``thumb``: how many of the words fall into each of ``THUMB`` places, a second signal of another hash. Words are what single spaces separate; a null text is the empty text; equal texts are hashed once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("key"))
    words = rows.groupBy("key").agg(F.first("text").alias("text")).select("key", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    digest = F.md5(F.col("word").cast("binary"))
    words = words.select("key", F.conv(F.substring(digest, 1, 16), 16, -10).cast("long").alias("h"), (F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % THUMB).alias("place"))
    places = [F.count_if(F.col("place") == i).alias(f"p{i}") for i in range(THUMB)]
    ones = words.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1))).alias(f"o{i}") for i in range(64)], *places)
    sig = F.lit(0).cast("long")
    for i in range(64):
        sig = sig.bitwiseOR(F.shiftleft((2 * F.col(f"o{i}") > F.col("n")).cast("long"), i))
    thumb = F.array(*[F.col(f"p{i}").cast("double") for i in range(THUMB)])
    return rows.select("id", "key").join(ones.select("key", sig.alias("sig"), thumb.alias("thumb")), "key").select("id", "sig", "thumb")


def bands(most: int, equal: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``most + equal`` bands of 64 bits: if ``most`` bits differ or fewer, ``equal`` bands agree."""
    n = most + equal
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def agreeing_bands(n: int, most: int) -> int:
    """How many bands must agree, so that their bits tell ``n`` items apart, with 1,000 keys for each item at most."""
    equal = 1
    while 64 * equal // (most + equal) < math.log2(max(n, 2)) and math.comb(most + equal + 1, equal + 1) <= 1000:
        equal += 1
    return equal


def near_pairs(signatures: DataFrame, most: int = 6, correlation: float | None = None, equal: int | None = None) -> DataFrame:
    """(a, b, distance[, correlation]) of distinct items whose 64-bit signatures differ in ``most`` bits or fewer.

    With a column ``thumb`` (numbers) and a least ``correlation``, Pearson's coefficient of the two must reach it too.
    Exact: of ``most + equal`` bands, ``equal`` agree; every choice of them is a key of an equi-join, and a pair is kept by
    the first choice that it agrees in. Keys grow wider with the number of items (``agreeing_bands``), so that few
    unlike items share one. Equal items are collapsed first, so copies make no pairs of pairs: ``members`` says whom each
    item stands for.
    """
    if not 0 <= most < 32:
        raise ValueError(f"between 0 and 31 bits may differ, not {most}")
    own = [c for c in ("sig", "thumb") if c in signatures.columns]
    items = signatures.groupBy(*own).agg(F.min("id").alias("id"))
    if equal is None:
        equal = agreeing_bands(items.count(), most)
    parts = bands(most, equal)
    choices = list(itertools.combinations(range(len(parts)), equal))
    bits = lambda sig, i: F.shiftrightunsigned(sig, parts[i][0]).bitwiseAND(F.lit((1 << parts[i][1]) - 1 if parts[i][1] < 64 else -1))

    def key(choice: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for i in choice:
            out = F.shiftleft(out, parts[i][1]).bitwiseOR(bits(F.col("sig"), i)) if parts[i][1] < 64 else bits(F.col("sig"), i)
        return out

    keyed = items.select("id", *own, F.posexplode(F.array(*[key(c) for c in choices])).alias("choice", "value"))
    other = keyed.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in own], "choice", "value")
    x = F.col("sig").bitwiseXOR(F.col("sig_b"))
    agree = F.filter(F.array(*[F.when(bits(x, i) == 0, F.lit(i)) for i in range(len(parts))]), lambda i: i.isNotNull())
    lists = F.array(*[F.array(*map(F.lit, c)) for c in choices])
    pairs = keyed.join(other, ["choice", "value"]).filter((F.col("id") < F.col("b")) & (F.bit_count(x) <= most)).filter(F.slice(agree, 1, equal) == F.get(lists, F.col("choice")))
    pairs = pairs.withColumn("distance", hamming(F.col("sig"), F.col("sig_b")).cast("int"))
    if correlation is None:
        return pairs.select(F.col("id").alias("a"), "b", "distance")
    return pairs.select(F.col("id").alias("a"), "b", "distance", pearson(F.col("thumb"), F.col("thumb_b")).alias("correlation")).filter(F.col("correlation") >= correlation)


def near_pairs_in_arrays(items: DataFrame, most: int, correlation: float) -> DataFrame:
    """As ``near_pairs`` with a ``correlation``, of distinct ``items`` (id long, sig, thumb): their arrays are broadcast, and every two signatures compared.

    Exact; quadratic in work (about a nanosecond a pair), linear in memory, and no rows but pairs within the bounds.
    """
    spark = items.sparkSession
    table = items.select("id", "sig", "thumb").toArrow().combine_chunks()
    ids, sigs = table.column("id").to_numpy(), table.column("sig").to_numpy().view(np.uint64)
    thumbs = pc.list_flatten(table.column("thumb")).to_numpy().reshape(len(ids), -1 if len(ids) else 1)
    order = np.argsort(ids, kind="stable")
    if len(ids) and (thumbs == np.floor(thumbs)).all() and thumbs.min() >= 0 and thumbs.max() < 1 << 16:
        thumbs = thumbs.astype(np.uint16)
    shared = spark.sparkContext.broadcast((ids[order], sigs[order], thumbs[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sigs, thumbs = shared.value
        for batch in batches:
            for block in batch.column("id").to_pylist():
                lo = block * ROWS
                one = sigs[lo : lo + ROWS, None]
                for to in range(lo, len(ids), COLUMNS):
                    apart = np.bitwise_count(one ^ sigs[None, to : to + COLUMNS])
                    i, j = np.nonzero(apart <= most)
                    later = i + lo < j + to
                    i, j = i[later], j[later]
                    if not len(i):
                        continue
                    distance, i, j = apart[i, j].astype(np.int32), i + lo, j + to
                    r = _pearson(thumbs[i].astype(np.float64), thumbs[j].astype(np.float64))
                    kept = r >= correlation  # not where a thumb is constant
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i[kept]]), pa.array(ids[j[kept]]), pa.array(distance[kept]), pa.array(r[kept])], ["a", "b", "distance", "correlation"])

    blocks = -(-len(ids) // ROWS)
    return spark.range(0, blocks, 1, max(1, min(blocks, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "a long, b long, distance int, correlation double")


def _pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``pearson`` of the rows of two arrays; NaN if one is constant."""
    n = a.shape[1]
    cov = (a * b).sum(axis=1) - a.sum(axis=1) * b.sum(axis=1) / n
    var = [(x * x).sum(axis=1) - x.sum(axis=1) * x.sum(axis=1) / n for x in (a, b)]
    spread = np.sqrt(var[0] * var[1])
    return np.divide(cov, spread, out=np.full(len(cov), np.nan), where=spread != 0)


def pearson(a: Column, b: Column) -> Column:
    """Pearson's coefficient of two arrays; NULL if one is constant."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    n = F.size(a)
    cov = total(F.zip_with(a, b, lambda x, y: x * y)) - total(a) * total(b) / n
    var = lambda x: total(F.transform(x, lambda v: v * v)) - total(x) * total(x) / n
    return div(cov, F.sqrt(var(a) * var(b)))


def members(signatures: DataFrame) -> DataFrame:
    """(id, representative) of every item: the smallest id with its signature (and thumb)."""
    own = [c for c in ("sig", "thumb") if c in signatures.columns]
    least = signatures.groupBy(*own).agg(F.min("id").alias("representative"))
    return signatures.join(least, own).select("id", "representative")


def with_copies(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs`` of representatives and (representative, copy, 0) of every other item: every pair within the bound follows from them."""
    copies = members.filter("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    return pairs.select("a", "b", F.col("distance").cast("int")).unionByName(copies)


def pair_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(distance, correlation, n): pairs of items, counted from ``pairs`` of representatives and the numbers of their copies (which correlate fully)."""
    known = F.col("correlation") if "correlation" in pairs.columns else F.lit(None).cast("double")
    m = members.groupBy("representative").agg(F.count("*").alias("m"))
    a, b = m.select(F.col("representative").alias("a"), F.col("m").alias("ma")), m.select(F.col("representative").alias("b"), F.col("m").alias("mb"))
    apart = pairs.join(a, "a").join(b, "b").select(F.col("distance").cast("int").alias("distance"), known.alias("correlation"), (F.col("ma") * F.col("mb")).alias("n"))
    equal = m.filter("m > 1").select(F.lit(0).alias("distance"), F.lit(1.0).alias("correlation"), F.expr("m * (m - 1) div 2").alias("n"))
    return apart.unionByName(equal).groupBy("distance", "correlation").agg(F.sum("n").alias("n"))


def threshold_grid(counts: DataFrame, distances: list[int], correlations: list[float]) -> DataFrame:
    """(most, least, n): pairs within each distance and of each correlation or more, from ``pair_counts``."""
    grid = counts.sparkSession.createDataFrame([(d, float(c)) for d in distances for c in correlations], "most int, least double")
    enough = (F.col("distance") <= F.col("most")) & (F.col("correlation") >= F.col("least"))
    return F.broadcast(grid).join(counts, enough, "left").groupBy("most", "least").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


class NotConverged(RuntimeError):
    """Labels still change after the rounds allowed."""


def connected(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, label): smallest id reached by links (a, b). Minima travel and jump until nothing changes; lineage is cut each round. If ``rounds`` do not suffice, this raises."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialised(both)
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"))
    labels = materialised(labels)
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", "label", F.least("label", "m").alias("new"))
        jump = step.select("id", "label", "new").join(labels.select(F.col("id").alias("new"), F.col("label").alias("far")), "new", "left")
        step = jump.select("id", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label"))
        step = materialised(step)
        labels = step.select("id", "label")
        if not step.filter("old <> label").limit(1).count():
            return labels
    raise NotConverged(f"labels still change after {rounds} rounds")


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, label) of every item with a partner, copies included: the smallest id of its group. Only representatives take part in the rounds."""
    labels = connected(pairs).select(F.col("id").alias("representative"), "label")
    m = members.groupBy("representative").agg(F.count("*").alias("m"))
    found = m.join(labels, "representative", "left").filter("m > 1 OR label IS NOT NULL")
    return members.join(found, "representative").select("id", F.coalesce("label", "representative").alias("label"))


def group_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def pair_quality(declared: DataFrame, true: DataFrame) -> DataFrame:
    """One row (n_declared, n_true, both, precision, recall) over pairs (a, b), a < b."""
    both = declared.select("a", "b").intersect(true.select("a", "b")).agg(F.count("*").alias("both"))
    counts = declared.agg(F.count("*").alias("n_declared")).join(true.agg(F.count("*").alias("n_true"))).join(both)
    return counts.select("*", div(F.col("both"), F.col("n_declared")).alias("precision"), div(F.col("both"), F.col("n_true")).alias("recall"))


def pair_quality_of_groups(pairs: DataFrame, members: DataFrame, truth: DataFrame) -> DataFrame:
    """As ``pair_quality``: declared are all pairs of items that ``pairs`` of representatives stand for, true all pairs of one ``truth`` group (id, grp).

    Pairs are counted from group sizes and never emitted; a null group is like no other.
    """
    pairs_of = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    cells = members.join(truth, "id").filter("grp IS NOT NULL").groupBy("representative", "grp").agg(F.count("*").alias("c"))
    a, b = cells.select(F.col("representative").alias("a"), "grp", F.col("c").alias("ca")), cells.select(F.col("representative").alias("b"), "grp", F.col("c").alias("cb"))
    met = pairs.select("a", "b").join(a, "a").join(b, ["b", "grp"]).select((F.col("ca") * F.col("cb")).alias("n"))
    both = met.unionByName(cells.select(pairs_of("c").alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("both"))
    true = truth.filter("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(pairs_of("c")), F.lit(0)).alias("n_true"))
    counts = pair_counts(pairs, members).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_declared")).join(true).join(both)
    return counts.select("*", div(F.col("both"), F.col("n_declared")).alias("precision"), div(F.col("both"), F.col("n_true")).alias("recall"))


def straddling(labels: DataFrame, partitions: DataFrame) -> DataFrame:
    """One row (groups, straddling): recovered groups, and those whose members lie in several partitions."""
    rows = labels.join(partitions, "id").groupBy("label").agg((F.count_distinct("partition") > 1).cast("long").alias("s"))
    return rows.agg(F.count("*").alias("groups"), F.coalesce(F.sum("s"), F.lit(0)).alias("straddling"))


def chi_square(rows: DataFrame, row: str, positive: Column) -> DataFrame:
    """One row (n, df, chi2) of a k x 2 table; Yates' correction applies to 2 x 2 only."""
    t = rows.groupBy(row).agg(F.sum(positive.cast("long")).alias("p"), F.count("*").alias("m"))
    total = t.agg(F.sum("p").alias("hits"), F.sum("m").alias("total"), F.count("*").alias("k"))
    cells = t.join(F.broadcast(total)).select("k", "total", F.explode(F.array(F.struct(F.col("p").alias("o"), div(F.col("m") * F.col("hits"), F.col("total")).alias("e")), F.struct((F.col("m") - F.col("p")).alias("o"), div(F.col("m") * (F.col("total") - F.col("hits")), F.col("total")).alias("e")))).alias("c"))
    gap = F.abs(F.col("c.o") - F.col("c.e"))
    gap = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return cells.agg(F.max("total").alias("n"), (F.max("k") - 1).alias("df"), F.sum(div(gap * gap, F.col("c.e"))).alias("chi2"))


def mann_whitney(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """One row (n1, n2, u, z): U of the first sample by average ranks; z with tie and continuity correction."""
    counts = rows.groupBy(value).agg(F.sum(first.cast("long")).alias("a"), F.count("*").alias("m"))
    counts = running(counts.withColumn("upto", F.col("m")), [], value, ["upto"])
    ranked = counts.select("a", "m", (F.col("upto") - F.col("m") + (F.col("m") + 1) / 2.0).alias("rank"))
    s = ranked.agg(F.sum("a").alias("n1"), F.sum("m").alias("n"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("m") * F.col("m") * F.col("m") - F.col("m")).alias("ties"))
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    s = s.select(n1.alias("n1"), n2.alias("n2"), (F.col("r1") - n1 * (n1 + 1) / 2.0).alias("u"), "n", "ties")
    centre = F.col("n1") * F.col("n2") / 2.0
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (F.col("n") + 1 - div(F.col("ties"), F.col("n") * (F.col("n") - 1))))
    return s.select("n1", "n2", "u", div(F.abs(F.col("u") - centre) - 0.5, spread).alias("z"))
