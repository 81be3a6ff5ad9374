"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

The 5-word shingles of a text are hashed once. The top bits of a hash choose one of ``BINS``
bins, the rest is its value; each bin keeps its least value. An empty bin is filled by
optimal densification: it copies a full bin chosen by a universal hash of (empty bin, full
bin), the same for every text, so two texts agree there with probability equal to their
resemblance. Stored are the ``BITS`` low-order bits of each bin, packed. Two unrelated values
agree by chance with probability 2^-BITS; the likeness is corrected for that.

How bins are found without a loop: hashes are sorted together with one sentinel per bin, so
an element whose bin differs from its predecessor's is that bin's least value, or the
sentinel of an empty bin.

``edited_pairs`` brings each text together with the next one by id. Ids are cut into ranges of
about ``RANGE_ROWS`` rows (rows without an id by a hash of their text); a text goes to its range, and
the first text of each range also to the range before (the very first to the last), so one
shuffle and a window within ranges give every successor. Which range comes before is found in two
levels, within ``BLOCK`` ranges and between blocks, so no window holds all ranges; their table is
broadcast only if counted small (``BROADCAST_RANGES``), else joined. The shuffle of texts has as many
partitions as their bytes need (``PART_BYTES``).

Defined results: a null text is the empty text; a text with fewer than five words has one
shingle, all its words; equal texts have equal fingerprints; rows are ordered by id, then text, so
repeated ids follow each other; null ids come first, in order of a hash of their text, then the
text; a single row is its own successor; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditframe.llm.common import checkpointed, table

SHINGLE, BIN_BITS, BITS = 5, 7, 8
BINS = 1 << BIN_BITS
VALUE_BITS = 63 - BIN_BITS
EMPTY = (1 << VALUE_BITS) - 1
RANGE_ROWS, BLOCK, BROADCAST_RANGES, PART_BYTES = 1024, 4096, 200_000, 64 << 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
        return F.when(F.size(words) < size, F.array(F.xxhash64(words))).otherwise(many)

    return _let(F.split(F.trim(text), r"\s+"), of)


def _bin(code: Column) -> Column:
    return F.shiftrightunsigned(code, VALUE_BITS)


def _is_full(code: Column) -> Column:
    return code.bitwiseAND(F.lit(EMPTY)) != F.lit(EMPTY)


def signature(text: Column) -> Column:
    """``BINS`` values of ``BITS`` bits (array<tinyint>, shifted to be signed)."""
    low = F.lit((1 << BITS) - 1).cast("long")
    sentinels = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.shiftleft(b, VALUE_BITS).bitwiseOR(F.lit(EMPTY)))

    def least(codes: Column) -> Column:
        before = F.concat(F.array(F.lit(-1).cast("long")), F.slice(codes, F.lit(1), F.size(codes) - 1))
        return F.filter(F.zip_with(codes, before, lambda x, p: F.when(_bin(x) != _bin(p), x)), lambda x: x.isNotNull())

    def dense(bins: Column) -> Column:
        def fill(full: Column) -> Column:
            def donor(x: Column) -> Column:
                rank = lambda v: F.shiftleft(F.shiftrightunsigned(F.xxhash64(_bin(x), _bin(v)), 16), BITS)
                return F.array_min(F.transform(full, lambda v: rank(v).bitwiseOR(v.bitwiseAND(low)))).bitwiseAND(low)

            return F.transform(bins, lambda x: F.when(_is_full(x), x.bitwiseAND(low)).otherwise(donor(x)) - (1 << (BITS - 1)))

        return _let(F.filter(bins, _is_full), fill)

    codes = F.sort_array(F.concat(F.transform(shingle_hashes(text), lambda h: F.shiftrightunsigned(h, 1)), sentinels))
    return _let(_let(codes, least), dense).cast("array<tinyint>")


def packed(values: Column) -> Column:
    """The fingerprint as a hexadecimal string."""
    return F.array_join(F.transform(values, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + (1 << (BITS - 1))), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two signatures, corrected for chance agreement."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def _before(ranges: DataFrame) -> DataFrame:
    """(begin, h, before): of each range (r, begin, h) the one that precedes it, of the first one the last."""
    rows = ranges.withColumn("block", F.struct("r.known", F.expr(f"r.i div {BLOCK}L").alias("i")))
    here = Window.partitionBy("block").orderBy("r")
    rows = rows.withColumn("before", F.lag("r").over(here))
    last = rows.groupBy("block").agg(F.max("r").alias("last"))
    order = Window.orderBy("block")  # one row per block
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = last.select("block", F.coalesce(F.lag("last").over(order), F.max("last").over(whole)).alias("last"))
    return rows.join(last, "block").select("begin", "h", F.coalesce("before", "last").alias("before"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """(doc_id, text, sig, next_text, next_sig) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # h orders the rows without an id; it is 0 for all others.
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text.alias("text"))
    rows = rows.select("k", "text", F.when(F.col("k").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 1)).otherwise(0).alias("h"))
    ids = rows.select("k", "h")
    n, nulls, size = rows.agg(F.count("k"), F.count_if(F.col("k").isNull()), F.sum(F.octet_length("text").cast("long"))).first()
    lo, hi = ids.filter("k IS NOT NULL").approxQuantile("k", [0.25, 0.75], 0.01) if n else (0, 0)
    width = max(1, int((hi - lo) / max(1.0, n / 2 / RANGE_ROWS)))
    parts = max(1, nulls // RANGE_ROWS)
    # Ranges without an id (known: 0) come before all others.
    number = F.when(F.col("k").isNull(), F.floor(F.col("h") / (2.0**63 / parts)).cast("long")).otherwise(F.expr(f"k div {width}L"))
    bucket = F.struct(F.col("k").isNotNull().cast("int").alias("known"), number.alias("i"))
    ranges = ids.select("k", "h", bucket.alias("r")).groupBy("r").agg(F.min("k").alias("begin"), F.min("h").alias("h"))
    begins = checkpointed(_before(ranges), "ranges")
    side = (F.broadcast(begins) if begins.count() <= broadcast_ranges else begins).select(F.col("begin"), F.col("h").alias("begin_h"), "before")
    first = F.col("k").eqNullSafe(F.col("begin")) & (F.col("h") == F.col("begin_h"))
    placed = rows.select("k", "h", "text", bucket.alias("r"), signature(F.col("text")).alias("sig")).join(side, first, "left")
    here = F.struct(F.col("r"), F.lit(False).alias("guest"))
    both = F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("before").alias("r"), F.lit(True).alias("guest"))))
    placed = placed.select("k", "h", "text", "sig", F.explode(both).alias("at")).select("k", "h", "text", "sig", "at.r", "at.guest")
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (size or 0) // PART_BYTES + 1)
    follow = Window.partitionBy("r").orderBy("guest", "k", "h", "text")
    paired = placed.repartition(spread, "r").select("k", "text", "sig", "guest", F.lead("text").over(follow).alias("next_text"), F.lead("sig").over(follow).alias("next_sig"))
    return paired.filter(~F.col("guest")).select(F.col("k").alias("doc_id"), "text", "sig", "next_text", "next_sig")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text."""
    pairs = edited_pairs(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    half = F.expr("char_length(text) div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sig", "next_sig")
    rows = rows.select("*", signature(F.col("edited")).alias("edited_sig"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
