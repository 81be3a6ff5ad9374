"""Line deduplication by a tree of line templates.

Lines are read as log parsers read them, in a tree of fixed depth: first by the number of
tokens, then by the leading tokens (``LEADING``), tokens with digits counting as variable.
In a leaf, the support of a token at its position is the number of texts that have it there,
summed over the leaf's different lines. A line of n tokens may vary in v = floor((1 - ``ALIKE``) n)
of them, and has two templates:

* *sparse*: the tokens with a support below ``MIN_DOCS``, which no recurring template can hold,
  become variable; a line with more than v of them has no such template;
* *full*: its v least supported tokens (the first of equal ones) become variable.

Lines of one leaf with equal templates belong together: they agree in a share of ``ALIKE`` of their
tokens or more, at the same places. A template of ``MIN_DOCS`` different texts or more recurs, and
a line of recurring templates belongs to that of the most texts (the sparse one if equal). The
lines of a template are boilerplate: they are dropped everywhere but in the text with the
smallest id that has one, so content that is merely copied stays in the corpus once. A line of
``LONG`` tokens or more is a passage rather than a chance repeat: it is dropped likewise if it is the
same (but for tokens with digits) in ``LONG_DOCS`` different texts, whatever its templates do.

Every step is a count by a key: templates depend on no order of lines, no partition and no size,
and no leaf is ever in one task.

Data flow: (1) a lean table of (leaf, line, text) hashes counts, by leaf, the texts; (2) only
leaves with enough texts give their distinct lines, as token hashes, to the supports; (3) lines
and templates are counted over all texts; (4) a last pass over the documents drops lines. Sets
that travel to the passes (2) to (4) are broadcast only if counted small (``BROADCAST_KEYS``); else
they are joined. Copies of a text count once, and every aggregation combines before it shuffles.

Defined results: a null text stays null and has no lines; lines are separated by line feeds
and keep their other white space; lines of fewer than ``MIN_TOKENS`` tokens (blank ones too)
are never dropped; repeated rows are treated alike; ids may be null (they sort last) or
repeated; a text without dropped lines stays as it is, byte for byte; other columns, whatever
their names, pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from auditframe.llm.common import few, fresh, map_rows, shared_dir, stored, table, tidy

MIN_DOCS, MIN_TOKENS, LEADING, ALIKE = 4, 3, 3, 0.85
#: A line of LONG tokens or more recurs from LONG_DOCS different texts on.
LONG, LONG_DOCS = 20, 2
BROADCAST_KEYS = 300_000
LAST_ID = 2**63 - 1


#: What stands for a variable token, and how one is found.
FIELD, DIGIT, FIELDS = "\0", re.compile(r"\d"), re.compile(r"(?<!\S)[^\s\d]*\d\S*")


def parse(line: str) -> tuple[int, int, list[str]] | None:
    """(leaf, line hash, tokens) of a line, None if it is too short. Hashes are of the tokens, variable ones masked."""
    if DIGIT.search(line):
        line = FIELDS.sub(FIELD, line)
    words = line.split()
    if len(words) < MIN_TOKENS:
        return None
    leaf = xxhash.xxh64_intdigest(" ".join(words[:LEADING]).encode("utf-8", "surrogatepass"), seed=len(words))
    return _signed(leaf), _signed(xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))), words


def token_hashes(words: list[str]) -> list[int]:
    """A positive number for each token; 0 for variable ones."""
    return [0 if w == FIELD else (xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) >> 1) or 1 for w in words]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _text_key(text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


LINE_ROWS, TOKEN_ROWS = "leaf long, line long, long long, text_key long, doc_id long", "leaf long, line long, tokens array<int>"


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            key = _text_key(text)
            parsed = [parse(line) for line in text.split("\n")]
            rows.extend((*x, key, doc) for x in {(*p[:2], int(len(p[2]) >= LONG)) for p in parsed if p})
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["leaf", "line", "long", "text_key", "doc_id"])


def _token_rows(wanted: Callable[[int], bool]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}
            for text in batch.column("text"):
                for line in (text.as_py() or "").split("\n"):
                    if (p := parse(line)) and p[1] not in rows and wanted(p[0]):
                        rows[p[1]] = (p[0], token_hashes(p[2]))
            if rows:
                leaf, data = zip(*rows.values())
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(list(rows), pa.int64()), pa.array(data, pa.list_(pa.int32()))], ["leaf", "line", "tokens"])

    return run


def templates(lines: DataFrame, min_docs: int = MIN_DOCS, alike: float = ALIKE, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(leaf, line, template): the sparse and the full template (a hash) of each line; ``lines``: (leaf, line, texts, tokens), written."""
    each = lines.select("leaf", "line", "texts", F.posexplode("tokens").alias("p", "t")).filter("t <> 0")
    support = each.groupBy("leaf", "p", "t").agg(F.sum("texts").alias("support")).filter(F.col("support") >= min_docs)
    support = stored(support, f"{shared_dir(lines.sparkSession)}/support")
    place = F.struct(F.coalesce("support", F.lit(0)).alias("support"), "p", "t")
    known = each.join(few(support, broadcast_keys), ["leaf", "p", "t"], "left").groupBy("leaf", "line").agg(F.array_sort(F.collect_list(place)).alias("places"))
    # Lines of variable tokens alone have no places.
    known = lines.select("leaf", "line", F.size("tokens").alias("n")).join(known, ["leaf", "line"], "left")
    places = F.coalesce("places", F.array().cast("array<struct<support: bigint, p: int, t: int>>"))
    known = known.select("leaf", "line", "n", places.alias("places"), (F.col("n") - F.ceil(F.lit(alike) * F.col("n") - 1e-9)).cast("int").alias("v"))
    rare = F.size(F.filter("places", lambda x: x["support"] < min_docs))
    fixed = lambda masked: F.xxhash64("leaf", F.array_sort(F.transform(F.slice("places", masked + 1, F.size("places")), lambda x: F.struct(x["p"].alias("p"), x["t"].alias("t")))))
    both = F.array_distinct(F.array_compact(F.array(F.when(rare <= F.col("v"), fixed(rare)), fixed(F.least("v", F.size("places"))))))
    return known.select("leaf", "line", F.posexplode(both).alias("rank", "template"))


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``(line, keeper)``: hashes of the lines of recurring templates, and the text that keeps each. ``docs``: (doc_id, text)."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    seen = docs.mapInArrow(tidy(_line_rows), LINE_ROWS)
    seen = stored(seen.groupBy("leaf", "line", "long", "text_key").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("doc_id")), f"{path}/seen")
    lines = seen.groupBy("leaf", "line").agg(F.count("*").alias("texts"))
    leaves = stored(seen.groupBy("leaf").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_docs).select("leaf"), f"{path}/leaves")
    side = few(leaves, broadcast_keys)
    if leaves.count() <= broadcast_keys:
        wanted = spark.sparkContext.broadcast(frozenset(r.leaf for r in leaves.toLocalIterator()))
        tokens = docs.mapInArrow(tidy(_token_rows(lambda leaf: leaf in wanted.value)), TOKEN_ROWS)
    else:
        tokens = docs.mapInArrow(tidy(_token_rows(lambda leaf: True)), TOKEN_ROWS).join(leaves, "leaf", "left_semi")
    tokens = tokens.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    lines = stored(lines.join(side, "leaf", "left_semi").join(tokens, ["leaf", "line"]).select("leaf", "line", "texts", "tokens"), f"{path}/lines")
    able = stored(templates(lines, min_docs, broadcast_keys=broadcast_keys), f"{path}/templates")
    # Different texts of each template; then the one of most texts for each line; then who keeps it.
    texts = seen.join(few(able, broadcast_keys), ["leaf", "line"]).select("template", "text_key").distinct()
    counts = stored(texts.groupBy("template").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_docs), f"{path}/counts")
    chosen = able.join(few(counts, broadcast_keys), "template").groupBy("leaf", "line").agg(F.max_by("template", F.struct("texts", -F.col("rank"))).alias("template"))
    chosen = stored(chosen, f"{path}/chosen")
    keeper = F.min_by("text_key", F.struct("doc_id", "text_key")).alias("keeper")
    keepers = seen.join(few(chosen, broadcast_keys), ["leaf", "line"]).groupBy("template").agg(keeper)
    passages = seen.filter("long = 1").groupBy("line").agg(F.count("*").alias("texts"), keeper).filter(F.col("texts") >= min(min_docs, LONG_DOCS)).select("line", "keeper", F.lit(1).alias("rank"))
    both = chosen.join(keepers, "template").select("line", "keeper", F.lit(0).alias("rank")).unionByName(passages)
    return stored(both.groupBy("line").agg(F.min_by("keeper", "rank").alias("keeper")), f"{path}/recurring")


def _clean(text: str, keepers: dict[int, int]) -> tuple[str, int, int]:
    """(text without dropped lines, lines, dropped lines)."""
    lines, key, kept = text.split("\n"), None, []
    for line in lines:
        p = parse(line)
        keeper = keepers.get(p[1]) if p else None
        if keeper is not None:
            key = _text_key(text) if key is None else key
        if keeper is None or keeper == key:
            kept.append(line)
    return (text if len(kept) == len(lines) else "\n".join(kept)), len(lines), len(lines) - len(kept)


def drop_recurring(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS, read: str = "lines_read", dropped: str = "lines_dropped") -> DataFrame:
    """``docs`` with cleaned texts, and numbers of lines in two more columns, ``read`` and ``dropped``, which ``docs`` must not have."""
    spark = docs.sparkSession
    if {read.lower(), dropped.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"name other columns for the numbers of lines than {read} and {dropped}")
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = recurring(lean, min_docs, broadcast_keys)
    at, width, beside = docs.columns.index(text_col), len(docs.columns), ()
    if found.count() <= broadcast_keys:
        known = spark.sparkContext.broadcast({r.line: r.keeper for r in found.toLocalIterator()})
        rows = docs
    else:
        address, keepers = fresh(docs, "address", "keepers")
        beside = (keepers,)
        pairs = lean.mapInArrow(tidy(_line_rows), LINE_ROWS).select("line", "text_key").distinct().join(found, "line")
        mine = pairs.groupBy("text_key").agg(F.map_from_entries(F.collect_set(F.struct("line", "keeper"))).alias(keepers))
        keys = lean.mapInArrow(tidy(_keys), "address binary, text_key long").distinct()
        rows = docs.withColumn(address, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
        rows = rows.join(keys.join(mine, "text_key").select(F.col("address").alias(address), keepers), address, "left").select(*[F.col(f"`{c}`") for c in docs.columns], keepers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_read, n_dropped = [], [], []
            own = batch.column(width).to_pylist() if batch.num_columns > width else None
            for i, text in enumerate(batch.column(at)):
                text = text.as_py()
                new = (None, 0, 0) if text is None else _clean(text, known.value if own is None else dict(own[i] or ()))
                for to, value in zip((texts, n_read, n_dropped), new):
                    to.append(value)
            columns = list(batch.columns)[:width]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_read, pa.int64()), pa.array(n_dropped, pa.int64())], [f"c{i}" for i in range(width + 2)])

    return map_rows(rows, run, {read: LongType(), dropped: LongType()}, beside)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([_text_key(t) for t in texts], pa.int64())], ["address", "text_key"])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop recurring lines from every document."""
    clean = drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select(
        "doc_id",
        F.col("lines_read").alias("n_lines"),
        F.col("lines_dropped").alias("n_dropped"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def strip_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays, without recurring lines; ``n_chars`` follows the text."""
    read, dropped = fresh(docs, "lines_read", "lines_dropped")
    clean = drop_recurring(docs, read=read, dropped=dropped)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col(dropped) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
