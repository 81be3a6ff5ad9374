"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions alone.

*Base.* E-mail addresses, IP addresses, card and phone numbers by pattern and check (octets,
Luhn, number of digits). Places are found by splitting a text at the matches: lengths of the
parts between and of the matches themselves give code point offsets. The patterns are written
so that a match needs time linear in the text and no recursion.

*Method.* Tokens that look like identifiers (a digit and six characters, or ``key=value``) are
instances; the word before an instance, or its key, is its lexical pattern. Patterns of
``SUPPORT`` different values or more and instances form a bipartite graph that Spark scores in turns.
Seeds start it: values that overlap a checked base entity (1), and long mixes of letters and
digits (``MIXED_SEED``); all others start at 0. In each turn every pattern is judged anew from all its
edges: with ``SEEDS`` values or more that are known by now (a score of ``KNOWN`` or more), its score is
the sum of its instances' scores over all places where its words occur in the corpus (so
common words score low although identifiers follow them), else 0; then a value has the score of
its best pattern, or its seed if that is more. So what one pattern reveals seeds the next one.
Turns end when no pattern's score moves by ``STILL``, after ``ROUNDS`` at the latest. The values of
patterns of ``CONFIDENT`` or more are identifiers: every instance with such a value, in any
context, is added as kind ``id``, if it overlaps no base entity. Seeds are added by no other way.

Data flow: one scan writes a lean table of base spans and instances (no texts); edges are
aggregated before each turn; hot patterns and values cost one row per map task in aggregations, and
their joins are skew-splittable. A second scan counts words, aggregated before they are joined.

Defined results: a null text is the empty text; spans that fail their check are dropped
without retry; equal texts have equal spans; ids may be null or repeated; other columns are
ignored by ``find`` and pass through the pipeline stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.common import few, fresh, shared_dir, stored, table
from auditframe.llm.neardup import node_of

KINDS = ["email", "ip", "card", "phone", "id"]
LOCAL = r"[A-Za-z0-9._%+-]"
#: The language of the base kinds; possessive loops, tried only where a leftmost match can begin.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Instances: a token with a digit, or a key with its value.
INSTANCE = r"(?<!\S)(?:[^\s0-9]*+[0-9]\S*+|[A-Za-z_-]{2,}+[=:][^\s]{4,}+)"
KEY = r"^[\"'(\[<]*([A-Za-z_-]{2,}[=:])[\"'(\[<]*[^\s\"'=:].{2,}"
OPENING, CLOSING = r"^[\"'(\[<{]+", r"[\"')\]>},.;:!?*#%&$]+$"
MIXED = r"^(?=(?:[^0-9]*[0-9]){3})(?=(?:[^A-Za-z]*[A-Za-z]){3})[A-Za-z0-9+/_-]{12,}$"
ROUNDS, STILL, CONFIDENT, KNOWN, MIXED_SEED, SUPPORT, SEEDS = 12, 0.01, 0.6, 0.5, 0.8, 3, 2
BLOCK, BROADCAST_KEYS = 128, 300_000
#: The white space of the patterns.
WHITE = " \t\n\x0b\f\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, gap>> of all matches; ``gap``: the text since the previous one."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)

    def listed(m: Column, g: Column) -> Column:
        def of(lens: Column) -> Column:
            # Prefix sums in two levels: blocks, and places within a block.
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))

            def placed(sums: Column) -> Column:
                def begin(i: Column) -> Column:
                    block = F.floor(i / BLOCK).cast("int")
                    within = F.aggregate(F.slice(lens, block * BLOCK + 1, i - block * BLOCK), F.lit(0), lambda a, x: a + x)
                    return F.aggregate(F.slice(sums, F.lit(1), block), F.lit(0), lambda a, x: a + x) + within + F.char_length(F.get(g, i))

                return F.transform(
                    m, lambda x, i: _let(begin(i), lambda s: F.struct(s.alias("start"), (s + F.char_length(x)).alias("end"), x.alias("match"), F.get(g, i).alias("gap")))
                )

            return _let(blocks, placed)

        return _let(F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, y: F.char_length(x) + F.char_length(y)), of)

    none = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("match"), F.lit("").alias("gap"))), lambda x: F.lit(False))
    return _let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(gaps, lambda g: listed(m, g))))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False))),
    "card": lambda m: _let(_digits(m), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))),
    "phone": lambda m: F.char_length(_digits(m)).between(9, 15),
}
#: A text without this sign has no match.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>>, sorted; ``kind``: index in KINDS."""

    def spans(kind: str) -> Column:
        good = F.filter(_places(text, PATTERNS[kind]), lambda x: CHECKS[kind](x["match"]))
        out = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
        none = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind"), F.lit(0).alias("end"))), lambda x: F.lit(False))
        return F.when(F.contains(text, F.lit(SIGNS[kind])), out).otherwise(none) if SIGNS[kind] else out

    return F.array_sort(F.concat(*[spans(k) for k in PATTERNS]))


def instances(text: Column, base: Column) -> Column:
    """array<struct<start, end, pattern, value, seed, taken, long>> of the identifier-like tokens."""

    def one(x: Column, before: Column) -> Column:
        token = x["match"]
        key = F.regexp_extract(token, KEY, 1)
        # The last word: found from the end, so a long gap is not read.
        word = lambda s: reduce(lambda y, c: F.substring_index(y, c, -1), WHITE, F.rtrim(s, F.lit(WHITE)))
        left = _let(word(x["gap"]), lambda w: F.when(w != "", w).otherwise(word(before)))
        pattern = F.lower(F.when(key != "", key).otherwise(left))
        lead = F.char_length(F.regexp_extract(token, OPENING, 0))
        skip = F.when(key != "", F.instr(token, key) - 1 + F.char_length(key)).otherwise(lead)

        def valued(rest: Column) -> Column:
            inner = F.char_length(F.regexp_extract(rest, OPENING, 0))
            value = F.regexp_replace(F.substring(rest, inner + 1, F.char_length(rest)), CLOSING, "")

            def struct(v: Column) -> Column:
                start = x["start"] + skip + inner
                end = start + F.char_length(v)
                taken = F.exists(base, lambda b: (b["start"] < end) & (start < b["end"]))
                mixed = v.rlike(MIXED)
                return F.struct(
                    start.alias("start"), end.alias("end"), pattern.alias("pattern"), F.xxhash64(v).alias("value"), F.when(taken, 1.0).when(mixed, MIXED_SEED).otherwise(0.0).alias("seed"),
                    taken.alias("taken"), (F.char_length(v) >= F.when(key != "", 4).otherwise(6)).alias("long"),
                )

            return _let(value, struct)

        return _let(F.substring(token, skip + 1, F.char_length(token)), valued)

    def all_of(places: Column) -> Column:
        return F.filter(F.transform(places, lambda x, i: one(x, F.coalesce(F.get(places, i - 1)["match"], F.lit("")))), lambda x: x["long"])

    return _let(_places(text, INSTANCE), all_of)


def scored(edges: DataFrame, totals: DataFrame, path: str, rounds: int = ROUNDS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(pattern, score) after the turns; ``edges``: (pattern, value, n, seed), ``totals``: (pattern, total), both written."""
    patterns = None
    for k in range(rounds):
        if patterns is None:
            score = edges.groupBy("value").agg(F.max("seed").alias("score"))
            before = totals.select("pattern", "total", F.lit(0.0).alias("before"))
        else:
            score = edges.join(few(patterns.select("pattern", "score"), broadcast_keys), "pattern").groupBy("value").agg(F.max(F.greatest("seed", "score")).alias("score"))
            before = totals.join(patterns.select("pattern", F.col("score").alias("before")), "pattern")
        judged = edges.join(score, "value").groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("weight"), F.count_if(F.col("score") >= KNOWN).alias("known"))
        now = F.when(F.col("known") >= SEEDS, F.col("weight") / F.col("total")).otherwise(0.0)
        patterns = stored(judged.join(before, "pattern").select("pattern", now.alias("score"), "before"), f"{path}/scores{k}")
        moved = patterns.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0]
        if moved is None or moved < STILL:
            break
    return patterns.select("pattern", "score")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, node, base, extra) of each row: sorted spans of the base kinds, and those that the method adds."""
    path = shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", node_of(F.col("text")).alias("node"), "text", base_spans(F.col("text")).alias("base"))
    found = stored(rows.select("doc_id", "node", "base", instances(F.col("text"), F.col("base")).alias("instances")), f"{path}/found")
    places = found.select("node", F.explode("instances").alias("i")).select("node", "i.*")
    edges = places.filter("pattern <> ''").groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    able = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("n")).filter(F.col("values") >= SUPPORT)
    able = stored(able.withColumn("address", F.xxhash64("pattern")), f"{path}/patterns")
    edges = stored(edges.join(few(able.select("pattern"), broadcast_keys), "pattern", "left_semi"), f"{path}/edges")
    # Words are counted before they meet the patterns, so the join makes a row per pattern.
    words = F.transform(F.split(F.trim(F.lower(F.col("text"))), r"\s+"), lambda w: F.xxhash64(w))
    totals = docs.select(text.alias("text")).select(F.explode(words).alias("address")).groupBy("address").agg(F.count("*").alias("total"))
    able = stored(able.join(totals, "address", "left").select("pattern", F.greatest("n", F.coalesce("total", F.lit(0))).cast("double").alias("total")), f"{path}/totals")
    accepted = scored(edges, able, path, broadcast_keys=broadcast_keys).filter(F.col("score") >= CONFIDENT)
    known = stored(edges.join(accepted, "pattern", "left_semi").select("value").distinct(), f"{path}/known")
    span = F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")
    extra = places.filter("NOT taken").join(few(known, broadcast_keys), "value", "left_semi").groupBy("node").agg(F.sort_array(F.collect_set(span)).alias("extra"))
    extra = stored(extra, f"{path}/extra")
    none = F.filter("base", lambda x: F.lit(False))
    return found.select("doc_id", "node", "base").join(few(extra, broadcast_keys // 3), "node", "left").select("doc_id", "node", "base", F.coalesce("extra", none).alias("extra"))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    rows = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *[count(k) for k in PATTERNS],
        F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _named(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays; each span becomes ``<KIND>``, overlapping spans the first one's; ``n_chars`` follows."""
    node, spans = fresh(docs, "node", "spans")
    found = find(docs).groupBy("node").agg(F.first(F.array_sort(F.concat("base", "extra"))).alias(spans)).filter(F.size(spans) > 0)
    text, names = F.col("text"), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    empty = F.struct(F.lit(0).alias("end"), F.filter(F.array(F.lit("")), lambda x: F.lit(False)).alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        part = F.concat(F.substring(text, acc["end"] + 1, x["start"] - acc["end"]), F.get(names, x["kind"]))
        behind = F.struct(F.greatest(acc["end"], x["end"]).alias("end"), F.concat(acc["parts"], F.array(part)).alias("parts"))
        inside = F.struct(F.greatest(acc["end"], x["end"]).alias("end"), acc["parts"].alias("parts"))
        return F.when(x["start"] < acc["end"], inside).otherwise(behind)

    masked = F.aggregate(spans, empty, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["end"] + 1, F.char_length(text))))
    rows = docs.withColumn(node, node_of(text)).join(found.select(F.col("node").alias(node), spans), node, "left")
    touched = F.col(spans).isNotNull()
    rows = rows.withColumn("text", F.when(touched, masked).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(touched, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
