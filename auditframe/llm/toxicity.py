"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. A bounded sample of labelled training rows is drawn (``SAMPLE_ROWS``, those with the
   smallest hash of their id) and divided into three folds by that hash.
2. The first fold gives the lexicon: Spark counts, for whole words and word beginnings, in
   how many toxic and other texts they occur; units with high log-odds stay (``LEXICON_UNITS``
   at most). Words are folded first: case, and signs that stand for letters.
3. Dense features of the other folds: lexicon densities (strong, weak), strongest units,
   hits near a second-person word, capitals, punctuation, obfuscation and repetition rates,
   length. The second fold fits the trees (second-order boosting on feature histograms), the
   third fits the isotonic calibration (pool adjacent violators).
4. Every text is scored in one pass over the documents, without a shuffle; lexicon and model
   are small and bounded, so they travel with the task.

A score depends on the text alone: not on its label, language, source or id.

Defined results: a null text is the empty text and gets a score; a row whose id is null
counts as not held out; repeated rows get equal scores; of repeated labels the larger holds,
and null labels count as absent; without training rows of both classes every score is the
share of toxic training rows (0 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.common import checkpointed, map_rows, table, tidy

SAMPLE_ROWS, LEXICON_UNITS = 20_000, 4_000
#: Word beginnings of these lengths are lexicon units beside whole words.
STEMS = range(3, 9)
#: Texts of the lexicon fold that must have a unit, and its least log-odds.
LEAST_TEXTS, LEAST_ODDS, STRONG_ODDS = 4, 1.5, 3.0
#: Words of the second person in the languages at hand.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "tú", "ti", "tus", "vosotros"]
NEAR = 5
#: Signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
EDGES = "\"'`.,;:!?()[]{}<>|#%&*~^+=/\\-_$…«»“”„"
TREES, DEPTH, RATE, BINS, L2, LEAST_HESSIAN = 60, 3, 0.2, 32, 1.0, 2.0
CACHE_WORDS = 300_000


def folded(word: str) -> str:
    """Lower case, without punctuation around it, signs inside read as letters."""
    word = word.strip(EDGES).lower()
    return word if word.isalpha() or not any(c.isalpha() for c in word) else word.translate(SIGNS)


def units(text: str) -> set[str]:
    """Whole words (with an end mark) and beginnings."""
    out = set()
    for w in {folded(w) for w in text.split()}:
        out.add(w + " ")
        out.update(w[:n] for n in STEMS if len(w) >= n)
    return out


@cache
def _kinds() -> np.ndarray:
    """0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 exclamation or question mark, 6 other punctuation."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        out[c] = 2 if s.isupper() else 1 if s.isalpha() else 3 if s.isdigit() else 4 if s.isspace() else 5 if s in "!?" else 6 if s.isprintable() else 0
    out[0x3000:] = 1
    return out


class Words(dict):
    """Folded word to (log-odds of its strongest unit, 1 if second person, 1 if obfuscated); bounded."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.you = lexicon, frozenset(SECOND_PERSON)

    def __missing__(self, word: str) -> tuple[float, int, int]:
        w = folded(word)
        odds = max((self.lexicon[u] for u in [w + " ", *(w[:n] for n in STEMS if len(w) >= n)] if u in self.lexicon), default=0.0)
        inner = word.strip(EDGES)
        mixed = int(any(c.isalpha() for c in inner) and not inner.replace("'", "").replace("-", "").isalpha())
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = (odds, int(w in self.you), mixed)
        return out


FEATURES = ["strong", "weak", "strong_count", "odds_max", "odds_top3", "odds_mean", "near_you", "you", "capitals", "marks", "punctuation", "digits", "obfuscated", "repeated", "length"]


def features(text: str, words: Words) -> list[float]:
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    odds, you, mixed = np.array([words[w] for w in tokens]).T
    n = len(tokens)
    hits = np.flatnonzero(odds >= STRONG_ODDS)
    spoken = np.flatnonzero(you)
    near = 0
    if len(hits) and len(spoken):
        k = np.searchsorted(spoken, hits)
        gap = np.minimum(np.abs(spoken[np.minimum(k, len(spoken) - 1)] - hits), np.abs(spoken[np.maximum(k - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    kinds = np.bincount(_kinds().take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)), minlength=7)
    letters, chars = max(1, kinds[1] + kinds[2]), max(1, len(text))
    top = np.sort(odds)[-3:]
    return [
        len(hits) / n, float(((odds >= LEAST_ODDS) & (odds < STRONG_ODDS)).mean()), float(len(hits)), float(top[-1]), float(top.sum()), float(odds.mean()),
        near / n, len(spoken) / n, kinds[2] / letters, kinds[5] / chars, kinds[6] / chars, kinds[3] / chars, float(mixed.mean()),
        1 - len(set(tokens)) / n, float(np.log1p(n)),
    ]


@dataclass
class Model:
    """Trees as arrays (feature, threshold, value by heap position), and the calibration's steps."""

    lexicon: dict[str, float]
    prior: float
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    steps: tuple[np.ndarray, np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += value[at - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.prior)
        raw = self.margin(x)
        # The trace of the margin keeps the order within a step.
        return 0.999 * np.interp(raw, *self.steps) + 0.001 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Second-order boosting of trees of fixed depth on histograms of the features."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], 1)
    width, margin, trees = BINS, np.full(len(x), base), []
    keys = binned + np.arange(x.shape[1]) * width
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        inner = 2**DEPTH - 1
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**DEPTH)
        at = np.zeros(len(x), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) < 2:
                at[rows] = 2 * node + 1
                continue
            flat = keys[rows].ravel()
            gs = np.bincount(flat, np.repeat(g[rows], x.shape[1]), width * x.shape[1]).reshape(-1, width).cumsum(1)
            hs = np.bincount(flat, np.repeat(h[rows], x.shape[1]), width * x.shape[1]).reshape(-1, width).cumsum(1)
            tg, th = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + L2) + (tg - gs) ** 2 / (th - hs + L2) - tg**2 / (th + L2)
            gain[(hs < LEAST_HESSIAN) | (th - hs < LEAST_HESSIAN)] = 0
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] > 1e-6 and b < len(edges[f]):
                feature[node], threshold[node] = f, edges[f][b]
                at[rows] = 2 * node + 1 + (binned[rows, f] > b)
            else:
                at[rows] = 2 * node + 1
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + L2)
        margin += value[leaf]
        trees.append((feature, threshold, value))
    return base, trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone calibration: pool adjacent violators over distinct margins."""
    xs, index = np.unique(raw, return_inverse=True)
    n = np.bincount(index).astype(float)
    s = np.bincount(index, y)
    blocks: list[list[float]] = []  # sum, weight, first and last margin
    for x, total, weight in zip(xs, s, n):
        blocks.append([total, weight, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = [k for b in blocks for k in ([b[2]] if b[2] == b[3] else [b[2], b[3]])]
    values = [b[0] / b[1] for b in blocks for _ in range(1 if b[2] == b[3] else 2)]
    return np.array(knots), np.array(values)


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by unit within a batch: a partial aggregation."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for u in units(text or ""):
                counts.setdefault(u, [0, 0])[toxic] += 1
        if counts:
            clean, toxic = zip(*counts.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], ["unit", "toxic", "clean"])


def _feature_rows(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in batches:
            x = [features(t or "", words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "fold")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    return run


def fit(train: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the texts of ``docs`` that ``train`` labels, on a sample of ``sample_rows`` at most."""
    labels = train.select(F.col(id_col).cast("long").alias("of"), F.col(label_col).cast("int").alias("toxic")).dropna()
    order = F.xxhash64(F.col("of"))
    sample = labels.groupBy("of").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(order, "of").limit(sample_rows)
    sample = checkpointed(sample.withColumn("fold", F.pmod(F.xxhash64(order), F.lit(5))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The sample has sample_rows rows of 20 bytes at most: a proven bound.
    known = checkpointed(rows.join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select("doc_id", "text", "toxic", "fold"))
    n = {r.toxic: r.n for r in known.filter("fold < 2").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    if len(n) < 2:
        return Model({}, prior, 0.0, [], (np.zeros(1), np.zeros(1)))
    counted = known.filter("fold < 2").mapInArrow(tidy(_unit_rows), "unit string, toxic long, clean long")
    counted = counted.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= LEAST_TEXTS)
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    top = counted.select("unit", odds.alias("odds"), "toxic").filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), F.desc("toxic"), "unit").limit(LEXICON_UNITS)
    lexicon = {r.unit: r.odds for r in top.collect()}
    dense = known.filter("fold >= 2").mapInArrow(tidy(_feature_rows(lexicon)), "doc_id long, toxic int, fold long, x array<double>").collect()
    dense.sort(key=lambda r: (r.doc_id, r.x))
    x, y, fold = np.array([r.x for r in dense]).reshape(len(dense), -1), np.array([r.toxic for r in dense], float), np.array([r.fold for r in dense])
    grow = fold < 4
    if len(set(y[grow])) < 2 or len(set(y[~grow])) < 2:
        return Model(lexicon, prior, 0.0, [], (np.zeros(1), np.zeros(1)))
    model = Model(lexicon, prior, *fit_trees(x[grow], y[grow]), (np.zeros(1), np.zeros(1)))
    model.steps = isotonic(model.margin(x[~grow]), y[~grow])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` in place of all but the id and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.lexicon)
        for batch in batches:
            x = np.array([features(t or "", words) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    labels = table(spark, sf_dir, "labels")
    return fit(labels.filter(~held_out(F.col("doc_id"))), docs)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of held-out rows are not read."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, trained(spark, sf_dir, docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose score is below 0.5, with all their columns."""
    model, at = trained(spark, sf_dir, docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.lexicon)
        for batch in batches:
            x = np.array([features(t or "", words) for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, -1)
            yield batch.filter(pa.array(model.score(x) < 0.5))

    return map_rows(docs, run)
