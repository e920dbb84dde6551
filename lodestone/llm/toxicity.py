"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated.

Learning takes a bounded sample of labelled rows, sample_rows by hash order of doc_id,
and deals it by another hash into three parts. The first gives a lexicon: words and word
beginnings of 3 to 5 letters with their log odds. The features of the second train the
trees, those of the third an isotonic calibration, so that no part judges itself.
Scoring is one pass over all documents. Features: densities and strengths of lexicon
words, their nearness to the second person, capitals, punctuation and obfuscation rates.

Edge cases: a null or empty text has features of zero and a score like any other; a null
doc_id counts as the empty text in the fold rule; labels that are null are not used, of
several labels for a doc_id the largest holds, and rows that share a doc_id are scored
row by row; with no labels, or labels of one kind only, every score is the share of
label 1 (0 for none); an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, parts, text_or_empty

SAMPLE_ROWS = 40_000
LEXICON_WORDS = 5_000
LEXICON_LEAST_DOCS, LEXICON_LEAST_ODDS = 4, 1.5
FOLDS = 5
MEMO_WORDS = 150_000
NEAR_WORDS = 5

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ya du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus vosotros usted ustedes".split()
)
# Signs that stand for letters in disguised words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", "-": "", ".": "", "'": ""})
INNER = re.compile(r"[^\W\d_]+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
N_FEATURES = 17


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def forms(word: str) -> list[str]:
    """What a lower-case word is looked up by: itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in (3, 4, 5) if len(word) > n)]


class WordCodes(dict):
    """word -> packed number: lexicon strength in hundredths << 3 | capitals << 2 | disguised << 1 | second person."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        core = EDGES.sub("", word)
        low = core.lower()
        disguised = bool(core) and INNER.fullmatch(core) is None and INNER.search(core) is not None
        names = forms(low) + (forms(low.translate(DISGUISES)) if disguised else [])
        strength = max((self.lexicon.get(f, 0.0) for f in names), default=0.0)
        self[word] = code = int(strength * 100) << 3 | (len(core) > 1 and core.isupper()) << 2 | disguised << 1 | (low in SECOND_PERSON)
        return code


def features(text: str, codes: WordCodes) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    raw = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    n = len(words)
    if not n:
        return out
    packed = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    strength = (packed >> 3) / 100
    strong = strength >= 3
    hits = np.flatnonzero(strong)
    second = np.flatnonzero(packed & 1)
    near = 0
    if len(hits) and len(second):
        k = np.searchsorted(second, hits)
        left = np.abs(hits - second[np.maximum(k - 1, 0)])
        right = np.abs(hits - second[np.minimum(k, len(second) - 1)])
        near = int((np.minimum(left, right) <= NEAR_WORDS).sum())
    by_byte = np.bincount(raw, minlength=256)
    letters = by_byte[65:91].sum() + by_byte[97:123].sum() + by_byte[192:].sum()
    punctuation = by_byte[33:48].sum() + by_byte[58:65].sum() + by_byte[91:97].sum() + by_byte[123:127].sum()
    top = np.sort(strength)[-3:]
    out[:] = (
        math.log1p(n),
        len(hits) / n,
        math.log1p(len(hits)),
        (strength >= LEXICON_LEAST_ODDS).mean(),
        top[-1],
        top.mean(),
        strength.mean(),
        len(second) / n,
        near / n,
        by_byte[65:91].sum() / max(1, letters),
        ((packed >> 2) & 1).mean(),
        punctuation / len(raw),
        (by_byte[33] + by_byte[63]) / len(raw),
        ((packed >> 1) & 1).mean(),
        (strong & ((packed >> 1) & 1 == 1)).mean(),
        len(raw) / n,
        by_byte[48:58].sum() / len(raw),
    )
    return out


class BoostedTrees:
    """Trees of logistic loss over binned features, with second-order leaves."""

    def __init__(self, n_trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least_weight: float = 3.0, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = n_trees, depth, rate, bins, least_weight, ridge
        self.base, self.trees, self.cuts = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(share / (1 - share))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            tree: list[tuple] = []
            self._grow(tree, binned, p - y, p * (1 - p), np.arange(len(y)), self.depth, margin)
            self.trees.append(tree)
        return self

    def _grow(self, tree: list, binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, margin: np.ndarray) -> int:
        here = len(tree)
        tree.append(())
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0)
        if depth:
            whole = total_g**2 / (total_h + self.ridge)
            for f, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts) + 1))[:-1]
                right_h = total_h - left_h
                gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (right_h + self.ridge) - whole
                gain[(left_h < self.least) | (right_h < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] < 0:
            value = -self.rate * total_g / (total_h + self.ridge)
            margin[rows] += value
            tree[here] = (-1, value, 0, 0)
            return here
        _, f, k = best
        goes = binned[rows, f] <= k
        left = self._grow(tree, binned, g, h, rows[goes], depth - 1, margin)
        right = self._grow(tree, binned, g, h, rows[~goes], depth - 1, margin)
        tree[here] = (f, float(self.cuts[f][k]), left, right)
        return here

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            f, v, left, right = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(self.depth):
                inner = f[at] >= 0
                low = x[np.arange(len(x)), np.maximum(f[at], 0)] <= v[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            out += v[at]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on margin: equal margins are one, then adjacent violators are pooled."""
    at, back = np.unique(margin, return_inverse=True)
    count, ones = np.bincount(back), np.bincount(back, y)
    blocks: list[list[float]] = []  # sum of y, count, sum of margin
    for m, n, k in zip(at.tolist(), count.tolist(), ones.tolist(), strict=True):
        blocks.append([k, n, n * m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """What scoring needs: lexicon, trees and calibration, or one constant."""

    def __init__(self, constant: float = 0.0, lexicon: dict[str, float] | None = None, trees: BoostedTrees | None = None, knots: tuple | None = None):
        self.constant, self.lexicon, self.trees, self.knots = constant, lexicon or {}, trees, knots

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        margin = self.trees.margin(x)
        return np.interp(margin, *self.knots)


def feature_rows(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """part, label and features of (part, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(lexicon)
        for batch in batches:
            x = [features(t, codes).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["part", "label", "x"])

    return docs.select("part", "label", "text").mapInArrow(run, "part int, label int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, lexicon_words: int = LEXICON_WORDS) -> Model:
    spark = docs.sparkSession
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    share = sum(r.label for r in ids) / len(ids) if ids else 0.0
    if share in (0.0, 1.0):
        return Model(share)
    # at most sample_rows pairs of numbers, which bounds the broadcast
    picked = F.broadcast(spark.createDataFrame(ids, "doc_id long, label int"))
    part = (F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(6)) / 2).cast("int")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(picked, "doc_id")
    # of rows that share a doc_id one text is learnt from, so the sample stays within its bound
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(part.alias("part"), "label", "text")

    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    named = F.flatten(F.transform(words, lambda w: F.array(w, *(F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in (3, 4, 5)))))
    first = sample.where("part = 0")
    counted = first.select("label", F.explode(F.array_distinct(named)).alias("word")).where("word is not null and word <> ''").groupBy("word").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    size = first.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    odds = F.log((F.col("pos") + 0.5) / (size.pos + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (size.n - size.pos + 1))
    chosen = counted.where(F.col("pos") >= LEXICON_LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEXICON_LEAST_ODDS)
    lexicon = {r.word: float(r.odds) for r in chosen.orderBy(F.desc(F.col("odds") * F.log1p("pos")), "word").limit(lexicon_words).collect()}

    rows = feature_rows(sample.where("part > 0"), lexicon).toPandas()
    parts = []
    for k in (1, 2):
        of_k = rows[rows["part"] == k]
        x, y = np.array(of_k["x"].tolist()).reshape(-1, N_FEATURES), of_k["label"].to_numpy(float)
        order = np.lexsort((*x.T, y))  # rows come in no fixed order
        parts.append((x[order], y[order]))
    if any(len(set(y)) < 2 for _, y in parts):
        return Model(share)
    trees = BoostedTrees().fit(*parts[0])
    return Model(share, lexicon, trees, isotonic(trees.margin(parts[1][0]), parts[1][1]))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """docs with score and predicted added; columns of docs with these names are replaced."""
    docs = docs.drop("score", "predicted")
    byte_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(shared.value.lexicon)
        for whole in batches:
            for batch in parts(whole, at_text):
                x = np.array([features(t or "", codes) for t in batch.column(at_text).to_pylist()]).reshape(-1, N_FEATURES)
                p = shared.value.scores(x)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"]
                )

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{have}, score double, predicted int")
