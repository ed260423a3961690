"""Toxicity by classifier chains.

Categories are predicted one after another by linear (logistic) models. Each later model also gets the probabilities
of the earlier categories as features; for training these are out-of-fold predictions, so that it meets them as they
will be on unseen documents. Features are the presence of informative words and beginnings of words, and
a few shape measures of the text.

Words are chosen and models fitted on a bounded sample of labelled rows (``SAMPLE``); every document is scored over its
whole text. A category's threshold is the one with the best F1 on out-of-fold predictions.

Edge cases: null and empty texts have no words and get the probabilities of an empty text; labels that are null are
left out of that category's fit; a category without both labels predicts its share and flags nothing; labels of unknown
documents are ignored, and of repeated labels the larger counts; equal texts get equal results; tables without rows
give none; columns named like a result are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, map_texts, materialise, sampled, table

#: Labelled rows used, words chosen for each category, least documents of a word, and folds.
SAMPLE, WORDS, LEAST, FOLDS = 6_000, 80, 3, 5
RIDGE, STEPS = 1e-3, 150
WORD = re.compile(r"\w+")
#: Beginnings of words that are features too, so that inflected and compound forms are met.
PREFIXES = (3, 5, 7)
#: A feature is present from one occurrence on, and present once more from so many on.
OFTEN = 3
SHAPES = 4
#: Words whose features a worker remembers.
REMEMBERED = 300_000

#: Of every byte: 0 capital, 1 other letter, digit or byte of a longer character, 2 sign, 3 white space.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 0
_KIND[[9, 10, 11, 12, 13, 32]] = 3


def parts(word: str) -> list[str]:
    """The features of a word: itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def features_of(text: str) -> list[str]:
    """All that are present; those that are so often once more, marked."""
    seen: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for p in parts(word):
            seen[p] += n
    return [*seen, *(p + "#" for p, n in seen.items() if n >= OFTEN)]


def shapes(text: str) -> list[float]:
    """Log length, and the shares of capitals, of signs and of white space."""
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=4)
    n = max(1, int(kinds.sum()))
    return [np.log1p(n) / 10, kinds[0] / max(1, kinds[0] + kinds[1]), kinds[2] / n, kinds[3] / n]


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression with a ridge, both labels weighing the same, by accelerated gradient steps."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Linear(np.zeros(x.shape[1]), float(np.log(share / (1 - share))))
    n, yes = len(y), y.sum()
    weight = np.where(y > 0, 0.5 / yes, 0.5 / (n - yes))
    z = np.column_stack([x, np.ones(n)])
    ridge = np.append(np.full(x.shape[1], RIDGE), 0)
    v = np.ones(z.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        v = z.T @ (weight * (z @ v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (0.3 * top + RIDGE)
    w = ahead = np.zeros(z.shape[1])
    for k in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        new = ahead - rate * (z.T @ (weight * (p - y)) + ridge * ahead)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return Linear(w[:-1], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1, in the middle of the gap below the last accepted probability."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # equal probabilities stay together
    k = int(f1.argmax())
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(y) else 0.0)) / 2)


@dataclass
class Chain:
    categories: list[str]
    words: dict[str, int]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def features(self, texts: list[str], known: dict[str, tuple[int, ...]]) -> np.ndarray:
        """known: places of the features of words, filled here."""
        n = len(self.words)
        x = np.zeros((len(texts), 2 * n + SHAPES))
        for i, text in enumerate(texts):
            for word, times in Counter(WORD.findall(text.lower())).items():
                at = known.get(word)
                if at is None:
                    at = known[word] = tuple(self.words[p] for p in parts(word) if p in self.words)
                for k in at:
                    x[i, k] += times
            x[i, n : 2 * n] = x[i, :n] >= OFTEN
            x[i, :n] = x[i, :n] > 0
            x[i, 2 * n :] = shapes(text)
        if len(known) > REMEMBERED:
            known.clear()
        return x

    def fit(self, x: np.ndarray, labels: list[np.ndarray], fold: np.ndarray) -> None:
        """labels: 0, 1 or NaN for each category; fold: of each row."""
        for y in labels:
            known = ~np.isnan(y)
            out = np.zeros(len(x))
            for k in range(FOLDS):
                model = fit(x[known & (fold != k)], y[known & (fold != k)])
                out[fold == k] = model.probability(x[fold == k])
            self.models.append(fit(x[known], y[known]))
            self.thresholds.append(best_threshold(out[known], y[known]))
            x = np.column_stack([x, out])

    def predict(self, texts: list[str], known: dict[str, tuple[int, ...]]) -> list[np.ndarray]:
        x, out = self.features(texts, known), []
        for model in self.models:
            out.append(model.probability(x))
            x = np.column_stack([x, out[-1]])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """``labels`` has the id and a 0/1 column for each category, in the order of the chain."""
    marks = [f"c{k}" for k in range(len(categories))]
    given = labels.select(col(id_col).alias("__id"), *(col(c).cast("double").alias(k) for c, k in zip(categories, marks, strict=True)))
    one = given.filter("__id IS NOT NULL").groupBy("__id").agg(*[F.max(k).alias(k) for k in marks])
    chosen = F.broadcast(sampled(one, "__id", SAMPLE))  # about SAMPLE rows
    rows = docs.select(col(id_col).alias("__doc"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = materialise(rows.join(chosen, F.col("__doc") == F.col("__id")).drop("__doc"), "sample")

    words = map_texts(rows, "text", lambda: lambda texts: [[features_of(x) for x in texts]], [T.StructField("words", T.ArrayType(T.StringType()))], marks)
    seen = words.select(*marks, F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in marks]).filter(F.col("n") >= LEAST)
    seen = materialise(seen, "features")
    n = one.count()
    totals = chosen.agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in marks]).first()
    picked: set[str] = set()
    if n:
        for k in marks:
            yes, all_ = totals[k] or 0.0, totals["n"]
            lift = F.log((F.col(k) + 0.5) / (yes + 1)) - F.log((F.col("n") - F.col(k) + 0.5) / (all_ - yes + 1))
            picked |= {r.word.removesuffix("#") for r in seen.orderBy(F.desc(F.abs(lift) * F.sqrt("n")), "word").limit(WORDS).collect()}
    chain = Chain(categories, {w: i for i, w in enumerate(sorted(picked))})

    fields = [T.StructField("x", T.ArrayType(T.FloatType()))]
    vectors = map_texts(rows, "text", lambda: lambda texts: [list(chain.features(texts, {}))], fields, ["__id", *marks])
    got = sorted(vectors.collect(), key=lambda r: r["__id"])  # about SAMPLE rows of some hundred numbers
    x = np.array([r.x for r in got], np.float64).reshape(len(got), 2 * len(chain.words) + SHAPES)
    fold = np.array([hash_fold(r["__id"]) for r in got], np.int64)
    chain.fit(x, [np.array([np.nan if r[k] is None else float(r[k] > 0) for r in got]) for k in marks], fold)
    return chain


def hash_fold(key: object) -> int:
    return zlib.crc32(f"fold {key}".encode()) % FOLDS


def classify(docs: DataFrame, chain: Chain, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``p_<category>`` and ``is_<category>`` for every category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few hundred words
    fields = [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories] + [T.StructField(f"is_{c}", T.BooleanType()) for c in chain.categories]

    def make():
        known: dict[str, tuple[int, ...]] = {}

        def work(texts: list[str]) -> list[list]:
            blocks = [shared.value.predict(texts[i : i + 256], known) for i in range(0, len(texts), 256)]
            p = [np.concatenate(x) for x in zip(*blocks, strict=True)]
            return [*(x.tolist() for x in p), *((x > t).tolist() for x, t in zip(p, shared.value.thresholds, strict=True))]

        return work

    return map_texts(docs, text_col, make, fields, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain: poor quality, then toxic, then toxic within poor quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    poor = F.col("quality") == 0
    categories = labels.select("doc_id", poor.cast("int").alias("poor"), F.col("toxic"), ((F.col("toxic") > 0) & poor).cast("int").alias("toxic_poor"))
    chain = train(docs, categories, ["poor", "toxic", "toxic_poor"])
    found = classify(docs.select("doc_id", "text"), chain, keep=["doc_id"])
    return found.select("doc_id", F.col("is_toxic").alias("toxic"), F.col("p_toxic").alias("score"), "p_poor", "is_poor", "p_toxic_poor", "is_toxic_poor")
