"""Quality rules: gradient-boosted trees over document statistics.

Statistics of a whole text (counts of words, signs, repeated lines and windows, shares of kinds of characters) go into
trees that are grown one after another on the gradients of the logistic loss, over bins of each feature. Chosen features
are monotonic (``MONOTONIC``): more of them never raises a document's score. A split that would break this isn't taken,
and the values below a split are bounded by the mean of its sides, so that the whole tree keeps to it. The trees are then
flattened into arrays of nodes (feature, limit, left, right, value), and whole batches go down all trees level by level.

The trees are fitted on a bounded sample of labelled rows (``SAMPLE``). A document is kept if its score reaches a limit
below which no more than ``LOST`` of the good rows fall, by predictions of trees that haven't seen them, and which gives
the best F1 for poor rows beyond that. Texts under ``LEAST_WORDS`` words, and those of whose words more than ``MOST_REPEATED``
in a hundred are in repeated windows, fail before that.

Edge cases: null and empty texts have no words and fail; labels that are null, or of unknown documents, are left out, and
of repeated labels the larger counts; without both labels all that doesn't fail before is kept; equal texts get equal
results; texts of any length are read whole; tables without rows give none; columns named like a result are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, map_texts, sampled, table
from wordloom.llm.toxicity import hash_fold

#: Words of a window, and the two limits of the base.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = "#*$%&|<>"
#: Words beyond which windows are numbered in arrays, not held as tuples.
LONG = 50_000
#: Labelled rows used, folds, share of good rows that may fall below the limit.
SAMPLE, FOLDS, LOST = 6_000, 5, 0.004
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 80, 3, 0.15, 48, 8, 1.0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeated", "capitals", "digits", "signs", "distinct", "commonest", "signs_only", "line_words"]
#: -1: more of it never raises the score.
MONOTONIC = {"symbols": -1, "dup_lines": -1, "repeated": -1, "signs_only": -1, "commonest": -1}

_KIND = np.full(256, 2, np.uint8)  # of every byte: 0 capital, 1 other letter, 2 sign, 3 white space, 4 digit
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91], _KIND[48:58] = 0, 4
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_SPACES = " \t\n\v\f\r"
_SIGNS = bytes(np.flatnonzero(_KIND == 2).tolist())


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) <= LONG:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) == n:
            return 0
        times = Counter(windows)
        again = np.fromiter((times[w] > 1 for w in windows), bool, n)
    else:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        codes = ids[:n]
        for k in range(1, WINDOW):  # windows of k + 1 words, numbered
            codes = np.unique(codes * len(known) + ids[k : k + n], return_inverse=True)[1]
        again = np.bincount(codes)[codes] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def statistics(text: str) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    again = repeated_words(words)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=5)
    letters, full = max(1, int(kinds[0] + kinds[1])), max(1, int(kinds.sum() - kinds[3]))
    times = Counter(words)
    plain = n - len(data.translate(None, _SIGNS).split())  # words of signs only
    some = max(1, n)
    features = [
        math.log1p(n),
        chars / some,
        symbols / some,
        dup / max(1, len(lines)),
        again / some,
        kinds[0] / letters,
        kinds[4] / full,
        kinds[2] / full,
        len(times) / some,
        max(times.values(), default=0) / some,
        plain / some,
        n / max(1, len(lines)) / 100,
    ]
    return [n, chars, symbols, dup, again], features


@dataclass
class Forest:
    """Flat trees: for each node its feature (-1: a leaf), limit, left and right node, and value; ``roots`` of all trees."""

    bias: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    threshold: float = -math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being good, of all rows."""
        if not self.roots:
            return np.full(len(x), self.bias)
        at = np.tile(np.array(self.roots, np.int32), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.limit[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return self.bias + self.value[at].sum(axis=1)


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Limits between the bins of each feature."""
    out = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES) -> Forest:
    """Boosted trees for labels 0 and 1, both weighing the same. signs: -1, 0 or 1 for each feature."""
    if len(y) == 0 or y.min() == y.max():
        return Forest()
    edges = _edges(x)
    bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    score = np.zeros(len(y))
    feature, limit, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        for a, b in ((feature, -1), (limit, 0.0), (left, 0), (right, 0), (value, v)):
            a.append(b)
        return len(feature) - 1

    def best(gain: float, g: np.ndarray, h: np.ndarray, rows: np.ndarray, low: float, high: float) -> tuple | None:
        found = None
        worth = lambda gs, hs: np.clip(-gs / (hs + RIDGE), low, high)
        won = lambda gs, hs, v: -(gs * v + 0.5 * (hs + RIDGE) * v * v)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            own = bins[rows, f]
            sums = [np.cumsum(np.bincount(own, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None)]
            gl, hl, nl = sums
            gr, hr, nr = g[rows].sum() - gl, h[rows].sum() - hl, len(rows) - nl
            vl, vr = worth(gl, hl), worth(gr, hr)
            total = won(gl, hl, vl) + won(gr, hr, vr)
            total[(nl < LEAST_ROWS) | (nr < LEAST_ROWS) | (signs[f] * (vr - vl) < 0)] = -np.inf
            k = int(total.argmax())
            if total[k] > gain + 1e-9:
                gain, found = total[k], (f, k, float(vl[k]), float(vr[k]))
        return found

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        v = float(np.clip(-g[rows].sum() / (h[rows].sum() + RIDGE), low, high))
        gain = -(g[rows].sum() * v + 0.5 * (h[rows].sum() + RIDGE) * v * v)
        split = best(gain, g, h, rows, low, high) if depth < DEPTH else None
        if split is None:
            score[rows] += RATE * v
            return leaf(RATE * v)
        f, k, vl, vr = split
        at, middle = leaf(0.0), (vl + vr) / 2
        feature[at], limit[at] = f, float(edges[f][k])
        below = bins[rows, f] <= k
        ranges = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[signs[f]]
        left[at] = node(rows[below], g, h, depth + 1, *ranges[0])
        right[at] = node(rows[~below], g, h, depth + 1, *ranges[1])
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(node(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), 0, -np.inf, np.inf))
    return Forest(0.0, roots, np.array(feature, np.int32), np.array(limit), np.array(left, np.int32), np.array(right, np.int32), np.array(value))


def choose(score: np.ndarray, y: np.ndarray) -> float:
    """The limit of the best F1 for poor rows among those under which LOST of the good rows fall at most."""
    if len(y) == 0 or y.min() == y.max():
        return -math.inf
    order = np.argsort(score, kind="stable")
    s, poor = score[order], (y[order] == 0)
    caught, lost = np.cumsum(poor), np.cumsum(~poor)
    f1 = 2 * caught / (np.arange(1, len(s) + 1) + poor.sum())
    f1[(lost > LOST * (~poor).sum()) | np.append(s[:-1] == s[1:], False)] = -1  # equal scores stay together
    k = int(f1.argmax())
    if f1[k] <= 0:
        return -math.inf
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fitted on ``labels``: the id and 1 for good documents, 0 for poor ones."""
    known = labels.select(col(id_col).alias("__id"), col(label_col).alias("__label")).filter("__id IS NOT NULL AND __label IS NOT NULL")
    known = sampled(known.groupBy("__id").agg(F.max("__label").alias("__label")), "__id", SAMPLE)
    rows = docs.select(col(id_col).alias("__doc"), F.coalesce(col(text_col), F.lit("")).alias("__text"))
    rows = rows.join(F.broadcast(known), F.col("__doc") == F.col("__id"))  # about SAMPLE rows
    made = map_texts(rows, "__text", lambda: lambda texts: [[statistics(x)[1] for x in texts]], [T.StructField("x", T.ArrayType(T.DoubleType()))], ["__id", "__label"])
    got = sorted(made.collect(), key=lambda r: (r["__id"], r.x))  # about SAMPLE rows of a dozen numbers
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    y = np.array([float(r["__label"] > 0) for r in got])
    fold = np.array([hash_fold(r["__id"]) for r in got], np.int64)
    signs = [MONOTONIC.get(f, 0) for f in FEATURES]
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        unseen[fold == k] = grow(x[fold != k], y[fold != k], signs).score(x[fold == k])
    forest = grow(x, y, signs)
    forest.threshold = choose(unseen, y)
    return forest


def judge(docs: DataFrame, forest: Forest, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with COUNTS, ``base_failed``, ``quality_score`` (log odds) and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # some hundred nodes
    fields = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def make():
        def work(texts: list[str]) -> list[list]:
            made = [statistics(x) for x in texts]
            counts = np.array([c for c, _ in made], np.int64).reshape(-1, len(COUNTS))
            score = shared.value.score(np.array([f for _, f in made]).reshape(-1, len(FEATURES)))
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            return [*counts.T.tolist(), failed.tolist(), score.tolist(), (~failed & (score >= shared.value.threshold)).tolist()]

        return work

    return map_texts(docs, text_col, make, fields, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
