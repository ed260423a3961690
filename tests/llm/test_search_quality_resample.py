"""Ranked search, quality trees and resampling against plain versions of them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SMALL
from wordloom.llm import quality, resample, retrieval

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def terms(text):
    return TERM.findall(lower(text))


# Search.


def ranked(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 75 + (25 * c.total() * n) // total
            score = 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in retrieval.search(d, q, **how).collect()), key=repr)


def test_search_small(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40, 200, 3000])))) for i in range(400)]
    docs += [(1000 + i, "Same Words, same ties w1 w2") for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(30)] + [(90, "ties same"), (91, "notthere"), (92, "")]
    assert searched(spark, docs, items) == ranked(docs, items)
    monkeypatch.setattr(retrieval, "BLOCK_ITEMS", 7)  # several blocks of items
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)  # candidates by a shuffle
    assert searched(spark, docs, items, k=3) == ranked(docs, items, 3)


def test_search_awkward(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [(1, "the quick FOX"), (None, "éclair 漢字 password"), (3, None), (1, "the quick FOX")]
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in retrieval.search(awkward, q).collect()), key=repr)
    assert got == ranked(docs, items) and len(got) > 10
    assert retrieval.search(awkward.limit(0), q).collect() == [] and retrieval.search(awkward, q.limit(0)).collect() == []


def test_bounds_are_above_scores_and_near_them(spark):
    """No bound is under its score, and hardly more is scored than what is found."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    index = retrieval.build_index(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    prepared = retrieval.prepare(index, items)
    bounds, tried, exact = retrieval.Bounds(prepared), 0, 0
    for g in index.groups.collect():
        bounds.load(g.n, g.top, g.width, bytes(g.slices))
        everything = np.arange(len(g.n))
        for q in range(len(items)):
            coarse, fine = bounds.coarse(q), bounds.fine(q, everything)
            for i, doc in enumerate(g.docs):
                counts = Counter(t.encode() for t in terms(text[doc]))
                score = prepared.score(q, counts, int(prepared.length_part(np.int64(counts.total()))))
                assert score <= fine[i] <= coarse[i]
                tried, exact = tried + int(fine[i]), exact + score
    assert exact <= tried <= 1.3 * exact


# Quality.


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_quality_counts(documents, monkeypatch):
    rng = random.Random(4)
    made = [t for _, t, _ in documents] + [None, "", " \n\n ", "a\x0bb\x1cc\x85d\xa0e", "x y\nx y\n\nx y", " ".join(rng.choices("ab c", k=400)), "😀 #a <b> | |"]
    for text in made:
        assert quality.statistics(text or "")[0] == plain_counts(text)
    monkeypatch.setattr(quality, "LONG", 3)
    for text in made:
        assert quality.statistics(text or "")[0] == plain_counts(text)


def trees_one_by_one(forest, row):
    total = forest.bias
    for at in forest.roots:
        while forest.feature[at] >= 0:
            at = forest.left[at] if row[forest.feature[at]] <= forest.limit[at] else forest.right[at]
        total += forest.value[at]
    return total


def test_trees():
    rng = np.random.default_rng(5)
    x = rng.random((800, 4))
    y = ((x[:, 0] < 0.5) ^ (rng.random(800) < 0.1)).astype(float) * (x[:, 2] < 0.8)
    signs = [-1, 0, 0, 1]
    forest = quality.grow(x, y, signs)
    assert np.allclose(forest.score(x), [trees_one_by_one(forest, r) for r in x])
    assert ((forest.score(x) > 0) == y).mean() > 0.85
    for f, sign in ((0, -1), (3, 1)):  # along a monotonic feature, everything else equal
        grid = np.repeat(rng.random((50, 4)), 21, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 21), 50)
        assert (sign * np.diff(forest.score(grid).reshape(50, 21), axis=1) >= -1e-12).all()
    free = quality.grow(x, y, [0] * 4)
    grid = np.repeat(rng.random((50, 4)), 21, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 21), 50)
    assert (np.diff(free.score(grid).reshape(50, 21), axis=1) > 1e-12).any()  # the constraint is what does it
    assert quality.grow(x, np.ones(800), signs).score(x).tolist() == [0.0] * 800


def test_choose():
    y = np.array([0] * 50 + [1] * 950)
    score = np.array([-2.0] * 45 + [3.0] * 5 + [-1.0] * 2 + [2.0] * 948)
    assert score[:45].max() < quality.choose(score, y) < 2
    assert quality.choose(score, np.ones(1000)) == -math.inf
    assert quality.choose(np.zeros(1000), y) == -math.inf  # nothing tells them apart


def test_quality_held_out(spark):
    """Fitted on four fifths of the labels of sf0.01, judged on the rest."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    forest = quality.train(docs, labels.filter("doc_id % 5 <> 0"))
    found = quality.judge(docs, forest).join(labels.filter("doc_id % 5 = 0"), "doc_id").collect()
    poor, good = [r for r in found if r.quality == 0], [r for r in found if r.quality == 1 and not r.base_failed]
    assert len(poor) >= 8 and sum(not r.kept for r in poor) >= 0.9 * len(poor)
    assert len(good) >= 50 and sum(r.kept for r in good) >= 0.97 * len(good)


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (None, 0), (99, 1), (6, None)], "doc_id long, quality int")
    got = quality.judge(awkward, quality.train(awkward, labels))
    rows = got.collect()
    assert got.columns == [*awkward.columns, *quality.COUNTS, "base_failed", "quality_score", "kept"] and len(rows) == awkward.count()
    for r in rows:
        assert [r[c] for c in quality.COUNTS] == plain_counts(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    nothing = quality.train(awkward, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality.judge(awkward, nothing).collect())
    assert quality.judge(awkward.limit(0), nothing).collect() == []


# Resampling.


def features(text, n):
    words = terms(text)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def drawn(docs, target, n, buckets, least, percent, seed):
    def hist(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, n))

    s, t = hist(t for _, t in docs), hist(target)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for doc, text in docs:
        own = features(text, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(terms(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resample(spark, documents, n):
    docs = [(i, t) for i, t, _ in documents] + [(5000, None), (5001, ""), (5002, "one\n\ntwo  three\nfour"), (5003, "\n")]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    how = {"n": n, "buckets": 500 * n, "least": 30, "percent": 25, "seed": 7}
    got = resample.importance(d, q, **how).drop("mark").collect()
    assert sorted((tuple(r) for r in got), key=repr) == drawn(docs, target, n, 500 * n, 30, 25, 7)


def test_resample_awkward(spark, awkward):
    target = spark.createDataFrame([("the quick fox",), (None,), ("token abcdef",)], "text string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    how = {"least": 2, "percent": 50}
    got = resample.importance(awkward, target, **how).drop("mark").collect()
    assert sorted((tuple(r) for r in got), key=repr) == drawn(docs, [r.text for r in target.collect()], 1, 10_000, 2, 50, 2024)
    out = resample.resample(awkward, target, **how)
    assert out.columns == awkward.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in got if r["rank"]}
    assert resample.importance(awkward.limit(0), target).collect() == []
    assert all(r["rank"] is None for r in resample.importance(awkward, target.limit(0)).collect())
