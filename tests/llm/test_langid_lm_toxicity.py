"""op3, op4 and op9: held-out accuracy, and brute force for what is exact."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from wordloom.llm import langid, lm, toxicity

MEDIUM = "/root/testdata/sf0.01"


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_language_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = langid.query(spark, MEDIUM).collect()
    assert len(rows) == len(lang) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) <= len(rows) // 200


def test_language_awkward(spark, awkward, write_tables):
    rows = langid.query(spark, write_tables(documents=awkward)).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"} and all(r.score == 0 and r.rejected for r in rows if r.doc_id in (3, 4, 5))
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 7)} == {"en"}
    model = langid.train(awkward.limit(0))
    assert {(r.lang_pred, r.rejected) for r in langid.identify(awkward, model).collect()} == {("und", True)}
    kept = langid.keep_identified(awkward)
    assert kept.columns == awkward.columns and kept.filter("doc_id in (3, 4, 5)").count() == 0


def test_language_rejects_foreign(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    foreign = spark.createDataFrame([(1, "漢字仮名交じり文を読む" * 30), (2, "12345 --- 678"), (3, "Это совсем другой язык, которого нет " * 9)], "doc_id long, text string")
    assert all(r.rejected for r in langid.identify(foreign, langid.train(docs)).collect())


def test_score_base(spark, documents):
    rows = {r.doc_id: r for r in lm.query(spark, "/root/testdata/sf0.001").collect()}
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), ""] for i, t, _ in documents}
    c = Counter(w for i, ws in words.items() if crc(i, 7) != 2 for w in ws)
    n, v = c.total(), len(c)
    assert len(rows) == len(documents)
    for i, ws in words.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)


def test_score_against_the_model_written_out(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, counts = lm.train(docs)
    c = {bytes(r.word): r.c for r in counts.collect()}
    size = len(model.transition)
    assert np.allclose((10**model.transition).sum(axis=1), 1)

    def class_of(w):
        return size - 1 if w == lm.END else int(model.classes[model.frequent[w]]) if w in model.frequent else model.first_length_class + lm._length_class(len(w))

    mass = np.zeros(size)
    for w, k in c.items():
        mass[class_of(w)] += k + (w != lm.END)
    assert np.allclose(10**model.emission[:-1], mass[:-1] + 1)  # one share for unseen words
    rows = {r.doc_id: r for r in lm.score(docs).collect()}
    for i, text, _ in documents[:60]:
        before, total = size - 1, 0.0
        for w in [*lm.words_of(text), lm.END]:
            now = class_of(w)
            total += model.transition[before, now] + (0 if w == lm.END else math.log10(c.get(w, 0) + 1) - model.emission[now])
            before = now
        assert math.isclose(rows[i].score, total, rel_tol=1e-9)


def test_score_beats_base_on_held_out(spark):
    held = [r for r in lm.query(spark, MEDIUM).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_awkward(spark, awkward, write_tables):
    rows = lm.query(spark, write_tables(documents=awkward)).collect()
    assert len(rows) == awkward.count() and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert lm.score(awkward.limit(0)).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    hidden = np.repeat(np.arange(4), 8)
    bigrams = rng.poisson(np.array([[9, 1, 0.2, 0.2], [0.2, 9, 1, 0.2], [0.2, 0.2, 9, 1], [1, 0.2, 0.2, 9]])[hidden][:, hidden]).astype(np.int64)

    def likelihood(of):
        k = of.max() + 1
        pairs = np.zeros((k, k))
        np.add.at(pairs, (of[:, None], of[None, :]), bigrams)
        return lm._x_log_x(pairs).sum() - lm._x_log_x(pairs.sum(axis=0)).sum() - lm._x_log_x(pairs.sum(axis=1)).sum()

    start = np.arange(32) % 4
    found = lm.exchange(bigrams, 32, 4, 20)
    assert likelihood(found) > likelihood(start)
    assert likelihood(found) >= likelihood(hidden) - 1e-6


def test_toxicity_held_out(spark):
    """Fit without a fifth of the labels, and flag that fifth."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 5000"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("doc_id < 5000")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    chain = toxicity.train(docs, labels.filter("doc_id % 5 <> 0").selectExpr("doc_id", "1 - quality AS poor", "toxic"), ["poor", "toxic"])
    rows = toxicity.classify(docs.filter("doc_id % 5 = 0"), chain).collect()
    known = [(truth[r.doc_id], r.is_toxic) for r in rows if r.doc_id in truth]
    assert sum(f for t, f in known if t) / sum(t for t, _ in known) > 0.8
    assert sum(f for t, f in known if not t) / sum(not t for t, _ in known) < 0.02


def test_toxicity_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 0, None), (2, 1, 1), (2, 0, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, toxic int, rude int")
    chain = toxicity.train(awkward, labels, ["rude", "toxic"])
    rows = toxicity.classify(awkward, chain).collect()
    assert len(rows) == awkward.count() and all(0 <= r.p_toxic <= 1 for r in rows)
    assert toxicity.classify(awkward.limit(0), chain).count() == 0
    named = toxicity.train(awkward.select("doc_id", "text").toDF("a.b", "text"), labels.toDF("a.b", "to.xic", "rude"), ["rude", "to.xic"], "a.b")
    assert [m.bias for m in named.models] == [m.bias for m in chain.models]
    none = toxicity.train(awkward.limit(0), labels.limit(0), ["toxic"])
    assert not any(r.is_toxic for r in toxicity.classify(awkward, none).collect())


@pytest.mark.parametrize("p, y, want", [([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0], 0.5), ([0.5, 0.5], [1, 1], 1.0)])
def test_threshold(p, y, want):
    assert toxicity.best_threshold(np.array(p), np.array(y, float)) == pytest.approx(want)


def test_score_clusters_all_words_with_contexts(spark):
    """Of 1,200 words of two kinds that take turns, all of them are in clustered classes, none with a word of the other kind."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'ab'[k % 2]}{rng.integers(600):03d}" for k in range(200)) for _ in range(400)]
    model, _ = lm.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    of = {w: int(model.classes[i]) for w, i in model.frequent.items()}
    assert len(of) == 1200 and max(of.values()) < model.first_length_class
    assert not {k for w, k in of.items() if w[:1] == b"a"} & {k for w, k in of.items() if w[:1] == b"b"}


FOREIGN = {
    "it": "Il sole era appena sorto quando la famiglia decise di lasciare la vecchia casa in collina e scendere verso il mare. Nessuno parlava molto, perché tutti sapevano che quel viaggio avrebbe cambiato ogni cosa. La strada correva tra gli ulivi e i muri a secco, e ogni tanto si vedeva un contadino che alzava la mano per salutare.",
    "fi": "Aurinko oli juuri noussut, kun perhe päätti lähteä vanhasta talosta ja kulkea kohti merta. Kukaan ei puhunut paljon, koska kaikki tiesivät matkan muuttavan elämän täysin. Tie kulki metsien ja peltojen halki, ja välillä näkyi maanviljelijä, joka nosti kätensä tervehdykseen.",
    "pl": "Słońce dopiero wzeszło, kiedy rodzina postanowiła opuścić stary dom na wzgórzu i zejść w stronę morza. Nikt nie mówił wiele, bo wszyscy wiedzieli, że ta podróż zmieni całe ich życie. Droga biegła wśród pól i kamiennych murów, a czasem było widać rolnika, który podnosił rękę na powitanie.",
    "random": " ".join("".join(np.random.default_rng(k).choice(list("abcdefghijklmnopqrstuvwxyz"), 2 + k % 8)) for k in range(700)),
}


def test_language_rejects_unseen_languages(spark):
    """In Latin script too: passages of 80 characters nearly always, longer ones always; own documents hardly ever."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = langid.train(docs)
    rows = [(n, t[a : a + n]) for t in FOREIGN.values() for n in (80, 200, 3000) for a in range(0, max(1, len(t) - n), 40)]
    found = langid.identify(spark.createDataFrame(rows, "n int, text string"), model).collect()
    assert all(r.rejected for r in found if r.n >= 200) and sum(r.rejected for r in found if r.n == 80) >= 0.9 * sum(r.n == 80 for r in found)
    assert langid.identify(docs, model).filter("rejected").count() <= 10


def test_language_written_out(spark, documents):
    """Cosines of all centroids, from counts in Python dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    sizes = {lang: model.langs.count(lang) for lang in model.langs}
    assert all(1 <= n <= langid.CLUSTERS for n in sizes.values())
    rows = {r.doc_id: r for r in langid.identify(docs, model, keep=["doc_id"]).collect()}
    for i, text, _ in documents[:40]:
        c = langid.counts(text)
        v = {k: math.log1p(int(c[k])) * float(model.idf[k]) for k in np.flatnonzero(c)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(centroid[k]) for k, x in v.items()) / norm for centroid in model.centroids]
        best = int(np.argmax(cosines))
        assert rows[i].lang_pred == model.langs[best] and math.isclose(rows[i].score, min(1.0, cosines[best]), abs_tol=1e-4)
        limit = model.least[model.langs[best]][langid.band(c)]
        assert rows[i].rejected == (cosines[best] < limit) or math.isclose(cosines[best], limit, abs_tol=1e-4)


def test_clusters_are_no_outliers():
    rng = np.random.default_rng(2)
    v = np.abs(rng.normal(size=(200, 16))) + np.repeat(np.eye(16)[:4] * 8, 50, axis=0)
    v[:3] = np.eye(16)[9:12]  # three rows that are like nothing else
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = langid.k_means(v, 4)
    sizes = np.bincount((v @ found.T).argmax(axis=1), minlength=len(found))
    assert len(found) == 4 and sizes.min() >= langid.LEAST_SHARE * len(v)


def test_frequent_words_of_a_flat_vocabulary(spark, monkeypatch):
    """Words of one count are taken as far as there is room, and have classes."""
    monkeypatch.setattr(lm, "FREQUENT", 1000)
    texts = [" ".join(f"w{k:05d}" for k in range(at, at + 50)) for at in range(0, 3000, 50)]
    model, counts = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert 900 <= len(model.frequent) <= 1000 and model.first_length_class == lm.CLASSES
    some = spark.createDataFrame([(b"a", 5), (b"b", 5), (b"c", 2), (b"d", 9)], "word binary, c long")
    assert {bytes(r.word) for r in lm.most_frequent(some, 4).collect()} == {b"a", b"b", b"c", b"d"}
    assert {bytes(r.word) for r in lm.most_frequent(some, 3).collect()} == {b"a", b"b", b"d"}
    assert {bytes(r.word) for r in lm.most_frequent(some, 2).collect()} > {b"d"} and lm.most_frequent(some, 0).count() == 0


def test_toxicity_chain_written_out(spark, documents):
    """The chain of the query, one category after the other, by sums in Python."""
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    chain = toxicity.train(docs, labels.selectExpr("doc_id", "1 - quality AS poor", "toxic"), ["poor", "toxic"])
    some = [(i, t or "") for i, t, _ in documents[:60]] + [(-1, "")]
    rows = {r.doc_id: r for r in toxicity.classify(spark.createDataFrame(some, "doc_id long, text string"), chain).collect()}
    for i, text in some:
        present = set(toxicity.features_of(text))
        x = [float(w in present) for w in chain.words] + [float(w + "#" in present) for w in chain.words] + list(toxicity.shapes(text))
        for c, model, threshold in zip(chain.categories, chain.models, chain.thresholds, strict=True):
            z = sum(a * b for a, b in zip(x, model.weights.tolist(), strict=True)) + model.bias
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            assert math.isclose(rows[i][f"p_{c}"], p, rel_tol=1e-6) and (rows[i][f"is_{c}"] == (p > threshold) or math.isclose(p, threshold, rel_tol=1e-6))
            x.append(p)
