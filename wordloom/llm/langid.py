"""Language identification by nearest centroids.

Texts become TF-IDF vectors of hashed character n-grams (one to three, within and across words), normalised to length
one. Document frequencies come from all training documents; the centroids of each language from spherical k-means over
a bounded sample of its distinct texts, fitted where the language's rows are. The language of the centroid with the
largest cosine wins. Short texts are further from any centroid, so what is too far depends on the length: passages of
all lengths, cut from sampled texts that no centroid was fitted on, give the cosine that a share of ``REFUSED`` of each
language's own passages does not reach, or ``ENOUGH`` of their median if that is less. A document below it, or without a
letter, is rejected.

Edge cases: null texts and texts without letters are ``und`` with score 0 and rejected; without training documents all
are; rows with a null id are never trained on and not held out; equal texts get equal results; languages of fewer than
``FEW`` sampled texts are fitted and measured on all of them, and those without passages reject nothing by distance;
very long texts are read in steps; tables without rows give none; columns named like a result are replaced by
``identify``, and kept by ``keep_identified`` whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, flagged, map_texts, materialise, numbered, pieces, small_batches, table, worker_memory

BUCKETS = 8192
#: Centroids of a language, least share of its texts that one has, rounds of k-means, and tries to fill a smaller one.
CLUSTERS, LEAST_SHARE, ROUNDS, TRIES = 4, 0.05, 12, 4
#: Distinct training texts of each language that are sampled, about: half for the centroids, half for their limits.
SAMPLE, FEW = 512, 64
#: Share of a language's own passages of a length that may be rejected, share of their median cosine beyond which none is,
#: and lengths of passages in characters.
REFUSED, ENOUGH, PASSAGES = 0.01, 0.5, [12 << k for k in range(11)]
UNKNOWN = "und"
#: Texts that are compared with the centroids at once.
TOGETHER = 64
_STEP = 1 << 20
_SALTS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None if it has no letter."""
    out, some, is_letter = np.zeros(BUCKETS, np.int64), False, _letters()
    for at in range(0, max(1, len(text)), _STEP):
        codes = np.frombuffer(text[at : at + _STEP].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = is_letter[codes]
        if not letter.any():
            continue
        some = True
        codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint32)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        one = codes * _SALTS[0]
        two = one[:-1] * _SALTS[1] + codes[1:] * _SALTS[2] + np.uint32(1)
        three = two[:-1] * _SALTS[0] + codes[2:] * _SALTS[1] + np.uint32(2)
        for grams in (one[codes != 32], two, three):
            grams ^= grams >> np.uint32(15)
            out += np.bincount((grams * _SALTS[1]) >> np.uint32(19), minlength=BUCKETS)
    return out if some else None


def band(counted: np.ndarray) -> int:
    """The power of two of the length that n-gram counts tell: about three of a character."""
    return max(1, int(counted.sum()) // 3).bit_length() - 1


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    least: dict[str, np.ndarray]  # by band, the cosine below which a document is rejected

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        v = np.log1p(np.stack(rows)).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.langs:
            return out
        for at in range(0, len(texts), TOGETHER):
            rows = [(i, c) for i in range(at, min(at + TOGETHER, len(texts))) if (c := counts(texts[i])) is not None]
            if rows:
                cosines = self.vectors([c for _, c in rows]) @ self.centroids.T
                for (i, c), near, row in zip(rows, cosines.argmax(axis=1), cosines, strict=True):
                    least = self.least[self.langs[near]]
                    out[i] = (self.langs[near], float(min(1.0, max(0.0, row[near]))), bool(row[near] < least[min(band(c), len(least) - 1)]))
        return out


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of every bucket, and the number of documents with letters: one row per bucket and task, summed by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("")
        df = np.zeros(BUCKETS + 1, np.int64)
        for whole in batches:
            for batch in pieces(whole):
                for text in batch.column(0).to_pylist():
                    if (c := counts(text)) is not None:
                        df[:-1] += c > 0
                        df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(df[at], pa.int64())})

    rows = small_batches(docs).select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out[:-1], int(out[-1])


def _sample(docs: DataFrame) -> DataFrame:
    """(lang, h, text, few): about SAMPLE distinct texts of each language, chosen by their hash, so that copies count once."""
    hashed = docs.select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select("lang", (F.least(F.lit(1.0), SAMPLE / F.col("n")) * (1 << 30)).cast("long").alias("cut"))
    chosen = hashed.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) <= F.col("cut"))  # one row a language
    texts = materialise(chosen.groupBy("lang", "h").agg(F.min("text").alias("text")), "sample")
    few = texts.groupBy("lang").agg((F.count("*") < FEW).alias("few"))
    return texts.join(F.broadcast(few), "lang")


def _seeds(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: rows drawn one after another, the more likely the further they are from those drawn."""
    picked = [int(rng.integers(len(v)))]
    while len(picked) < k:
        far = np.maximum(1 - (v @ v[picked].T).max(axis=1), 0)
        if far.sum() < 1e-6:
            break
        picked.append(int(rng.choice(len(v), p=far / far.sum())))
    return v[picked]


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def k_means(v: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """Spherical k-means of unit rows. A cluster under LEAST_SHARE of the rows starts again from a row of the largest one,
    and goes if it stays so small."""
    rng = np.random.default_rng(0)
    c = _seeds(v, min(k, len(v)), rng)
    for tries in range(TRIES + 1):
        for _ in range(ROUNDS):
            near = (v @ c.T).argmax(axis=1)
            c = _unit(np.stack([v[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
        sizes = np.bincount((v @ c.T).argmax(axis=1), minlength=len(c))
        small = sizes < max(1, LEAST_SHARE * len(v))
        if not small.any():
            break
        if tries == TRIES:
            c = c[~small] if not small.all() else _unit(v.mean(axis=0, keepdims=True))
            break
        largest = np.flatnonzero((v @ c.T).argmax(axis=1) == sizes.argmax())
        c[small] = v[rng.choice(largest, int(small.sum()))]
    return c


def _centroids(sample: DataFrame, model: Model) -> list[tuple[str, np.ndarray]]:
    """The centroids of each language, from one bounded group of rows each."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        made = [c for x in rows.sort_values("h")["text"] if (c := counts(x)) is not None]
        found = k_means(model.vectors(made)) if made else np.zeros((0, BUCKETS), np.float32)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]] * len(found), "k": range(len(found)), "centroid": [x.astype("<f4").tobytes() for x in found]})

    some = sample.filter((F.pmod("h", F.lit(2)) == 0) | F.col("few")).select("lang", "h", "text")
    rows = some.groupBy("lang").applyInPandas(fit, "lang string, k int, centroid binary").collect()
    return [(r.lang, np.frombuffer(r.centroid, "<f4")) for r in sorted(rows, key=lambda r: (r.lang, r.k))]


def passages(text: str) -> list[str]:
    """The whole text, and of each length that it has two passages, from places that its hash gives."""
    out, seed = [text], zlib.crc32(text.encode("utf-8", "surrogatepass"))
    for n in PASSAGES:
        for k in range(2 if len(text) > n else 0):
            at = zlib.crc32(b"%d %d %d" % (seed, n, k)) % (len(text) - n)
            out.append(text[at : at + n])
    return out


def _limits(sample: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """By language and band, what a share of REFUSED of its passages does not reach, ENOUGH of their median at most; no less
    than for shorter ones."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def make():
        def one(text: str) -> list[dict]:
            made = [c for x in passages(text) if (c := counts(x)) is not None]
            if not made:
                return []
            cosines = shared.value.vectors(made) @ shared.value.centroids.T
            return [{"band": band(c), "cosines": row.tolist()} for c, row in zip(made, cosines, strict=True)]

        return lambda texts: [[one(x) for x in texts]]

    kind = T.ArrayType(T.StructType([T.StructField("band", T.IntegerType()), T.StructField("cosines", T.ArrayType(T.DoubleType()))]))
    some = sample.filter((F.pmod("h", F.lit(2)) == 1) | F.col("few"))
    rows = map_texts(some, "text", make, [T.StructField("p", kind)], ["lang"]).select("lang", F.explode("p").alias("p"))
    own = F.array(*map(F.lit, model.langs))
    nearest = F.array_max(F.transform(F.filter(F.arrays_zip(own.alias("lang"), F.col("p.cosines").alias("c")), lambda x: x["lang"] == F.col("lang")), lambda x: x["c"]))
    low = rows.select("lang", "p.band", nearest.alias("c")).groupBy("lang", "band").agg(F.least(F.percentile("c", F.lit(REFUSED)), ENOUGH * F.percentile("c", F.lit(0.5))).alias("c")).collect()
    out = {lang: np.zeros(32) for lang in model.langs}
    for r in low:
        out[r.lang][r.band] = r.c
    return {lang: np.maximum.accumulate(x) for lang, x in out.items()}


def remainder(id_col: str, modulus: int) -> Column:
    return F.crc32(col(id_col).cast("string").cast("binary")) % modulus


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the documents whose id's CRC-32 modulo 4 is not 2 and whose language is known."""
    known = docs.filter((remainder(id_col, 4) != 2) & col(lang_col).isNotNull() & col(text_col).isNotNull())
    known = known.select(col(text_col).alias("text"), col(lang_col).alias("lang"))
    df, n = _document_frequencies(known)
    model = Model((np.log((n + 1) / (df + 1)) + 1).astype(np.float32), np.zeros((0, BUCKETS), np.float32), [], {})
    sample = _sample(known)
    if found := _centroids(sample, model):
        model.langs, model.centroids = [lang for lang, _ in found], np.stack([c for _, c in found])
        model.least = _limits(sample, model)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CLUSTERS vectors a language
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return map_texts(docs, text_col, lambda: lambda texts: [list(x) for x in zip(*shared.value.predict(texts), strict=True)], fields, keep)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are not rejected, all their columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))
    rows, place, back = numbered(docs)
    known = flagged(F.col(place(text_col)), lambda: lambda texts: [not rejected for _, _, rejected in shared.value.predict(texts)])
    return back(small_batches(rows).filter(known))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
