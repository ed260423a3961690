"""Scores by a Brown class-based bigram model.

``P(text) = product of P(class | previous class) * P(word | class)`` over its words and one end. Exchange clustering
assigns the most frequent words to classes so that the likelihood of class bigrams is largest. From there, all frequent
words with ``LEAST`` occurrences or more are assigned by rounds: in each, a word goes to the class in which its
neighbours' classes are likeliest, by sums over all documents; a round that lowers the likelihood ends them. Only rarer
words, and words that are not broadcast, belong to the class of their length. Transitions are add-half smoothed; emissions are add-one smoothed within the class, with
one more share for unseen words. The base score is the add-one unigram model's.

All counts cover all training documents: a table of every word's count, the documents as numbers of words, and from
these the bigrams of the first words and of the classes. The most frequent words (``FREQUENT`` at most) are broadcast and scored where
the text is; the others meet their counts in a join on the word, so no vocabulary has to fit in memory.

Edge cases: null and empty texts are the end alone; words unknown to training count 0; rows without an id are neither
trained on nor held out; equal rows are scored one by one; without training documents all counts are 0; tables without
rows give none; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import col, materialise, pieces, small_batches, table, worker_memory
from wordloom.llm.langid import remainder

#: Words that are clustered first, their classes, and rounds of the exchange.
CLUSTERED, CLASSES, ROUNDS = 512, 32, 8
#: Occurrences from which any other frequent word is assigned to these classes, and rounds of that.
LEAST, ASSIGNED = 3, 4
#: Words that are broadcast with their counts: about 20 bytes each.
FREQUENT = 1 << 17
#: Shares into which the words of one count are dealt by hash, to take as many of them as there is room for.
SLOTS = 1024
#: Least lengths in bytes of the classes of all other words.
LENGTHS = (1, 2, 3, 4, 6, 8, 11, 16)
#: Words counted in a task before it hands on its counts.
HELD = 1 << 19
END = b""


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


_BY_LENGTH = np.array([_length_class(max(1, n)) for n in range(LENGTHS[-1] + 1)], np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c): counts of all words and of the end (empty) in ``docs(text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("")
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "c": pa.array(held.values(), pa.int64())})

        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                for text in batch.column(0).to_pylist():
                    held.update(words_of(text))
                held[END] += batch.num_rows
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return small_batches(docs).select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words of ``counts(word, c)``, ``most`` at most and about as many: whole steps of the logarithm of
    the count, then of the step that is left over the larger counts, and of one count a share of the words, by hash."""
    step, slot = F.floor(F.log2("c") * 16).cast("int"), F.pmod(F.xxhash64("word"), F.lit(SLOTS))
    room, low = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        if r["count"] > room:
            low = r.step
            break
        room -= r["count"]
    if low is None:
        return counts
    last, upto = 1 << 62, 0
    for r in sorted(counts.filter(step == low).groupBy("c", slot.alias("slot")).count().collect(), key=lambda r: (-r.c, r.slot)):
        if r["count"] > room:
            break
        room, last, upto = room - r["count"], r.c, r.slot + 1
    return counts.filter((step > low) | (F.col("c") > last) | ((F.col("c") == last) & (slot < upto)))


def number_words(docs: DataFrame, top: list[bytes]) -> DataFrame:
    """(ids binary): each text of ``docs(text)`` as 32-bit numbers: places in ``top``, then length classes, then the end."""
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("")
        unit = {w: i for i, w in enumerate(shared.value)}
        get, base = unit.get, len(unit)
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                out = []
                for text in batch.column(0).to_pylist():
                    ids = np.array([get(w, -len(w)) for w in words_of(text)] + [base + len(LENGTHS)], np.int64)
                    low = ids < 0
                    ids[low] = base + _BY_LENGTH[np.minimum(-ids[low], LENGTHS[-1])]
                    out.append(ids.astype("<i4").tobytes())
                yield pa.RecordBatch.from_pydict({"ids": pa.array(out, pa.binary())})

    return small_batches(docs).select("text").mapInArrow(run, "ids binary")


def _streams(batches: Iterable[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """Runs of numbered words of whole texts, with the end before, between and after them."""
    for whole in batches:
        for batch in pieces(whole, 4 << 20):
            yield np.frombuffer(np.int32(end).tobytes() + b"".join(batch.column(0).to_pylist()), "<i4")


def count_bigrams(numbered: DataFrame, of: np.ndarray) -> np.ndarray:
    """Counts of neighbouring units; ``of`` has the unit of every number, the end's is the last."""
    n = int(of[-1]) + 1
    shared = numbered.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for ids in _streams(batches, len(shared.value) - 1):
            units = shared.value[ids]
            total += np.bincount(units[:-1] * n + units[1:], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int32()), "c": pa.array(total[at], pa.int64())})

    rows = small_batches(numbered).mapInArrow(run, "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(n * n, np.int64)
    out[rows["pair"].to_numpy(np.int64)] = rows["c"].to_numpy(np.int64)
    return out.reshape(n, n)


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, clustered: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of every unit. The first ``clustered`` units move, one at a time, to the class that gives class bigrams
    the largest likelihood; the others have classes of their own."""
    n = len(bigrams)
    k = min(classes, clustered)
    of = np.array([i % k for i in range(clustered)] + [k + i for i in range(n - clustered)], np.int64)
    total = k + n - clustered
    counts = np.zeros((total, total))
    np.add.at(counts, (of[:, None], of[None, :]), bigrams)
    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            after = np.bincount(of, weights=bigrams[w], minlength=total)
            before = np.bincount(of, weights=bigrams[:, w], minlength=total)
            own, old = float(bigrams[w, w]), of[w]
            after[old] -= own
            before[old] -= own
            counts[old, :] -= after
            counts[:, old] -= before
            counts[old, old] -= own
            rows, columns = counts[:k].sum(axis=1), counts[:, :k].sum(axis=0)
            gain = (_x_log_x(counts[:k] + after) - _x_log_x(counts[:k])).sum(axis=1) + (_x_log_x(counts[:, :k].T + before) - _x_log_x(counts[:, :k].T)).sum(axis=1)
            corner = np.arange(k)  # the class's own cell gets both
            here = counts[corner, corner]
            gain += _x_log_x(here + after[:k] + before[:k] + own) - _x_log_x(here + after[:k]) - _x_log_x(here + before[:k]) + _x_log_x(here)
            gain -= _x_log_x(rows + after.sum() + own) - _x_log_x(rows) + _x_log_x(columns + before.sum() + own) - _x_log_x(columns)
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else int(old)
            counts[new, :] += after
            counts[:, new] += before
            counts[new, new] += own
            moved += new != old
            of[w] = new
        if not moved:
            break
    return of


def likelihood(pairs: np.ndarray) -> float:
    """Of the class bigrams and of the words in their classes, without what no assignment changes."""
    return float(_x_log_x(pairs).sum() - _x_log_x(pairs.sum(axis=0)).sum() - _x_log_x(pairs.sum(axis=1)).sum())


def best_classes(numbered: DataFrame, of: np.ndarray, pairs: np.ndarray, classes: int, words: int) -> np.ndarray:
    """For the first ``words`` numbers, the one of the first ``classes`` in which their neighbours are likeliest.

    Every task sums the logs that its occurrences of a word give each class; the sums meet in one row for each word."""
    smooth = pairs + 0.5
    follows = np.log(smooth[:classes]) - np.log(smooth.sum(axis=1))[:classes, None]
    before = np.log(smooth[:, :classes]) - np.log(smooth.sum(axis=0))[None, :classes]
    shared = numbered.sparkSession.sparkContext.broadcast((of, follows.T.astype(np.float32), before.astype(np.float32)))
    names, size = [f"s{k}" for k in range(classes)], len(pairs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, after_logs, before_logs = shared.value
        after, ahead = np.zeros(words * size, np.int32), np.zeros(words * size, np.int32)
        for ids in _streams(batches, len(unit) - 1):
            units = unit[ids]
            for held, mine, other in ((after, ids[:-1], units[1:]), (ahead, ids[1:], units[:-1])):
                some = mine < words
                at, c = np.unique(mine[some] * np.int64(size) + other[some], return_counts=True)
                held[at] += c.astype(np.int32)
        after, ahead = after.reshape(words, size), ahead.reshape(words, size)
        for first in range(0, words, 8192):
            x, y = after[first : first + 8192], ahead[first : first + 8192]
            seen = np.flatnonzero(x.any(axis=1))
            sums = x[seen].astype(np.float64) @ after_logs + y[seen].astype(np.float64) @ before_logs
            yield pa.RecordBatch.from_arrays([pa.array(seen + first, pa.int32()), *(pa.array(sums[:, k]) for k in range(classes))], names=["word", *names])

    sums = small_batches(numbered).mapInArrow(run, "word int, " + ", ".join(f"{x} double" for x in names)).groupBy("word").agg(*(F.sum(x).alias(x) for x in names))
    best = F.array_max(F.array(*(F.struct(F.round(x, 6).alias("s"), F.lit(-k).alias("k")) for k, x in enumerate(names))))
    rows = sums.select("word", (-best["k"]).alias("k")).toPandas()
    out = of[:words].copy()
    out[rows["word"].to_numpy()] = rows["k"].to_numpy()
    return out


@dataclass
class Model:
    """What is broadcast: its size is bounded by CLUSTERED, CLASSES and FREQUENT."""

    frequent: dict[bytes, int]  # place of a word in the two arrays below
    logs: np.ndarray  # log10(count + 1)
    classes: np.ndarray
    transition: np.ndarray  # log10 P(class | previous class)
    emission: np.ndarray  # log10 of what a class's emissions are divided by
    first_length_class: int
    total: int
    distinct: int


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table (word, c) of documents whose id's CRC-32 modulo 7 is not 2."""
    known = docs.filter(remainder(id_col, 7) != 2).select(F.coalesce(col(text_col), F.lit("")).alias("text"))
    counts = materialise(count_words(known), "words")
    real = counts.filter(F.octet_length("word") > 0)
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    ends = n - (real.agg(F.sum("c")).first()[0] or 0)

    top = sorted(((-r.c, bytes(r.word)) for r in most_frequent(real, FREQUENT).collect()))
    words, tail = [w for _, w in top], np.arange(len(LENGTHS) + 1)
    by_length = np.array([_length_class(len(w)) for w in words], np.int64)

    numbered = materialise(number_words(known, words), "numbered")
    held = min(CLUSTERED, len(words))
    first_units = exchange(count_bigrams(numbered, np.concatenate([np.arange(held), held + by_length[held:], held + tail])), held)
    first = int(first_units.max()) - len(LENGTHS)
    size = first + len(LENGTHS) + 1
    of = np.concatenate([first_units[:held], first + by_length[held:], first + tail])
    pairs = count_bigrams(numbered, of)
    often = sum(-c >= LEAST for c, _ in top)
    for _ in range(ASSIGNED if often > held else 0):
        tried = np.concatenate([best_classes(numbered, of, pairs, first, often), of[often:]])
        found = count_bigrams(numbered, tried)
        if likelihood(found) <= likelihood(pairs):
            break
        of, pairs = tried, found
    transition = np.log10((pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * size))

    own_length = sum((F.octet_length("word") >= x).cast("int") for x in LENGTHS) - 1
    mass, kinds = np.zeros(size), np.zeros(size)
    for r in real.groupBy(own_length.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        mass[first + r.k], kinds[first + r.k] = r.n, r.v
    classes = of[: len(top)]
    for (c, _), k, own in zip(top, classes, by_length, strict=True):
        mass[k] -= c
        kinds[k] += 1
        mass[first + own] += c
        kinds[first + own] -= 1
    mass[size - 1], kinds[size - 1] = ends, 0

    logs = np.log10(1.0 - np.array([c for c, _ in top], np.float64)) if top else np.zeros(0)
    emission = np.log10(mass + kinds + 1)
    return Model({w: i for i, w in enumerate(words)}, logs, classes, transition, emission, first, n, v), counts.select("word", "c")


def _local_scores(docs: DataFrame, id_col: str, text_col: str, model: Model, ends: int) -> DataFrame:
    """Per document what its frequent words and all transitions give, and its other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    doc_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_memory("")
        m = shared.value
        get, end_class, row = m.frequent.get, len(m.transition) - 1, TaskContext.get().partitionId() << 33
        end_log = float(np.log10(ends + 1))
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                out: list[tuple] = []
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    ids = np.array([get(w, -len(w)) for w in words], np.int64)
                    low = ids < 0
                    classes = np.full(len(ids) + 2, end_class)
                    inner = classes[1:-1]
                    inner[low] = m.first_length_class + _BY_LENGTH[np.minimum(-ids[low], LENGTHS[-1])]
                    inner[~low] = m.classes[ids[~low]]
                    frequent = float(m.logs[ids[~low]].sum())
                    score = float(m.transition[classes[:-1], classes[1:]].sum() - m.emission[inner].sum() + frequent)
                    rare = Counter(words[i] for i in np.flatnonzero(low))
                    out.append((row, len(words) + 1, int((~low).sum()) + (ends > 0), frequent + end_log, score, [{"word": w, "tf": c} for w, c in rare.items()]))
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare_type]
                made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "row", "n_tokens", "n_known", "logs", "score", "rare"])

    return small_batches(source).mapInArrow(run, f"doc_id {doc_type}, row long, n_tokens long, n_known long, logs double, score double, rare array<struct<word:binary,tf:int>>")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    model, counts = train(docs, id_col, text_col)
    ends = counts.filter(F.octet_length("word") == 0).select("c").first()
    local = materialise(_local_scores(docs, id_col, text_col, model, ends.c if ends else 0), "local")
    rare = local.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.tf").join(counts, "word")
    met = rare.groupBy("row").agg(F.sum("tf").alias("met"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("met_logs"))
    both = local.drop("rare").join(met, "row", "left").na.fill(0, ["met", "met_logs"])
    base = F.col("logs") + F.col("met_logs") - F.col("n_tokens") * F.log10(F.lit(float(model.total + model.distinct + 1)))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("met")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.col("met_logs")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("score") + F.col("met_logs")) / F.col("n_tokens")).alias("perplexity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
