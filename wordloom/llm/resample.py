"""Importance resampling towards a target distribution, over hashed n-grams and distinct lines.

Features are runs of 1 to ``n`` consecutive words, hashed into buckets. A bucket's gain compares its share in the target
texts with that in the documents; a document's weight is the sum of its features' gains, and a document is drawn by its
weight and a random number of its own (Gumbel's top-k: a draw without replacement).

Most lines of a corpus occur more than once or are met again in the second pass. So newlines, which no word holds, cut
texts into lines; distinct lines are counted in one grouping, their features are worked out once and stored, and taken
times their occurrences. Features that cross a newline are of no line: for n beyond 1 they are added document by document.
Documents come back to the weights of their lines by the lines' hashes (128 bits of SHA-256), a join whose hot lines
adaptive execution splits.

Edge cases: null and empty texts have no words, the weight 0, and aren't drawn unless no words are asked for; documents
that have the same id have the same random number; rows that repeat an id are documents of their own; null ids have the
number of an empty id; texts of any length are read whole; an empty target or empty tables give gains of nothing but
counts of 1; other columns are ignored by ``importance`` and kept by ``resample``, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, map_texts, materialise, numbered, small_batches, table
from wordloom.llm.decontaminate import words_of

#: Words of a feature at most, buckets (65,536 at most), least words of a document that is drawn, documents drawn of 100, seed.
NGRAMS, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024


def _bucketed(features: list[bytes], buckets: int) -> bytes:
    return np.fromiter((zlib.crc32(f) % buckets for f in features), np.uint16, len(features)).tobytes()


def line_features(words: list[bytes], n: int) -> list[bytes]:
    """All runs of 1 to ``n`` words."""
    out = list(words)
    for k in range(2, n + 1):
        out += [b" ".join(w) for w in zip(*(words[i:] for i in range(k)), strict=False)]
    return out


def crossing_features(lines: list[list[bytes]], n: int) -> list[bytes]:
    """The runs of up to ``n`` words that begin in one line and end in another."""
    words = [w for line in lines for w in line]
    of = [i for i, line in enumerate(lines) for _ in line]
    return [b" ".join(words[i : i + k]) for k in range(2, n + 1) for i in range(len(words) - k + 1) if of[i] != of[i + k - 1]]


def _line_key(line: Column) -> Column:
    return F.substring(F.unhex(F.sha2(line, 256)), 1, 16)


_FEATURED = [T.StructField("n_words", T.LongType()), T.StructField("features", T.BinaryType())]


def featured_lines(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(key, times, n_words, features): the distinct lines of ``texts(text)``."""
    distinct = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("times"))

    def make():
        def work(lines: list[str]) -> list[list]:
            words = [words_of(x) for x in lines]
            return [[len(w) for w in words], [_bucketed(line_features(w, n), buckets) for w in words]]

        return work

    return map_texts(distinct.select("line", "times", _line_key(F.col("line")).alias("key")), "line", make, _FEATURED, ["key", "times"])


def crossing(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """``texts(row, doc, text)`` as (row, doc, times = 1, features): what crosses lines, of documents of two lines or more."""

    def make():
        return lambda batch: [[0] * len(batch), [_bucketed(crossing_features([words_of(x) for x in t.split("\n")], n), buckets) for t in batch]]

    several = texts.filter(F.col("text").contains("\n"))
    return map_texts(several, "text", make, _FEATURED, ["row", "doc"]).withColumn("times", F.lit(1).cast("long"))


def _over_features(rows: DataFrame, keep: list[str], work, schema: T.StructType) -> DataFrame:
    """``work``: a generator over (kept columns, all buckets of a batch in one array, the length of each row's)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple]:
            for batch in batches:
                data = batch.column(batch.num_columns - 1).to_pylist()
                yield batch.columns[:-1], np.frombuffer(b"".join(data), np.uint16), np.array([len(d) // 2 for d in data], np.int64)

        for columns in work(cells()):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return small_batches(rows).select(*keep, "features").mapInArrow(run, schema)


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in ``rows(times, features)``."""

    def work(cells: Iterator[tuple]) -> Iterator[list]:
        total = np.zeros(buckets, np.int64)
        for (times,), found, sizes in cells:
            weights = np.repeat(times.to_numpy(zero_copy_only=False), sizes)
            total += np.bincount(found, weights, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield [at.tolist(), total[at].tolist()]

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    sums = _over_features(rows, ["times"], work, schema).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of both smoothed shares."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(rows: DataFrame, keep: list[str], gain: np.ndarray) -> DataFrame:
    """``keep`` of ``rows`` with ``n_features`` and ``weight``."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def work(cells: Iterator[tuple]) -> Iterator[list]:
        for kept, found, sizes in cells:
            sums = np.concatenate([[0], np.cumsum(shared.value[found])])
            ends = np.cumsum(sizes)
            yield [*kept, sizes.tolist(), (sums[ends] - sums[ends - sizes]).tolist()]

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    return _over_features(rows, keep, work, schema)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place`` from 1 in an order: sorted in ranges, and moved by how many rows the ranges before have."""
    at = materialise(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part, within = F.call_function("shiftright", F.col("__at"), F.lit(33)), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return at.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("place", F.col("__start") + within + 1).drop("__at", "__part", "__start")


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = NGRAMS, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, mark, n_features, weight, score, rank), one row per document: ``mark`` is the hash of its text, ``rank`` null
    for documents that aren't drawn."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered in 16 bits")
    texts = docs.select(col(id_col).alias("doc"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    wanted = target.select(F.coalesce(col(target_col), F.lit("")).alias("text")).select(F.lit(0).cast("long").alias("row"), F.lit(0).alias("doc"), "text")
    lines = materialise(featured_lines(texts, n, buckets), "lines")
    source, aim = histogram(lines, buckets), histogram(featured_lines(wanted, n, buckets), buckets)
    across = None
    if n > 1:
        across = materialise(crossing(texts.withColumn("doc", F.lit(None).cast("int")), n, buckets), "crossing")
        source, aim = source + histogram(across, buckets), aim + histogram(crossing(wanted, n, buckets), buckets)
    gain = gains(source, aim)

    weighed = _weighed(lines, ["key", "n_words"], gain)
    own = texts.select("row", "doc", F.xxhash64("text").alias("mark"), F.explode(F.split("text", "\n", -1)).alias("line")).select("row", "doc", "mark", _line_key(F.col("line")).alias("key"))
    sums = own.join(weighed, "key").groupBy("row", "doc", "mark").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    if across is not None:
        more = _weighed(across, ["row"], gain).select("row", F.col("n_features").alias("__n"), F.col("weight").alias("__w"))
        sums = sums.join(more, "row", "left")
        sums = sums.withColumns({"n_features": F.col("n_features") + F.coalesce("__n", F.lit(0)), "weight": F.col("weight") + F.coalesce("__w", F.lit(0))})
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(sums.select("doc", "mark", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "scored")
    fit = F.col("n_words") >= least
    most = percent * scored.filter(fit).count() // 100
    drawn = placed(scored.filter(fit), F.desc("score"), F.asc_nulls_last("doc"))
    drawn = drawn.withColumn("rank", F.when(F.col("place") <= most, F.col("place"))).drop("place")
    rest = scored.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("doc").alias("doc_id"), "mark", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that are drawn, with all their columns. Rows of one id and one text go or stay together."""
    rows, place, back = numbered(docs)
    found = importance(docs, target, id_col, text_col, **how).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark")).distinct()
    mark = F.xxhash64(F.coalesce(F.col(place(text_col)), F.lit("")))
    return back(rows.join(found, F.col(place(id_col)).eqNullSafe(F.col("__doc")) & (mark == F.col("__mark")), "left_semi"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# A step of the table of CRC-32, for one bit.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"

#: The same with words joined to their buckets, for DuckDB.
SQL = f"""
WITH RECURSIVE bits AS (SELECT i AS byte, i AS c, 0 AS step FROM range(256) r(i) UNION ALL SELECT byte, {_STEP.format('c')}, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY byte) AS k FROM bits WHERE step = 8),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
v AS (SELECT DISTINCT word FROM dw UNION SELECT DISTINCT word FROM bw),
vb AS (SELECT word, list_transform(range(1, length(hex(word)) // 2 + 1), lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT) AS b FROM v),
vc AS (SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, k[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM vb, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN vc USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN vc USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN vc USING (word) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT d.doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT AS h FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
SELECT y.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN rank <= 10 * (SELECT count(*) FROM z) // 100 THEN rank END AS rank
FROM y LEFT JOIN z USING (doc_id)
"""
