"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature holds a key for each of its terms and, for terms that occur more often, one for each of ``LEVELS``
that the term reaches. Documents of like size are put together into a group; a group's signatures are stored by bit, so
that a *slice* is a bitmap over the group's documents. The bitmaps of a term's slices, taken together, overestimate the
documents that hold it (so often); sums of these bitmaps, weighted by the terms of an item, bound each document's score
from above, as a term that reaches no further level occurs less often than the next one asks for.

The index is a table of groups, and a table of terms with the number of documents that hold them. It doesn't depend on the
items. An item is searched in two passes over the groups. The first one chooses the documents with the highest bounds,
which are scored exactly: the lowest of ``k`` such scores is a floor that the result can't fall below. The second one
takes every document whose bound reaches this floor; these are scored exactly, by their whole texts, and ranked. What is
left out is therefore proven not to be in the result, whatever the signatures' errors.

The items are the query set: they are read in blocks of ``BLOCK_BYTES`` (``BLOCK_ITEMS`` items at most) and each block is
searched by itself, so that what is broadcast is bounded.

Edge cases: null and empty texts and texts without terms are in no result and count nowhere; items without terms, or
with terms that no document has, get no rows; repeated items are searched one by one, rows that repeat an id are
documents of their own, and null ids are given after all others among equal scores; texts of any length are read whole;
empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, map_cells, materialise, small_batches, table
from wordloom.llm.decontaminate import words_of

#: Occurrences from which a term has one more key.
LEVELS = (1, 2, 3, 6, 12)
#: Bits of a key, and bits of a signature for each key at least (a power of two in all).
HASHES, BITS = 4, 8
#: Documents of a group and bytes of its slices at most; documents and keys that a task gathers before it makes groups.
GROUP, SLICES, GATHERED, KEYS = 2048, 2 << 20, 8192, 1 << 20
#: Terms that a task counts before it gives their counts.
COUNTED = 200_000
#: Characters of items, and items, that are searched together.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 19, 4096
#: Documents of a group whose bounds are made exact in the first pass.
TRIED = 64
#: Candidates up to which they are broadcast (some 30 bytes each).
BROADCAST_ROWS = 200_000

K1000, B12 = 1000, 12  # the score's own constants


@dataclass
class Index:
    """``groups``: docs, marks, n, top (of each document its id, its text's hash, terms, occurrences of the most frequent
    one), width and slices; ``terms``: term, df. ``n`` documents have ``total`` terms."""

    groups: DataFrame
    terms: DataFrame
    n: int
    total: int


def _positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """The slices of each key: (keys, HASHES)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(width - 1)).astype(np.int64)


def _keys(counts: Counter) -> np.ndarray:
    """The keys of a document."""
    made = [xxhash.xxh64_intdigest(t, 0) for t in counts]
    often = [(t, n) for t, n in counts.items() if n > 1]
    for k, least in enumerate(LEVELS[1:], 1):
        often = [x for x in often if x[1] >= least]
        made += [xxhash.xxh64_intdigest(t, k) for t, _ in often]
    return np.array(made, np.uint64)


def _width(keys: int) -> int:
    return 1 << max(6, (BITS * keys - 1).bit_length())


def slices(keys: list[np.ndarray], width: int) -> bytes:
    """The signatures of some documents by bit: ``width`` bitmaps, each of whole bytes."""
    bits = np.zeros((width, -(-len(keys) // 8) * 8), bool)
    for i, k in enumerate(keys):
        bits[_positions(k, width).ravel(), i] = True
    return np.packbits(bits, axis=1).tobytes()


def _grouped(gathered: list[tuple]) -> Iterator[tuple]:
    """Documents (keys first) in groups of the same width."""
    gathered.sort(key=lambda d: len(d[0]))
    group: list[tuple] = []
    for d in gathered:
        width = _width(len(d[0]))
        if group and (width != _width(len(group[0][0])) or len(group) >= GROUP or width * (len(group) + 1) > 8 * SLICES):
            yield group, _width(len(group[0][0]))
            group = []
        group.append(d)
    if group:
        yield group, _width(len(group[0][0]))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, in the shared folder."""
    source = docs.select(col(id_col).alias("doc"), F.coalesce(col(text_col), F.lit("")).alias("text")).select("doc", F.xxhash64("text").alias("mark"), "text")
    doc_type = source.schema["doc"].dataType
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    fields = [("term", T.BinaryType()), ("df", T.LongType()), ("docs", T.ArrayType(doc_type)), ("marks", longs), ("n", ints), ("top", ints), ("width", T.IntegerType()), ("slices", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple] = []
        size, held = 0, Counter()

        def groups() -> Iterator[pa.RecordBatch]:
            for group, width in _grouped(gathered):
                keys, ids, marks, n, top = zip(*group, strict=True)
                row = [None, None, list(ids), list(marks), list(n), list(top), width, slices(list(keys), width)]
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, shape, strict=True)], schema=shape)

        def terms() -> Iterator[pa.RecordBatch]:
            if held:
                rest = [pa.nulls(len(held), f.type) for f in list(shape)[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64()), *rest], schema=shape)

        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, mark, text in zip(ids, marks, batch.column(2), strict=True):
                counts = Counter(words_of(text.as_py()))
                if not counts:
                    continue
                held.update(counts.keys())
                keys = _keys(counts)
                gathered.append((keys, doc, mark, counts.total(), max(counts.values())))
                size += len(keys)
                if len(gathered) >= GATHERED or size >= KEYS:
                    yield from groups()
                    gathered, size = [], 0
                if len(held) >= COUNTED:
                    yield from terms()
                    held = Counter()
        yield from groups()
        yield from terms()

    made = materialise(small_batches(source).mapInArrow(run, schema), "index")
    groups = made.filter("width IS NOT NULL").select("docs", "marks", "n", "top", "width", "slices")
    zero = F.lit(0).cast("long")
    sums = groups.select(F.size("docs").alias("n"), F.aggregate("n", zero, lambda a, x: a + x).alias("total")).agg(F.sum("n"), F.sum("total")).first()
    terms = materialise(made.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")), "terms")
    return Index(groups, terms, sums[0] or 0, sums[1] or 0)


@dataclass
class Items:
    """A block of items over the terms that documents have: ``terms``, their weights, and for each item the places of its
    terms and their weights by how often it has them."""

    terms: list[bytes]
    weights: np.ndarray
    places: list[np.ndarray]
    totals: list[np.ndarray]
    n: int
    total: int

    def length_part(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n terms."""
        return 75 + (25 * n * self.n) // self.total

    def score(self, q: int, counts: Counter, m: int) -> int:
        """The exact score of a document."""
        tf = np.array([counts.get(self.terms[p], 0) for p in self.places[q]], np.int64)
        return int((self.totals[q] * ((1_000_000_000 * tf) // (K1000 * tf + B12 * m))).sum())


def prepare(index: Index, texts: list[str]) -> Items:
    """The items' terms and weights. Only terms that some document has are kept: others add nothing to any score."""
    counts = [Counter(words_of(t or "")) for t in texts]
    wanted = sorted(set().union(*counts)) if counts else []
    spark = index.terms.sparkSession
    asked = spark.createDataFrame([(bytearray(t),) for t in wanted], "term binary")
    known = {bytes(r.term): r.df for r in index.terms.join(F.broadcast(asked), "term").collect()} if wanted else {}  # of the terms of a block
    terms = [t for t in wanted if t in known]
    place = {t: i for i, t in enumerate(terms)}
    weights = np.array([math.floor(1000 * math.log((2 * index.n + 2) / (2 * known[t] + 1))) for t in terms], np.int64)
    places = [np.array(sorted(place[t] for t in c if t in place), np.int64) for c in counts]
    totals = [np.array([weights[p] * c[terms[p]] for p in own], np.int64) for c, own in zip(counts, places, strict=True)]
    return Items(terms, weights, places, totals, index.n, index.total)


class Bounds:
    """Upper bounds of the scores of a group's documents."""

    def __init__(self, items: Items):
        self.items = items
        self.hashes = [np.array([xxhash.xxh64_intdigest(t, k) for t in items.terms], np.uint64) for k in range(len(LEVELS))]
        small = all(t.sum() < 1 << 24 for t in items.totals)  # whole numbers that are exact as floats of 32 bits
        self.kind = np.float32 if small else np.float64
        self.totals = [t.astype(self.kind) for t in items.totals]

    def load(self, n: list[int], top: list[int], width: int, data: bytes) -> None:
        self.n = len(n)
        bits = np.frombuffer(data, np.uint8).reshape(width, -1)
        self.maps = [np.bitwise_and.reduce(bits[_positions(h, width)], axis=1) for h in self.hashes]
        for lower, maps in zip(self.maps, self.maps[1:], strict=False):  # a term reaches no level without the one below
            maps &= lower
        self.plain = np.unpackbits(self.maps[0], axis=1)[:, : self.n].astype(self.kind)
        most = np.array(top, np.int64)
        m = self.items.length_part(np.array(n, np.int64))
        highest = [np.minimum(most, (*LEVELS[1:], 1 << 62)[k] - 1) for k in range(len(LEVELS))]
        share = [(1_000_000_000 * tf) // (K1000 * tf + B12 * m) for tf in highest]
        self.steps = [share[0], *(b - a for a, b in zip(share, share[1:], strict=False))]
        self.most = share[-1]

    def coarse(self, q: int) -> np.ndarray:
        """From the terms alone, as if each occurred as often as any."""
        return (self.totals[q] @ self.plain[self.items.places[q]]).astype(np.int64) * self.most

    def fine(self, q: int, at: np.ndarray) -> np.ndarray:
        """From the levels that terms reach, of the documents ``at``."""
        own, out = self.items.places[q], np.zeros(len(at), np.int64)
        for maps, step in zip(self.maps, self.steps, strict=True):
            out += (self.totals[q] @ np.unpackbits(maps[own], axis=1)[:, at].astype(self.kind)).astype(np.int64) * step[at]
        return out


def _over_groups(index: Index, work, schema: T.StructType) -> DataFrame:
    """``work``: a generator over (docs, marks, n, top, width, slices) of one task's groups; gives lists of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield [c[i].as_py() for c in batch.columns]

        for columns in work(groups()):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return index.groups.mapInArrow(run, schema)


def _highest(index: Index, shared, k: int) -> DataFrame:
    """(q, doc, mark, bound): for each task the ``k`` documents of highest bounds of each item."""
    doc_type = index.groups.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc", doc_type), T.StructField("mark", T.LongType()), T.StructField("bound", T.LongType())])

    def work(groups: Iterator[list]) -> Iterator[list]:
        items = shared.value
        bounds, best = Bounds(items), [[] for _ in items.places]
        for docs, marks, n, top, width, data in groups:
            bounds.load(n, top, width, data)
            for q, own in enumerate(items.places):
                if not len(own):
                    continue
                coarse = bounds.coarse(q)
                floor = best[q][-1][0] if len(best[q]) >= k else 0
                at = np.flatnonzero(coarse > floor)
                if len(at) > TRIED:
                    at = at[np.argpartition(-coarse[at], TRIED)[:TRIED]]
                if len(at):
                    new = [(int(b), docs[i], marks[i]) for i, b in zip(at, bounds.fine(q, at), strict=True) if b > floor]
                    best[q] = sorted(best[q] + new, key=lambda x: -x[0])[:k]
        found = [(q, doc, mark, b) for q, own in enumerate(best) for b, doc, mark in own]
        if found:
            yield [list(c) for c in zip(*found, strict=True)]

    return _over_groups(index, work, schema)


def _reaching(index: Index, shared, floors: list[int]) -> DataFrame:
    """(q, doc, mark): all documents whose bounds reach the floor of an item."""
    doc_type = index.groups.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc", doc_type), T.StructField("mark", T.LongType())])

    def work(groups: Iterator[list]) -> Iterator[list]:
        items = shared.value
        bounds = Bounds(items)
        for docs, marks, n, top, width, data in groups:
            bounds.load(n, top, width, data)
            found = []
            for q, own in enumerate(items.places):
                if len(own):
                    at = np.flatnonzero(bounds.coarse(q) >= floors[q])
                    if len(at):
                        found += [(q, docs[i], marks[i]) for i in at[bounds.fine(q, at) >= floors[q]]]
            if found:
                yield [list(c) for c in zip(*found, strict=True)]

    return _over_groups(index, work, schema)


def _exact(source: DataFrame, shared, chosen: DataFrame) -> DataFrame:
    """(q, doc, score) of the chosen (q, doc, mark), from whole texts."""
    asked = chosen.groupBy("doc", "mark").agg(F.collect_set("q").alias("qs"))  # items of a block at most
    asked = materialise(asked.withColumnsRenamed({"doc": "__doc", "mark": "__mark"}), "asked")
    few = asked.agg(F.sum(F.size("qs"))).first()[0] or 0
    met = source.join(F.broadcast(asked) if few <= BROADCAST_ROWS else asked, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")))

    def make():
        def work(cells: list[dict]) -> list[list]:
            items, out = shared.value, []
            for cell in cells:
                counts = Counter(words_of(cell["text"]))
                m = int(items.length_part(np.int64(counts.total())))
                out.append([{"q": q, "score": items.score(q, counts, m)} for q in cell["qs"]])
            return [out]

        return work

    pair = T.ArrayType(T.StructType([T.StructField("q", T.IntegerType()), T.StructField("score", T.LongType())]))
    scored = map_cells(met.select("doc", "text", "qs"), F.struct("text", "qs"), make, [T.StructField("scored", pair)], ["doc"])
    return scored.select("doc", F.explode("scored").alias("s")).select("s.q", "doc", "s.score").filter("score > 0")


def _first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    block: list[tuple[object, str]] = []
    size = 0
    for row in items.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).toLocalIterator():
        if block and (size + len(row.text) > BLOCK_BYTES or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((row.id, row.text))
        size += len(row.text)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index: Index | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, equal scores by id."""
    index = index or build_index(docs, id_col, text_col)
    spark = docs.sparkSession
    source = docs.select(col(id_col).alias("doc"), F.coalesce(col(text_col), F.lit("")).alias("text")).select("doc", F.xxhash64("text").alias("mark"), "text")
    id_type, doc_type = items.schema[item_col].dataType, source.schema["doc"].dataType
    found = []
    for block in _blocks(items, item_col, item_text_col) if index.n else ():
        prepared = prepare(index, [text for _, text in block])
        shared = spark.sparkContext.broadcast(prepared)  # the terms of a block of items
        tried = _first(_highest(index, shared, k), k, F.desc("bound"), "doc", "mark").select("q", "doc", "mark")
        reached = _first(_exact(source, shared, tried), k, F.desc("score"), "doc").groupBy("q").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
        floors = [1] * len(block)
        for r in reached.filter(F.col("n") >= k).collect():  # a row for each item of a block
            floors[r.q] = r.floor
        scored = _exact(source, shared, _reaching(index, shared, floors))
        top = _first(scored, k, F.desc("score"), F.asc_nulls_last("doc"))
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", id_type)]))
        found.append(top.join(F.broadcast(names), "q").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
    if not found:
        schema = T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same by joining terms, for DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
x AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM df, c),
m AS (SELECT doc_id, 75 + (25 * len(w) * docs) // total AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, CAST(sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN x USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
