"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are runs of ASCII digits and letters (lower-cased) and of all characters beyond ASCII. Every window of ten
consecutive words of a benchmark item is a pattern; an item with fewer words is one pattern. Texts and patterns are
brought to the form ``" word word word "``, so that a match of bytes is a match of whole words.

The search keeps, for each length band of patterns, a table from blocks of ``B`` bytes to a safe shift. A block that
occurs in no pattern moves the position by ``m - B + 1``; a block that may end the first ``m`` bytes of a pattern
selects a bucket, whose patterns are compared directly.

The benchmark is the query set and is read in blocks of ``BLOCK_BYTES``. A worker keeps the tables of a few blocks; where
there are more, it gathers texts and goes through block after block, so that tables are built once for many texts. What is
broadcast at once is ``PASS_BLOCKS`` blocks at most: for a larger benchmark the documents are written once with row
numbers, and searched in several passes whose hits meet by row.

Edge cases: null or empty texts have no words and no hits; items without words are ignored; repeated items count
once per ``item_id``, null ids as ""; repeated rows are searched one by one; very long texts are searched whole; empty
tables give no rows or no hits. Input columns named like a result column are replaced by ``find_overlaps``;
``drop_contaminated`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_type

from wordloom.llm.common import col, flagged, free, materialise, numbered, pieces, small_batches, table, worker_memory

WINDOW = 10
#: Characters of benchmark items in a block, blocks whose tables a worker keeps, and blocks that are broadcast at once.
BLOCK_BYTES, HELD_BLOCKS, PASS_BLOCKS = 1 << 19, 2, 64
#: Bytes of texts that a worker gathers where it has to build tables again.
GATHERED = 32 << 20
#: Pattern lengths from which a new band of tables begins, so that one short pattern does not spoil all shifts.
BANDS = (0, 8, 16, 32, 64)
LONGEST_BLOCK = 8

_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


def _normal(text: str) -> tuple[int, bytes]:
    """How many words a text has, and the form in which it is searched."""
    words = words_of(text)
    return len(words), b" " + b" ".join(words) + b" "


def windows_of(text: str, window: int = WINDOW) -> set[bytes]:
    """The distinct patterns of an item."""
    words = words_of(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


class WuManber:
    """Shift tables and suffix buckets of one length band of patterns."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.b = min(LONGEST_BLOCK, max(2, self.m // 3), self.m)
        self.default = self.m - self.b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[int]] = defaultdict(list)
        for k, p in enumerate(patterns):
            for end in range(self.b, self.m + 1):
                block = p[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.default), self.m - end)
            self.buckets[p[self.m - self.b : self.m]].append(k)

    def search(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start byte, pattern number) of every occurrence."""
        m, b, default, get, buckets, patterns = self.m, self.b, self.default, self.shift.get, self.buckets, self.patterns
        end, n = m, len(text)
        while end <= n:
            block = text[end - b : end]
            step = get(block, default)
            if step:
                end += step
                continue
            start = end - m
            for k in buckets[block]:
                if text.startswith(patterns[k], start):
                    yield start, k
            end += 1


class Matcher:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            for p in windows_of(text, window):
                owners[p].add(item)
        self.bands = []
        for low, high in zip(BANDS, (*BANDS[1:], 1 << 62), strict=True):
            if band := sorted(p for p in owners if low <= len(p) < high):
                self.bands.append((WuManber(band), [(p.count(b" ") - 1, sorted(owners[p])) for p in band]))

    def hits(self, text: bytes, found: set[str], marks: list[tuple[int, int]]) -> None:
        """Add the items that occur and the word ranges they cover."""
        for tables, about in self.bands:
            seen, words = 0, 0  # words: spaces before byte ``seen``
            for start, k in tables.search(text):
                words += text.count(b" ", seen, start)
                seen = start
                n, items = about[k]
                found.update(items)
                marks.append((words, words + n))

    def occurs(self, text: bytes) -> bool:
        """Does any window occur?"""
        return any(next(tables.search(text), None) is not None for tables, _ in self.bands)


def _merged(marks: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for start, end in sorted(marks):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def _width(spans: list[dict[str, int]]) -> int:
    return sum(s["end"] - s["start"] for s in spans)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), col(text_col).alias("text")).filter(F.col("text").isNotNull())
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.id, row.text))
        size += len(row.text)
    if block:
        yield block


def _one_pass(docs: DataFrame, text_col: str, blocks: list[list[tuple[str, str]]], window: int, keep: list[str]) -> DataFrame:
    """``keep`` and FIELDS for one set of blocks."""
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(block) for block in blocks]
    key = f"decontaminate {uuid.uuid4().hex}"
    kept = [c for c in keep if c not in {f.name for f in FIELDS}]
    source = docs.select(*map(col, kept), F.coalesce(col(text_col), F.lit("")).alias(free(kept, "__text")))
    types = [to_arrow_type(f.dataType) for f in FIELDS]
    names = [*kept, *(f.name for f in FIELDS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Matcher] = worker_memory(key, dict)  # type: ignore[assignment]

        def matcher(k: int) -> Matcher:
            if k not in tables:
                while len(tables) >= HELD_BLOCKS:
                    del tables[next(iter(tables))]
                tables[k] = Matcher(shared[k].value, window)
            return tables[k]

        def search(gathered: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [_normal(t) for batch in gathered for t in batch.column(batch.num_columns - 1).to_pylist()]
            found: list[set[str]] = [set() for _ in texts]
            marks: list[list[tuple[int, int]]] = [[] for _ in texts]
            for k in range(len(shared)):
                tables_k = matcher(k)
                for (n, text), f, m in zip(texts, found, marks, strict=True):
                    if n:
                        tables_k.hits(text, f, m)
            at = 0
            for batch in gathered:
                own = slice(at, at + batch.num_rows)
                at += batch.num_rows
                spans = [_merged(m) for m in marks[own]]
                made = [[n for n, _ in texts[own]], [_width(x) for x in spans], [sorted(f) for f in found[own]], spans]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, type=t) for v, t in zip(made, types, strict=True))], names=names)

        waiting, size = [], 0
        for whole in batches:
            for batch in pieces(whole, GATHERED):
                waiting.append(batch)
                size += batch.nbytes
                if len(shared) <= HELD_BLOCKS or size >= GATHERED:
                    yield from search(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from search(waiting)

    return small_batches(source).mapInArrow(run, T.StructType([*source.schema.fields[:-1], *FIELDS]))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
    pass_blocks: int = PASS_BLOCKS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted as strings) and ``hit_spans`` (word ranges, end exclusive)."""
    keep = docs.columns if keep is None else keep
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first = list(islice(blocks, pass_blocks))
    following = list(islice(blocks, pass_blocks))
    if not following:
        return _one_pass(docs, text_col, first, window, keep)

    rows, place, _ = numbered(docs)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    hits, group = [], first
    while group:
        found = _one_pass(rows, place(text_col), group, window, ["row"])
        hits.append(materialise(found.filter("n_hit > 0").select("row", "items", "hit_spans"), "hits"))
        group, following = following, list(islice(blocks, pass_blocks))
    met = reduce(DataFrame.unionByName, hits).groupBy("row").agg(  # a row for each pass at most
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("marks")
    )
    merge = F.udf(lambda marks: _merged([(m["start"], m["end"]) for m in marks]), FIELDS[3].dataType, useArrow=True)  # hit rows only
    met = met.select("row", "items", merge("marks").alias("hit_spans"))
    counted = _one_pass(rows, place(text_col), [], window, ["row", *map(place, keep)]).drop("n_hit", "items", "hit_spans").join(met, "row", "left")
    spans = F.coalesce("hit_spans", F.lit([]).cast(FIELDS[3].dataType))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    kept = [c for c in keep if c not in {f.name for f in FIELDS}]
    return counted.select(*map(place, kept), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.lit([]).cast("array<string>")).alias("items"), spans.alias("hit_spans")).toDF(*kept, *(f.name for f in FIELDS))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, held: int = HELD_BLOCKS) -> DataFrame:
    """The documents without any occurrence, all their columns unchanged. Where a worker can keep all tables, only texts
    go to Python."""
    rows, place, back = numbered(docs)
    text = F.col(place(text_col))
    blocks = list(islice(_blocks(benchmark, "item_id", "text", block_bytes), held + 1))
    if len(blocks) > held:
        packed = rows.select(F.struct(*rows.columns).alias("row"), text.alias("text"))
        return back(find_overlaps(packed, benchmark, block_bytes=block_bytes, keep=["row"]).filter("n_hit = 0").select("row.*"))
    shared = docs.sparkSession.sparkContext.broadcast(blocks)
    key = f"decontaminate {uuid.uuid4().hex}"

    def make():
        tables: list[Matcher] = worker_memory(key, lambda: [Matcher(block) for block in shared.value])  # type: ignore[assignment]

        def clean(text: str) -> bool:
            n, normal = _normal(text)
            return not n or not any(t.occurs(normal) for t in tables)

        return lambda texts: [clean(x) for x in texts]

    return back(small_batches(rows).filter(flagged(text, make, key)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same by joining windows of words, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM p),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN p ON p.n = dw.n AND p.g = dw.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
