"""Secret scans with DataFrame functions only.

Three patterns give the base spans. Beyond them, two character Markov models score every other long run of key-like
characters: one of random strings, one of ordinary identifiers. The log-likelihood ratio is summed along a run; where its
sum from some character on exceeds ``THRESHOLD``, until it has fallen to nothing or by as much again, a part of the run is
a secret, whatever else the run holds. The part goes on to the next sign on either side. Runs are what base spans leave.
The samples are labelled by the patterns themselves: values of base spans are random strings, shorter words outside them
are identifiers. Both are bounded samples of documents.

Positions come from splitting a text at the matches: the lengths of gaps and matches add up to code-point offsets, in
blocks of ``BLOCK`` matches, so that a text full of matches takes no more than its share.

Edge cases: null and empty texts have no spans and stay as they are; without samples both models are uniform or nearly
so; equal rows get equal results; rows without an id are scanned but not sampled; very long texts and runs are read
whole; tables without rows give none. ``find_secrets`` replaces a column named ``spans``; ``redact`` keeps all columns,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import col, free, numbered, sampled, table

#: Kind, pattern, group whose length counts, least length: fixed by the contract. The least lengths of the last two stand in
#: their patterns too: their matches are whole runs, so a shorter one holds no other.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: What a text must hold for the pattern to give a span: a quick test that most texts fail.
QUICK = {"assign": BASE[0][1].replace("]+)", "]{6})"), "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
RUN, RUN_LEAST = r"[A-Za-z0-9+/_=-]{20,}", 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Natural log of the odds that a part of a run must beat.
THRESHOLD = 14.0
#: Documents searched for labelled random strings, and those whose words are labelled identifiers.
RANDOM_DOCS, WORD_DOCS = 20_000, 1_000
MARK = "[SECRET]"
BLOCK = 256
_SPANS = "array<struct<start:int,`order`:int,`end`:int,kind:string,value:string>>"


def _none(kind: str) -> Column:
    return F.expr(f"CAST(array() AS {kind})")


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, order, end, kind, value>> of the matches that are long enough."""
    regex = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, regex, F.lit(0)).alias("h"), F.regexp_extract_all(text, regex, F.lit(group)).alias("v"))
    matches = F.filter(F.transform(zipped, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["h"]).alias("h"), x["v"].alias("v"))), lambda x: x["h"].isNotNull())

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["h"]).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        return F.struct((start + x["h"]).alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["order"].alias("order"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))

    def of_all(found: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK)), lambda k: F.aggregate(F.slice(found, k * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), _none(_SPANS).alias("spans")), add))
        join = lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(moved(b["spans"], acc["at"]))).alias("all"))
        placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), _none(f"array<{_SPANS}>").alias("all")), join, lambda acc: F.flatten(acc["all"]))
        return F.when(F.size(found) > 0, placed).otherwise(_none(_SPANS))

    return F.transform(F.array(matches), of_all)[0]  # the matches as a variable: found once


def _if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(_none(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and then kind."""
    return F.array_sort(F.concat(*(_if(text.rlike(QUICK[kind]), _spans(text, kind, k, pattern, group, least)) for k, (kind, pattern, group, least) in enumerate(BASE))))


def _transitions(token: Column) -> Column:
    """Pairs of neighbouring characters as numbers."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * 128 + b)


def _counts(tokens: DataFrame) -> dict[int, int]:
    """Transition counts; at most one row for each pair of the alphabet."""
    pairs = tokens.select(F.explode(_transitions(F.col("token"))).alias("pair"))
    return {r.pair: r["count"] for r in pairs.filter("pair < 16384").groupBy("pair").count().collect()}


def _log_probabilities(counts: dict[int, int], mix: float) -> dict[tuple[int, int], float]:
    """log P(next | previous) within the alphabet, add-half smoothed, mixed with the uniform distribution."""
    codes, out = [ord(c) for c in ALPHABET], {}
    for a in codes:
        total = sum(counts.get(a * 128 + b, 0) for b in codes)
        for b in codes:
            p = (counts.get(a * 128 + b, 0) + 0.5) / (total + 0.5 * len(codes))
            out[a, b] = math.log((1 - mix) * p + mix / len(codes))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratios by ``previous * 128 + next``, from two bounded samples of documents."""
    total = docs.count()
    some = sampled(docs, id_col, RANDOM_DOCS, total, 1).select(F.explode(base_spans(F.coalesce(col(text_col), F.lit("")))).alias("s"))
    random = _counts(some.select(F.col("s.value").alias("token")))
    text = F.coalesce(col(text_col), F.lit(""))
    for _, pattern, _, _ in BASE:
        text = F.regexp_replace(text, pattern, " ")
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]+"), F.lit(0))
    ordinary = _counts(sampled(docs, id_col, WORD_DOCS, total, 2).select(F.explode(words).alias("token")).filter(F.length("token") < RUN_LEAST))
    secret, plain = _log_probabilities(random, 0.5), _log_probabilities(ordinary, 0.02)
    ratios = [0.0] * 16384
    for (a, b), p in secret.items():
        ratios[a * 128 + b] = p - plain[a, b]
    return ratios


def _parts(run: Column, weights: Column) -> Column:
    """Spans of kind ``random`` within a run (a span): where the running sum of the ratios exceeds THRESHOLD."""
    no_parts = _none("array<struct<first:int,last:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("since"), F.lit(0.0).alias("best"), F.lit(0).alias("until"), no_parts.alias("found"))

    def closed(acc: Column) -> Column:
        return F.when(acc["best"] > THRESHOLD, F.concat(acc["found"], F.array(F.struct(acc["since"].alias("first"), acc["until"].alias("last"))))).otherwise(acc["found"])

    def step(acc: Column, k: Column) -> Column:
        total = acc["sum"] + F.element_at(weights, k + 1)
        over = (total <= 0) | (total < acc["best"] - THRESHOLD)
        higher = ~over & (total > acc["best"])
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(over, 0.0).otherwise(total).alias("sum"),
            F.when(over, acc["i"] + 1).otherwise(acc["since"]).alias("since"),
            F.when(over, 0.0).when(higher, total).otherwise(acc["best"]).alias("best"),
            F.when(higher, acc["i"] + 2).otherwise(acc["until"]).alias("until"),
            F.when(over, closed(acc)).otherwise(acc["found"]).alias("found"),
        )

    value = run["value"]
    left = lambda p: F.length(F.element_at(F.split(F.substring(value, F.lit(1), p["first"]), "[^A-Za-z0-9]", -1), -1))
    right = lambda p: F.length(F.element_at(F.split(F.substring(value, p["last"] + 1, F.length(value)), "[^A-Za-z0-9]", 2), 1))
    wide = F.transform(F.aggregate(_transitions(value), start, step, closed), lambda p: F.struct((p["first"] - left(p)).alias("first"), (p["last"] + right(p)).alias("last")))
    long = F.filter(F.array_distinct(wide), lambda p: p["last"] - p["first"] >= RUN_LEAST)
    return F.transform(
        long,
        lambda p: F.struct((run["start"] + p["first"]).alias("start"), F.lit(len(BASE)).alias("order"), (run["start"] + p["last"]).alias("end"), F.lit("random").alias("kind"), F.substring(value, p["first"] + 1, p["last"] - p["first"]).alias("value")),
    )


def _covered(spans: Column) -> Column:
    """array<struct<start, end>>: what spans (by start) cover, once."""
    empty = _none("array<struct<start:int,`end`:int>>")

    def step(acc: Column, s: Column) -> Column:
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        return F.struct(
            F.when(s["start"] < acc["end"], acc["done"]).otherwise(F.concat(acc["done"], F.filter(F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))), lambda x: x["start"] >= 0))).alias("done"),
            F.when(s["start"] < acc["end"], acc["start"]).otherwise(own["start"]).alias("start"),
            F.when(s["start"] < acc["end"], F.greatest(acc["end"], own["end"])).otherwise(own["end"]).alias("end"),
        )

    last = lambda acc: F.concat(acc["done"], F.filter(F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))), lambda x: x["start"] >= 0))
    return F.aggregate(spans, F.struct(empty.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")), step, last)


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with what spans cover replaced."""

    def pieces(covered: Column) -> Column:
        before = lambda i: F.when(i > 0, F.try_element_at(covered, i)["end"]).otherwise(0)
        parts = F.transform(covered, lambda c, i: F.concat(F.substring(text, before(i) + 1, c["start"] - before(i)), by(c)))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(covered, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.transform(F.array(_covered(spans)), pieces)[0]).otherwise(text)


def _scanned(docs: DataFrame, text: Column, ratios: list[float], name: str) -> DataFrame:
    """``docs`` with base spans and those of kind ``random``, by start, as a column of a free name."""
    weights = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")  # a constant: folded once
    base, runs = free(docs.columns, f"{name}_base"), free(docs.columns, f"{name}_runs")
    based = docs.withColumn(base, base_spans(text))
    masked = _replaced(text, col(base), lambda c: F.repeat(F.lit(" "), c["end"] - c["start"]))
    scanned = based.withColumn(runs, _if(text.rlike(RUN), _spans(masked, "random", len(BASE), RUN, 0, RUN_LEAST)))
    likely = F.flatten(F.transform(col(runs), lambda r: _parts(r, weights)))
    return scanned.withColumn(name, F.when(F.size(col(runs)) == 0, col(base)).otherwise(F.array_sort(F.concat(col(base), likely)))).drop(base, runs)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with ``spans``: base spans and those of kind ``random``, by start; none of the latter overlaps a base span."""
    ratios = train(docs, id_col, text_col) if ratios is None else ratios
    rows, place, _ = numbered(docs)
    kept = [c for c in docs.columns if c.lower() != "spans"]
    found = _scanned(rows, F.coalesce(F.col(place(text_col)), F.lit("")), ratios, "spans")
    return found.select(*map(place, kept), "spans").toDF(*kept, "spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of every text replaced by a mark; all other columns stay."""
    ratios = train(docs, id_col, text_col)
    rows, place, back = numbered(docs)
    text = F.col(place(text_col))
    found = _scanned(rows, F.coalesce(text, F.lit("")), ratios, "spans")
    return back(found.withColumn(place(text_col), _replaced(text, F.col("spans"), lambda _: F.lit(MARK))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        of("random"),
    )
