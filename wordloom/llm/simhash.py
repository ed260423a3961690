"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has the majority bits of the XXH64 hashes of a text's three-word shingles. Two fingerprints link at two
or fewer differing bits. Each distinct fingerprint emits every variant within half that radius: itself and its 64
neighbours at one bit. Two fingerprints link exactly if they share a variant, and all that share one link to each
other, so a bucket is kept as a mask of flipped bits (fixed width, combined before the shuffle) and gives a star from
its smallest member instead of all pairs; every emitted link is verified by its distance.

Work runs on distinct fingerprints, so groups of copies of any size are one row; documents come back only in the last
join, whose hot fingerprints adaptive execution can split. Components are found by alternating large-star and
small-star steps, each written to the shared folder. A node has 2,080 possible partners at most.

``deduplicate`` asks for more: five-word shingles and a Jaccard similarity of ``SIMILAR``, at which a share of ``TURN`` of
all bits differs, so that two of 64 bits would miss nearly all. Fingerprints are therefore short, and hashed in the same
way among the texts that have an anchor in common: the smallest shingle hash under one of ``ANCHORS`` mixings, which two
texts share with a chance of their similarity. A fingerprint's length follows the number of texts at its anchor, so that
chance meetings stay few; where it gets long, several are taken (``BANDS``). An anchor of one text emits nothing. Each text
is verified with those that head one of its fingerprints, by the true similarity of the two sets of shingles, which makes
one component of most of a family of copies. That loses links: two texts can be alike that are both unlike the head, or
have no fingerprint in common. So all that is still apart is joined exactly. Two sets at ``SIMILAR`` share some of their
first shingles (``prefix``) in any order that is the same for all texts; rare ones come first, so that few texts meet. A
prefix is so long that similar sets share one of it, and with each further shingle one more: ``needed`` tells how many.
All pairs of different components that share one are compared, whatever their number, by three bounds that no similar pair
exceeds: the shingles left from there on; the parities of 256 classes of hashes, of which no more can differ than shingles
do; and how many of their prefixes they must share, as parities tell nothing of long texts, which meet by chance in a few.
What is within all is verified, for which whole sets are shuffled. Equal texts are one node.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero, which links like any other (for
``deduplicate`` their sets of shingles are equal); texts of fewer words than a shingle have the hash of the whole
sequence; equal rows are linked; null ids are never a component's id unless it has no other; tables without rows give
none; other columns are ignored by ``near_duplicates`` and kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, map_texts, materialise, numbered, sampled, scratch_path, small_batches, table
from wordloom.storage import drop, write

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Ids or nodes up to which they are broadcast (8 bytes each); beyond, a shuffle join.
BROADCAST_ROWS = 1_000_000
#: Fingerprints of a task that emits variants.
SPREAD = 50_000
#: Near duplicates of ``deduplicate``: words of a shingle, least Jaccard similarity, share of bits that differ there.
NEAR_SHINGLE, SIMILAR = 5, 0.8
TURN = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
#: Anchors of a text, each with a fingerprint of 64 bits; bits of a band beyond those that number an anchor's texts, and most bits.
ANCHORS, SPARE_BITS, MOST_BITS = 4, 6, 32
#: Chance that all bands of all anchors miss a pair at SIMILAR; most bands of an anchor.
MISSED, MOST_BANDS = 0.005, 8
#: Bits of all fingerprints up to which a text is verified with a head: the mean at SIMILAR and three deviations.
COMPARED = 64 * ANCHORS
NEAR_BITS = round(TURN * COMPARED + 3 * math.sqrt(COMPARED * TURN * (1 - TURN)))
#: Texts of a sample that tells which shingles are frequent (or a sixteenth of all texts, if more), how often they must be
#: found there, and how many are told to the tasks. These only order shingles: any order gives the same pairs.
ORDERED_BY, OFTEN, TOLD = 20_000, 4, 1 << 17
#: Words of 64 parities of a set of shingles; texts of a share, where more share a shingle: every two shares meet.
PARITIES, SHARE = 4, 4096
#: Shingles of a text for each that its prefix has beyond the first which similar texts must share.
FURTHER = 100
_STEP = 1 << 16


def _found(bits: int) -> float:
    """Chance that two fingerprints of so many bits, of texts at SIMILAR, are within the radius."""
    return sum(math.comb(bits, k) * TURN**k * (1 - TURN) ** (bits - k) for k in range(RADIUS + 1))


def _bands(bits: int) -> int:
    """Fingerprints of so many bits that an anchor needs, for all anchors together to miss no more than MISSED."""
    each = (1 - MISSED ** (1 / ANCHORS)) / SIMILAR
    return min(MOST_BANDS, max(1, math.ceil(math.log(1 - each) / math.log(1 - _found(bits)))))


#: Bands by the number of bits.
BANDS = [*[1] * (RADIUS + 1), *map(_bands, range(RADIUS + 1, MOST_BITS + 1))]


def _hashes(words: list[bytes], shingle: int, at: int, n: int) -> np.ndarray:
    """XXH64 of the shingles from ``at`` on, ``_STEP`` of ``n`` at most."""
    part = words[at : min(at + _STEP, n) + shingle - 1]
    joined = [b" ".join(words)] if n == 1 else [b" ".join(x) for x in zip(*(part[k:] for k in range(shingle)), strict=False)]
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), "<u8", len(joined))


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        ones += _ones(_hashes(words, shingle, at, n))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the NEAR_SHINGLE-word shingles of a whole text, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - NEAR_SHINGLE + 1) if words else 0
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *(_hashes(words, NEAR_SHINGLE, at, n) for at in range(0, n, _STEP))]))


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """For each anchor, the smallest of a set of hashes after a mixing of its own, and the majority bits after it."""
    anchors, prints = [], []
    for k in range(ANCHORS):
        least, ones = np.uint64((1 << 64) - 1), np.zeros(64, np.int64)
        for at in range(0, len(hashes), _STEP):
            x = hashes[at : at + _STEP] + np.uint64(((k + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            least = min(least, x.min())
            ones += _ones(x)
        anchors.append(int(least.view(np.int64)))
        prints.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return anchors, prints


def parities(hashes: np.ndarray) -> np.ndarray:
    """Is the number of hashes odd, for each class by their last bits: PARITIES longs."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fingerprint`` (long)."""
    return map_texts(docs, text_col, lambda: lambda texts: [[fingerprint(x) for x in texts]], [T.StructField("fingerprint", T.LongType())], keep)


def _flip(value: Column, bit: Column) -> Column:
    return value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))


def links(prints: DataFrame, width: Column | int = 64, by: list[str] | None = None) -> DataFrame:
    """(by, u, v), u > v: stars that connect all distinct fingerprints of ``width`` bits within the radius, among rows
    with the same ``by`` (and so the same width)."""
    one, by, width = F.lit(1).cast("long"), by or [], F.lit(width) if isinstance(width, int) else width
    tasks = math.ceil(prints.count() / SPREAD)
    spread = prints.repartition(tasks, *by, "fingerprint") if tasks > 1 else prints
    variants = spread.select(*by, "fingerprint", width.alias("width"), F.explode(F.sequence(F.lit(0), width)).alias("bit")).select(
        *by,
        F.when(F.col("bit") < F.col("width"), _flip(F.col("fingerprint"), F.col("bit"))).otherwise(F.col("fingerprint")).alias("variant"),
        F.when(F.col("bit") < F.col("width"), F.call_function("shiftleft", one, F.col("bit"))).otherwise(F.lit(0).cast("long")).alias("mask"),
        (F.col("bit") == F.col("width")).alias("own"),
    )
    buckets = variants.groupBy(*by, "variant").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).filter(F.bit_count("mask") + F.col("own").cast("int") >= 2)
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(one) == 1)
    flipped = F.transform(bits, lambda i: _flip(F.col("variant"), i))
    members = buckets.select(*by, F.when(F.col("own"), F.concat(F.array("variant"), flipped)).otherwise(flipped).alias("members"))
    star = members.select(*by, F.array_min("members").alias("v"), F.explode("members").alias("u")).filter("u > v")
    return star.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select(*by, "u", "v").distinct()


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step on edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    rest = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for every u that is not that itself."""
    spark, seen, before = edges.sparkSession, None, None
    while True:
        path = scratch_path(spark, "edges")
        edges = write(edges, path)
        if before:
            drop(spark, before)
        before = path
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            return edges
        seen = state
        edges = _round(edges).coalesce(1 + state.n // 200_000)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id (the smallest id of its component)."""
    prints = materialise(fingerprints(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), keep=["doc_id"]), "fingerprints")
    first = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(first.select("fingerprint")))
    rooted = first.join(linked, F.col("fingerprint") == F.col("u"), "left").select("fingerprint", "first", F.coalesce("v", "fingerprint").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(smallest, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def sketches(texts: DataFrame) -> DataFrame:
    """One row per distinct text of ``texts(node, doc, text)``: node, doc (the smallest), n (shingles), anchors, prints, parity."""

    def make():
        def work(batch: list[str]) -> list[list]:
            sets = [shingles(x) for x in batch]
            made = [sketch(x) for x in sets]
            return [[len(x) for x in sets], [a for a, _ in made], [p for _, p in made], [parities(x) for x in sets]]

        return work

    longs = T.ArrayType(T.LongType())
    made = map_texts(texts, "text", make, [T.StructField("n", T.LongType()), *(T.StructField(c, longs) for c in ("anchors", "prints", "parity"))], ["node", "doc"])
    return made.groupBy("node").agg(F.min("doc").alias("doc"), *(F.first(c).alias(c) for c in ("n", "anchors", "prints", "parity")))


def _bits(x: Column, y: Column) -> Column:
    """Differing bits of all fingerprints of two texts."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, n: acc + n)


def _able(a: Column, b: Column) -> Column:
    """Do the sizes and the fingerprints of two texts allow SIMILAR?"""
    return (F.least(a["n"], b["n"]) >= SIMILAR * F.greatest(a["n"], b["n"])) & (_bits(a["prints"], b["prints"]) <= NEAR_BITS)


def bands(nodes: DataFrame) -> DataFrame:
    """(group, bits, fingerprint, own): the short fingerprints of each text at each anchor that it has in common with others."""
    flat = nodes.select("node", "n", "prints", F.posexplode("anchors").alias("place", "anchor"))
    shared = flat.groupBy("place", "anchor").agg(F.count("*").alias("m")).filter("m > 1")
    bits = F.least(F.lit(MOST_BITS), F.ceil(F.log2("m")).cast("int") + SPARE_BITS)
    count = F.element_at(F.array(*map(F.lit, BANDS)), F.col("bits") + 1)
    met = flat.join(shared, ["place", "anchor"]).withColumn("bits", bits).withColumn("band", F.explode(F.sequence(F.lit(0), count - 1)))
    print_ = F.element_at("prints", (F.col("place") + F.col("band")) % ANCHORS + 1)
    cut = F.call_function("shiftright", print_, F.floor(F.col("band") / ANCHORS).cast("int") * MOST_BITS)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    return materialise(met.select(F.xxhash64("place", "anchor", "band").alias("group"), "bits", cut.bitwiseAND(mask).alias("fingerprint"), "node", "n", "prints"), "banded")


def stars(banded: DataFrame) -> DataFrame:
    """(a, b): each text and the first of those that have a fingerprint in common with it."""
    by = ["group", "fingerprint"]
    first = banded.groupBy(*by).agg(F.min(F.struct("node", "n", "prints")).alias("b"), F.count("*").alias("m")).filter("m > 1").drop("m")
    return banded.join(first, by).select(F.struct("node", "n", "prints").alias("a"), "b").filter((F.col("a.node") != F.col("b.node")) & _able(F.col("a"), F.col("b")))


def _once(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` with the node and the doc of a row of ``wanted``."""
    wanted = wanted.select(F.col("node").alias("wanted"), F.col("doc").alias("one"))
    return texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, (F.col("node") == F.col("wanted")) & F.col("doc").eqNullSafe(F.col("one")), "left_semi")


def frequent(texts: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that are frequent in a sample of the distinct texts, in order, and how often they are found there."""
    total = nodes.count()
    some = _once(texts, sampled(nodes, "node", max(ORDERED_BY, total // 16), total)).select("text")
    sets = map_texts(some, "text", lambda: lambda batch: [[shingles(x).view("<i8") for x in batch]], [T.StructField("set", T.ArrayType(T.LongType()))], [])
    counts = sets.select(F.explode("set").alias("token")).groupBy("token").count().filter(F.col("count") >= OFTEN)
    told = counts.orderBy(F.desc("count"), "token").limit(TOLD).toArrow()
    tokens, found = (told.column(c).to_numpy() for c in ("token", "count"))
    tokens = tokens.astype("<i8").view("<u8")
    order = np.argsort(tokens)
    return tokens[order], found[order].astype("<i8")


def needed(n):
    """Shingles that the prefix of a set of ``n`` has in common with that of any at SIMILAR, or the other's number if less."""
    return 1 + n // FURTHER


def prefix(hashes: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a text's shingle hashes: so many that the rest, with ``needed`` of these, is SIMILAR of all. Those among
    ``tokens`` come last, the most frequent at the end. A text without words has one of its own kind."""
    n = len(hashes)
    if not n:
        return np.zeros(1, "<u8")
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
        hashes = hashes[np.argsort(np.where(tokens[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: n - math.ceil(n * SIMILAR - 1e-3) + needed(n)]


def prefixes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, node, at): the shingles of each text's prefix that other texts have in theirs, and their places."""
    told = texts.sparkSession.sparkContext.broadcast(frequent(texts, nodes))

    def make():
        return lambda batch: [[prefix(shingles(x), *told.value).view("<i8") for x in batch]]

    made = map_texts(_once(texts, nodes), "text", make, [T.StructField("prefix", T.ArrayType(T.LongType()))], ["node"])
    same = Window.partitionBy("token")
    met = made.select("node", F.posexplode("prefix").alias("at", "token")).withColumn("least", F.min("node").over(same)).withColumn("most", F.max("node").over(same))
    return materialise(met.filter("least < most").select("token", "node", "at"), "prefixes")


def _close(lists: pa.ListArray, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the pairs of different roots, in each of some buckets, that may be at SIMILAR, and of how many shingles a
    pair must have a bucket; of each node the nearest only, if so wanted."""
    rows = lists.flatten()
    field = {name: rows.field(name).to_numpy(zero_copy_only=False) for name in ("node", "root", "n", "left", "share")}
    parity = np.stack([rows.field(f"p{k}").to_numpy(zero_copy_only=False) for k in range(PARITIES)], axis=1).view("<u8")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype("<i8")
    u, v, need = [np.zeros(0, "<i8")], [np.zeros(0, "<i8")], [np.zeros(0, "<i4")]
    for end, size in zip(np.cumsum(sizes), sizes, strict=True):
        node, root, n, left, share = (field[c][end - size : end] for c in ("node", "root", "n", "left", "share"))
        marks, two = parity[end - size : end], share.min() != share.max()
        for at in range(0, size, 256):
            part = slice(at, at + 256)
            both = n[part, None] + n
            least = np.ceil(both * (SIMILAR / (1 + SIMILAR)) - 1e-3).astype("<i8")  # shingles that two have in common at SIMILAR
            must = needed(np.minimum(n[part, None], n))
            fits = (root[part, None] != root) & (np.minimum(left[part, None], left) > least - must)
            if two:
                fits &= share[part, None] != share
            i, j = np.nonzero(fits)
            must = must[fits]
            bits = np.bitwise_count(marks[at + i] ^ marks[j]).sum(axis=1, dtype=np.int64)
            fits = bits <= both[i, j] - 2 * least[i, j]
            i, j, bits, must = at + i[fits], j[fits], bits[fits], must[fits]
            if nearest:
                order = np.lexsort((j, bits, i))
                i, j, must = i[order], j[order], must[order]
                fits = np.diff(i, prepend=-1) != 0
            else:
                fits = i < j
            u.append(np.maximum(node[i[fits]], node[j[fits]]))
            v.append(np.minimum(node[i[fits]], node[j[fits]]))
            need.append(must[fits].astype("<i4"))
    return np.concatenate(u), np.concatenate(v), np.concatenate(need)


def met_in_prefixes(shared: DataFrame, nodes: DataFrame, linked: DataFrame, nearest: bool) -> DataFrame:
    """(u, v), u > v: all pairs of texts of different components of ``linked(u, v)`` that can be at SIMILAR. ``nearest``: of
    each text and each shingle of its prefix only the pair with the fewest differing parities counts, so that some are missing.

    A shingle that more than SHARE texts have is dealt out: every two shares of its texts are a bucket."""
    same = Window.partitionBy("token")
    known = nodes.select("node", "n", *(F.element_at("parity", k + 1).alias(f"p{k}") for k in range(PARITIES)))
    rooted = shared.join(linked.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.withColumn("least", F.min("root").over(same)).withColumn("most", F.max("root").over(same)).withColumn("m", F.count("*").over(same)).filter("least < most")
    shares = F.ceil(F.col("m") / SHARE).cast("int")
    dealt = apart.select("token", "node", "root", "at", shares.alias("shares"), F.pmod(F.xxhash64("node"), shares).cast("int").alias("share"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).join(known, "node")
    row = F.struct("node", "root", "n", (F.col("n") - F.col("at")).alias("left"), "share", *(f"p{k}" for k in range(PARITIES)))
    buckets = dealt.groupBy("token", F.least("share", "other").alias("a"), F.greatest("share", "other").alias("b")).agg(F.collect_list(row).alias("rows"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _close(batch.column(0), nearest)], names=["u", "v", "need"])

    met = small_batches(buckets.filter(F.size("rows") > 1).select("rows")).mapInArrow(run, "u long, v long, need int")
    return met.groupBy("u", "v", "need").count().filter("count >= need").select("u", "v")


def verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs(u, v)`` whose sets of shingles have a Jaccard similarity of SIMILAR. Sets are made of one row of each
    text that is asked for."""
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", "doc"), "node")
    sets = map_texts(_once(texts, materialise(asked, "asked")), "text", lambda: lambda batch: [[shingles(x).view("<i8") for x in batch]], [T.StructField("set", T.ArrayType(T.LongType()))], ["node"])
    sets = materialise(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")
    for end in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}")), end)
    shared = F.size(F.array_intersect("set_u", "set_v"))
    return pairs.filter(shared >= SIMILAR * (F.size("set_u") + F.size("set_v") - shared)).select("u", "v")


def _ordered(pairs: DataFrame) -> DataFrame:
    """(u, v, bits), u > v: the distinct pairs (a, b), and how many of their bits differ."""
    return pairs.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"), _bits(F.col("a.prints"), F.col("b.prints")).alias("bits")).distinct()


def _between(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs (u, v) of different components of ``linked``."""
    for end in ("u", "v"):
        root = linked.select(F.col("u").alias(end), F.col("v").alias(f"root_{end}"))
        pairs = pairs.join(root, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.filter("root_u <> root_v").select("u", "v")


def near_components(texts: DataFrame) -> DataFrame:
    """(u, v): the smallest node of u's component, for every text of ``texts(node, doc, text)`` that is not that itself.

    First each text is compared with the nearest of those that head one of its fingerprints, then with the other ones that
    this has not joined it to: most of a family of copies becomes one component. Then all that is still apart is compared,
    the nearest pairs first, as what they join needs no more comparing."""
    nodes = materialise(sketches(texts), "nodes")
    heads = materialise(_ordered(stars(bands(nodes))), "heads")
    nearest = heads.groupBy("u").agg(F.min_by("v", F.struct("bits", "v")).alias("v"))
    found = materialise(verified(texts, nodes, nearest), "verified")
    linked = components(found)
    seen = heads.select("u", "v")
    apart = materialise(_between(seen.join(nearest, ["u", "v"], "left_anti"), linked), "apart")
    if not apart.isEmpty():
        found = found.unionByName(materialise(verified(texts, nodes, apart), "verified"))
        linked = components(found)
    shared = prefixes(texts, nodes)
    for nearest in (True, False):
        apart = materialise(met_in_prefixes(shared, nodes, linked, nearest).join(seen, ["u", "v"], "left_anti"), "apart")
        if not apart.isEmpty():
            found = found.unionByName(materialise(verified(texts, nodes, apart), "verified"))
            linked = components(found)
        seen = seen.unionByName(apart)
    return linked


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with the smallest id. Rows that share an id are
    one document, kept once; rows without an id are kept."""
    docs, place, back = numbered(docs)
    key, text = F.col(place(id_col)), F.col(place(text_col))
    texts = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("node"), key.alias("doc"), text.alias("text"))
    linked = near_components(texts)
    ids = texts.select("doc", F.col("node").alias("u")).join(linked, "u", "left").select("doc", F.coalesce("v", "u").alias("root"))
    smallest = ids.groupBy("root").agg(F.min("doc").alias("component"))
    found = materialise(ids.join(smallest, "root").select("doc", "component"), "components")
    lost = found.filter("doc <> component").select(F.col("doc").alias("lost")).distinct()
    kept = docs.join(F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost, key == F.col("lost"), "left_anti")
    if found.filter("doc IS NOT NULL").groupBy("doc").count().filter("count > 1").isEmpty():
        return back(kept)
    named = kept.filter(key.isNotNull()).dropDuplicates([place(id_col)])
    return back(named.unionByName(kept.filter(key.isNull())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
