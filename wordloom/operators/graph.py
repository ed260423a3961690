"""Chains, descendants and trees of seed words, and measures of the graphs they form.

Graphs are two tables, ``nodes(seed_id, id, label, language, level)`` and ``edges(seed_id, from_id, to_id, label)``.
Trees are built breadth first: a node keeps the level of its first discovery (stages in the order chain, mention,
component, descendant, cognate), an edge its first label.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.entries import node_id
from wordloom.functions.languages import era_tier, family
from wordloom.functions.uncertainty import classify
from wordloom.operators import edges as component
from wordloom.operators.lookup import Dictionary, first_per, numbered_or_any, resolve
from wordloom.operators.templates import ancestry_array, cognates, mentions, with_codes, with_names
from wordloom.schema import ANCESTRY, ENTRY_ORDER
from wordloom.storage import clustered, materialise

CHILDREN = 50
#: Edges of a graph that one task holds (some 20 MB).
IN_MEMORY = 100_000
COMPONENT_ROUNDS = 3
COGNATE_ROUNDS = 2
_EDGE = ["seed_id", "from_id", "to_id", "label"]


def chains(found: DataFrame, entries: DataFrame, names: DataFrame, types: Iterable[str] = (), depth: int = 10) -> DataFrame:
    """Ancestors of resolved words. ``found`` has seed_id, word, lang, level and found_id; the result one row per
    ancestor: seed_id, word, lang, base, ord, anc_word, anc_code, anc_lang, type, id, previous."""
    own = entries.select(F.col("entry_id").alias("found_id"), "etymology_templates")
    met = found.select("seed_id", "word", "lang", F.col("level").alias("base"), "found_id").join(own, "found_id")
    steps = met.select("seed_id", "word", "lang", "base", "found_id", F.posexplode(F.slice(ancestry_array(types), 1, depth)).alias("p", "a"))
    joined = with_names(steps.select("seed_id", "word", "lang", "base", "found_id", (F.col("p") + 1).alias("ord"), F.col("a.word").alias("anc_word"), F.col("a.lang_code").alias("anc_code"), F.col("a.type").alias("type")), names, "anc_code", "anc_lang")
    own = node_id(F.col("anc_word"), F.col("anc_lang"))
    order = Window.partitionBy("seed_id", "word", "lang", "base", "found_id").orderBy("ord")
    return joined.withColumn("id", own).withColumn("previous", F.coalesce(F.lag("id").over(order), node_id(F.col("word"), F.col("lang")))).drop("found_id")


def chain_graph(found: DataFrame, entries: DataFrame, names: DataFrame, types: Iterable[str] = (), depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes (merged) and edges (not merged) of linear chains."""
    rows = chains(found, entries, names, types, depth)
    start = found.select("seed_id", node_id(F.col("word"), F.col("lang")).alias("id"), F.col("word").alias("label"), F.col("lang").alias("language"), "level")
    above = rows.select("seed_id", "id", F.col("anc_word").alias("label"), F.col("anc_lang").alias("language"), (F.col("base") - F.col("ord")).alias("level"))
    nodes = first_per(start.unionByName(above), ["seed_id", "id"], [F.desc("level"), "label"])
    return nodes, rows.select("seed_id", F.col("id").alias("from_id"), F.col("previous").alias("to_id"), F.col("type").alias("label"), "ord")


def naming(entries: DataFrame, types: Iterable[str] = ANCESTRY) -> DataFrame:
    """Entries by the parents that any of their ancestry templates names, narrow rows only: parent_word, parent_code, the
    entry's order columns, lang_code, entry_id and its first ancestor."""
    named = F.array_distinct(F.transform(ancestry_array(types), lambda a: F.struct(a["word"].alias("w"), a["lang_code"].alias("c"))))
    first = F.try_element_at(ancestry_array(types), F.lit(1))
    rows = entries.select(*ENTRY_ORDER, "lang_code", "entry_id", first.alias("first"), F.explode(named).alias("parent"))
    return rows.select(F.col("parent.w").alias("parent_word"), F.col("parent.c").alias("parent_code"), *ENTRY_ORDER, "lang_code", "entry_id", "first")


def candidates(entries: DataFrame, types: Iterable[str] = ANCESTRY) -> DataFrame:
    """The first CHILDREN entries, in a fixed order, that name a parent."""
    order = Window.partitionBy("parent_word", "parent_code").orderBy(*(F.asc_nulls_first(c) for c in ENTRY_ORDER), "entry_id")
    return naming(entries, types).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= CHILDREN)


def children(entries: DataFrame, types: Iterable[str] = ANCESTRY) -> DataFrame:
    """Immediate children of every parent: parent_word, parent_code, word, lang, lang_code, type.

    The cap comes first, then one entry per (word, lang), then the test that the parent is the entry's first ancestor:
    an entry that fails it has still used its place. No types give no children.
    """
    if not tuple(types):
        types = ("",)
    held = first_per(candidates(entries, types), ["parent_word", "parent_code", "word", "lang"], ["place"])
    own = held.filter((F.col("first.word") == F.col("parent_word")) & (F.col("first.lang_code") == F.col("parent_code")))
    return own.select("parent_word", "parent_code", "word", "lang", "lang_code", F.col("first.type").alias("type"))


def mention_edges(found: DataFrame, entries: DataFrame, names: DataFrame, types: Iterable[str] = (), known_in: Dictionary | None = None) -> DataFrame:
    """For resolved words without ancestry: existing mentioned words. seed_id, word, lang, level, mention, mention_lang, role."""
    met = entries.join(found.select(F.col("found_id").alias("entry_id")).distinct(), "entry_id", "left_semi")
    bare = met.filter(F.size(ancestry_array(types)) == 0)
    said = mentions(bare, names).select(F.col("entry_id").alias("found_id"), "mention", "mention_lang", "role")
    rows = found.select("seed_id", "word", "lang", "level", "found_id").join(said, "found_id")
    known = resolve(rows.select("mention", "mention_lang").distinct(), known_in or entries, "mention", "mention_lang").filter("found_id IS NOT NULL")
    return rows.drop("found_id").join(known.select("mention", "mention_lang"), ["mention", "mention_lang"], "left_semi")


def merge_nodes(discovered: DataFrame) -> DataFrame:
    """``discovered`` has an ``at`` (order of discovery) and ``uncertainty``: the first level wins, the first uncertainty
    that is known is kept."""
    first = F.min_by(F.struct("label", "language", "level"), F.struct("at", F.abs("level"), "level"))
    kept = F.min_by("uncertainty", F.when(F.col("uncertainty").isNotNull(), F.struct("at", F.abs("level"), "level")))
    return discovered.groupBy("seed_id", "id").agg(first.alias("f"), kept.alias("uncertainty")).select("seed_id", "id", "f.*", "uncertainty")


def merge_edges(discovered: DataFrame) -> DataFrame:
    """Directed edges once, with the label found first."""
    return discovered.groupBy("seed_id", "from_id", "to_id").agg(F.min_by("label", F.struct("at", "label")).alias("label")).select(*_EDGE)


class Trees:
    """Builds the trees of many seeds together, round by round. Every round is written to the shared folder. What a round
    finds is compared with one table of all edges so far, to which only what is new is added; the dictionary and this table
    are dealt out in buckets, so a round shuffles its own rows only."""

    def __init__(self, entries: DataFrame | Dictionary, components: DataFrame, names: DataFrame, types: Iterable[str] = ("inh",), max_ancestors: int = 10, max_descendants: int = 3):
        asked = [t for t in types if t in (*ANCESTRY, "cog")]
        self.types = tuple(t for t in asked if t != "cog")
        if not asked:
            self.types = ("inh",)
        self.with_cognates = "cog" in asked
        self.dictionary = entries if isinstance(entries, Dictionary) else Dictionary(entries)
        self.facts, self.names = self.dictionary.facts, names
        there = components.filter("from_exists").select("to_word", "to_lang", "from_word", "from_lang", "edge_type").distinct()
        self.components, _ = clustered(there.withColumn("from_exists", F.lit(True)), "components", "to_word", "to_lang")
        self.depth, self.down = max_ancestors, max_descendants
        self.children = clustered(children(self.facts, self.types), "children", "parent_word", "parent_code")[0] if self.types else None
        self.nodes: list[DataFrame] = []
        self.visited: DataFrame | None = None
        self._name: str | None = None
        self.at = 0

    def _node(self, rows: DataFrame, word: str, lang: str, level: Column, uncertainty: Column | None = None) -> None:
        none = F.lit(None).cast("struct<is_uncertain:boolean,type:string,source:string,confidence:string>")
        self.nodes.append(
            rows.select("seed_id", node_id(F.col(word), F.col(lang)).alias("id"), F.col(word).alias("label"), F.col(lang).alias("language"), level.alias("level"), F.lit(self.at).alias("at"), (none if uncertainty is None else uncertainty).alias("uncertainty"))
        )

    def _edge(self, rows: DataFrame) -> DataFrame:
        """Add the edges that are new to those visited; gives their rows. Of an edge found twice in a round, the smallest
        label and the level nearest to the seed's count."""
        level = [F.abs("level"), "level"] if "level" in rows.columns else []
        rows = first_per(rows, _EDGE[:3], ["label", *level])
        if self.visited is not None:
            rows = rows.join(self.visited.select(*_EDGE[:3]), _EDGE[:3], "left_anti")
        rows = materialise(rows)
        if not rows.isEmpty():
            self.visited, self._name = clustered(rows.select(*_EDGE, F.lit(self.at).alias("at")), "visited", *_EDGE[:3], onto=self._name)
        self.at += 1
        return rows

    def _chain(self, found: DataFrame) -> DataFrame:
        """Adds the chains; gives all their words, the first one included: seed_id, word, lang, code, level."""
        rows = materialise(chains(found, self.facts, self.names, self.types, self.depth))
        self._node(rows, "anc_word", "anc_lang", F.col("base") - F.col("ord"))
        self._edge(rows.select("seed_id", F.col("id").alias("from_id"), F.col("previous").alias("to_id"), F.col("type").alias("label")))
        start = with_codes(found.select("seed_id", "word", "lang", "level"), self.names, "lang", "code")
        above = rows.select("seed_id", F.col("anc_word").alias("word"), F.col("anc_lang").alias("lang"), (F.col("base") - F.col("ord")).alias("level"), F.col("anc_code").alias("code"))
        return materialise(start.unionByName(above).distinct())

    def _expand(self, wanted: DataFrame, skip: DataFrame | None) -> None:
        """``wanted``: seed_id, word, lang, level, etym."""
        located = numbered_or_any(wanted, self.dictionary)
        about = self.facts.select(F.col("entry_id").alias("found_id"), "etymology_text", "etymology_templates")
        found = located.join(about, "found_id", "left").withColumn("c", classify()).drop("etymology_text", "etymology_templates")
        found = materialise(found)
        self._node(found, "word", "lang", F.col("level"), F.when(F.col("c.is_uncertain"), F.col("c")))
        found = found.filter("found_id IS NOT NULL")
        chain = self._chain(found)

        said = materialise(mention_edges(found, self.facts, self.names, self.types, self.dictionary))
        self._node(said, "mention", "mention_lang", F.col("level") - 1)
        self._edge(said.select("seed_id", node_id(F.col("mention"), F.col("mention_lang")).alias("from_id"), node_id(F.col("word"), F.col("lang")).alias("to_id"), F.col("role").alias("label")))

        words = chain
        for left in range(COMPONENT_ROUNDS, 0, -1):
            parts = component.leading_to(words.select("seed_id", "word", "lang", "level"), self.components)
            self._node(parts, "from_word", "from_lang", F.col("level") - 1)
            new = self._edge(parts.select("seed_id", node_id(F.col("from_word"), F.col("from_lang")).alias("from_id"), node_id(F.col("word"), F.col("lang")).alias("to_id"), F.col("edge_type").alias("label"), "from_word", "from_lang", "level"))
            if left == 1 or new.isEmpty():
                break
            traced = new.select("seed_id", F.col("from_word").alias("word"), F.col("from_lang").alias("lang"), (F.col("level") - 1).alias("level")).distinct()
            words = self._chain(resolve(traced, self.dictionary).filter("found_id IS NOT NULL"))

        if self.children is not None:
            self.descend(chain, skip)

    def descend(self, chain: DataFrame, skip: DataFrame | None = None) -> None:
        """Adds the children of ``chain(seed_id, word, lang, code, level)`` and theirs, but none of the ``skip(seed_id, id)``."""

        def allowed(rows: DataFrame) -> DataFrame:
            return rows if skip is None else rows.withColumn("id", node_id(F.col("word"), F.col("lang"))).join(skip, ["seed_id", "id"], "left_anti").drop("id")

        frontier = allowed(chain)
        for _ in range(self.down):
            below = self.children.select(F.col("parent_word").alias("word"), F.col("parent_code").alias("code"), F.col("word").alias("child"), F.col("lang").alias("child_lang"), F.col("lang_code").alias("child_code"), "type")
            met = frontier.join(below, ["word", "code"])
            self._node(met, "child", "child_lang", F.col("level") + 1)
            new = self._edge(met.select("seed_id", node_id(F.col("word"), F.col("lang")).alias("from_id"), node_id(F.col("child"), F.col("child_lang")).alias("to_id"), F.col("type").alias("label"), "child", "child_lang", "child_code", "level"))
            if new.isEmpty():
                return
            frontier = allowed(new.select("seed_id", F.col("child").alias("word"), F.col("child_lang").alias("lang"), F.col("child_code").alias("code"), (F.col("level") + 1).alias("level")))

    def edges(self) -> DataFrame:
        """All edges so far: seed_id, from_id, to_id, label."""
        if self.visited is None:
            return self.facts.sparkSession.createDataFrame([], "seed_id string, from_id string, to_id string, label string")
        return merge_edges(self.visited)

    def _merged(self) -> DataFrame:
        """All nodes so far, each as it was found first."""
        return materialise(merge_nodes(reduce(DataFrame.unionByName, self.nodes)))

    def build(self, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``seeds``: seed_id, word, lang and maybe etym. Gives merged nodes and edges. A seed that is no word is one node;
        descendants of a seed with etym are left out, as templates do not say which etymology they mean."""
        wanted = seeds.withColumn("level", F.lit(0))
        if "etym" not in seeds.columns:
            wanted = wanted.withColumn("etym", F.lit(None).cast("int"))
        skip = materialise(wanted.filter("etym IS NOT NULL").select("seed_id", node_id(F.col("word"), F.col("lang")).alias("id")))
        self._expand(wanted, skip)
        nodes = self._merged()
        done = None
        for _ in range(COGNATE_ROUNDS if self.with_cognates else 0):
            fresh = nodes if done is None else nodes.join(done, ["seed_id", "id"], "left_anti")
            located = resolve(fresh.select("seed_id", "id", "level", F.col("label").alias("word"), F.col("language").alias("lang")), self.dictionary).filter("found_id IS NOT NULL")
            located = materialise(located.select("seed_id", "id", "level", "found_id"))
            met = self.facts.join(located.select(F.col("found_id").alias("entry_id")).distinct(), "entry_id", "left_semi")
            cogs = cognates(met, self.names).select(F.col("entry_id").alias("found_id"), "cog_word", "cog_lang")
            met = materialise(located.join(cogs, "found_id").withColumn("cog_id", node_id(F.col("cog_word"), F.col("cog_lang"))))
            done = nodes.select("seed_id", "id")
            self._edge(met.select("seed_id", F.col("id").alias("from_id"), F.col("cog_id").alias("to_id"), F.lit("cog").alias("label")))
            new = met.select("seed_id", F.col("cog_word").alias("word"), F.col("cog_lang").alias("lang"), "level", F.col("cog_id").alias("id")).join(done, ["seed_id", "id"], "left_anti")
            new = materialise(first_per(new, ["seed_id", "id"], [F.abs("level"), "level"]).drop("id").withColumn("etym", F.lit(None).cast("int")))
            if new.isEmpty():
                break
            self._expand(new, skip)
            nodes = self._merged()
        return nodes, self.edges()


# Measures of graphs.


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from either end: seed_id, id, other, label."""
    out = edges.select("seed_id", F.col("from_id").alias("id"), F.col("to_id").alias("other"), "label")
    return out.unionByName(edges.select("seed_id", F.col("to_id").alias("id"), F.col("from_id").alias("other"), "label"))


def _within_task(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``hop_distances`` of graphs that one task can hold, each walked through in memory."""

    def walk(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        others: dict[str, list[str]] = defaultdict(list)
        for a, b in zip(links["from_id"], links["to_id"], strict=True):
            others[a].append(b)
            others[b].append(a)
        hops = dict.fromkeys(own["id"], 0)
        frontier = list(hops)
        while frontier:
            frontier = [b for a in frontier for b in others[a] if hops.setdefault(b, hops[a] + 1) == hops[a] + 1]
            frontier = list(dict.fromkeys(frontier))
        seeds = [own["seed_id"].iloc[0]] * len(hops) if hops else []
        return pd.DataFrame({"seed_id": seeds, "id": list(hops), "hops": list(hops.values())})

    return starts.groupBy("seed_id").cogroup(edges.groupBy("seed_id")).applyInPandas(walk, "seed_id string, id string, hops int")


def hop_distances(starts: DataFrame, edges: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """(seed_id, id, hops) from the start (seed_id, id) over undirected edges, until nothing new is reached.

    A graph of ``in_memory`` edges or fewer is walked through within its task, all such graphs in one job. Larger ones are
    walked together by joins, a round for each hop; rounds are added to one table of all that is reached."""
    starts = starts.select("seed_id", "id").distinct()
    links = edges.select("seed_id", F.least("from_id", "to_id").alias("from_id"), F.greatest("from_id", "to_id").alias("to_id")).filter("from_id < to_id").distinct()
    large = links.groupBy("seed_id").agg(F.count("*").alias("n")).filter(F.col("n") > in_memory).select("seed_id")
    if large.isEmpty():
        return _within_task(starts, links)
    large, links = materialise(large), materialise(links)
    few = _within_task(starts.join(large, "seed_id", "left_anti"), links.join(large, "seed_id", "left_anti"))
    steps = links.unionByName(links.select("seed_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    steps, _ = clustered(steps.join(large, "seed_id", "left_semi"), "steps", "seed_id", "from_id")
    frontier = materialise(starts.join(large, "seed_id", "left_semi").withColumn("hops", F.lit(0)))
    reached, name = clustered(frontier, "reached", "seed_id", "id")
    k = 0
    while not frontier.isEmpty():
        k += 1
        new = frontier.join(steps, (frontier["seed_id"] == steps["seed_id"]) & (frontier["id"] == steps["from_id"])).select(frontier["seed_id"], F.col("to_id").alias("id")).distinct()
        frontier = materialise(new.join(reached.select("seed_id", "id"), ["seed_id", "id"], "left_anti").withColumn("hops", F.lit(k)))
        reached, _ = clustered(frontier, "reached", "seed_id", "id", onto=name)
    return few.unionByName(reached)


def neighbours(focus: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct neighbours of focus nodes (seed_id, id)."""
    return both_ways(edges).join(focus.select("seed_id", "id"), ["seed_id", "id"], "left_semi").select("seed_id", "id", "other").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("seed_id", "id").agg(F.count("*").alias("degree"))


def roots(nodes: DataFrame) -> DataFrame:
    """The etymological root of each graph: the node of least level, the smallest id on ties."""
    return nodes.groupBy("seed_id").agg(F.min_by("id", F.struct("level", "id")).alias("root"))


def centres(edges: DataFrame) -> DataFrame:
    """The node of highest degree, the smallest id on ties."""
    return degrees(edges).groupBy("seed_id").agg(F.min_by("id", F.struct(-F.col("degree"), "id")).alias("centre"))


def edge_lengths(edges: DataFrame, similarity: str | None = None) -> DataFrame:
    """``edges`` with degree_sum, degree_max and length; ``similarity`` names the column of similarity edges."""
    d = degrees(edges)
    a, b = d.select("seed_id", F.col("id").alias("from_id"), F.col("degree").alias("__a")), d.select("seed_id", F.col("id").alias("to_id"), F.col("degree").alias("__b"))
    joined = edges.join(a, ["seed_id", "from_id"]).join(b, ["seed_id", "to_id"])
    total = F.col("__a") + F.col("__b")
    plain = 110 + 50 * F.log2(1 + total)
    length = plain if similarity is None else F.when(F.col(similarity).isNull(), plain).otherwise(250 - 200 * F.col(similarity) + 40 * F.log2(1 + total))
    return joined.withColumns({"degree_sum": total, "degree_max": F.greatest("__a", "__b"), "length": length}).drop("__a", "__b")


def with_family(nodes: DataFrame) -> DataFrame:
    """``nodes`` with family and tier, worked out once per language."""
    known = nodes.select("language").distinct().withColumns({"family": family(F.col("language")), "tier": era_tier(F.col("language"))})
    return nodes.join(known, "language")


def families(nodes: DataFrame, collapse: int = 2) -> DataFrame:
    """Nodes per family, and whether the family is collapsed."""
    return with_family(nodes).groupBy("seed_id", "family").agg(F.count("*").alias("nodes")).withColumn("collapsed", F.col("nodes") >= collapse)


def tiers(nodes: DataFrame) -> DataFrame:
    return with_family(nodes).groupBy("seed_id", "tier", "family").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def connections(edges: DataFrame) -> DataFrame:
    """Per node and edge label, the nodes at the other end."""
    return both_ways(edges).groupBy("seed_id", "id", "label").agg(F.sort_array(F.collect_list("other")).alias("others"))


def fingerprints(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(seed_id, hash) of a node set, or of nodes and edges, whatever their order."""
    n = nodes.groupBy("seed_id").agg(F.array_join(F.sort_array(F.collect_set("id")), "\n").alias("n"))
    if edges is None:
        return n.select("seed_id", F.sha2("n", 256).alias("hash"))
    e = edges.groupBy("seed_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\t", "from_id", "to_id", "label"))), "\n").alias("e"))
    return n.join(e, "seed_id", "left").select("seed_id", F.sha2(F.concat_ws("\n\n", "n", F.coalesce("e", F.lit(""))), 256).alias("hash"))
