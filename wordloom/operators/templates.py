"""Relations that etymology templates state: ancestry, cognates, mentions, components, links."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.entries import arg, templates
from wordloom.schema import AFFIXES, ANCESTRY, ANCESTRY_ALIASES, CALQUES, COGNATE, DOUBLETS, GAP_TEMPLATES, MENTIONS

KEYS = ("entry_id", "word", "lang", "lang_code")


def raw_names(types: Iterable[str]) -> list[str]:
    """The template names of canonical types, aliases included; no types stay no types."""
    return sorted({t for t in types} | {a for a, t in ANCESTRY_ALIASES.items() if t in set(types)})


def with_names(df: DataFrame, names: DataFrame, code: str, out: str) -> DataFrame:
    """``df`` with the language name of a code, the code itself where it is unknown."""
    known = names.select(F.col("lang_code").alias("__code"), F.col("lang").alias("__name"))
    return df.join(known, F.col(code) == F.col("__code"), "left").withColumn(out, F.coalesce("__name", code)).drop("__code", "__name")


def with_codes(df: DataFrame, names: DataFrame, lang: str, out: str) -> DataFrame:
    """``df`` with the code of a language name, the name itself where it is unknown; the smallest of several codes."""
    known = names.groupBy(F.col("lang").alias("__name")).agg(F.min("lang_code").alias("__code"))
    return df.join(known, F.col(lang) == F.col("__name"), "left").withColumn(out, F.coalesce("__code", lang)).drop("__code", "__name")


def ancestry_array(types: Iterable[str] = ()) -> Column:
    """array<struct<word, lang_code, type>> in template order. No types means all types."""
    names = raw_names(tuple(types) or ANCESTRY)
    kept = F.filter(templates(), lambda t: t["name"].isin(*names) & (arg(t, "2") != "") & (arg(t, "3") != ""))
    canonical = lambda name: F.coalesce(*(F.when(name == a, c) for a, c in ANCESTRY_ALIASES.items()), name)
    return F.transform(kept, lambda t: F.struct(arg(t, "3").alias("word"), arg(t, "2").alias("lang_code"), canonical(t["name"]).alias("type")))


def ancestry(entries: DataFrame, names: DataFrame, types: Iterable[str] = ()) -> DataFrame:
    """One row per ancestor: the entry's keys, ord (from 1), anc_word, anc_code, anc_lang, type."""
    rows = entries.select(*KEYS, F.posexplode(ancestry_array(types)).alias("p", "a"))
    flat = rows.select(*KEYS, (F.col("p") + 1).alias("ord"), F.col("a.word").alias("anc_word"), F.col("a.lang_code").alias("anc_code"), F.col("a.type").alias("type"))
    return with_names(flat, names, "anc_code", "anc_lang")


def cognates(entries: DataFrame, names: DataFrame) -> DataFrame:
    """One row per cognate: the entry's keys, ord, cog_word, cog_code, cog_lang."""
    kept = F.filter(templates(), lambda t: (t["name"] == COGNATE) & (arg(t, "1") != "") & (arg(t, "2") != ""))
    rows = entries.select(*KEYS, F.posexplode(kept).alias("p", "t"))
    flat = rows.select(*KEYS, (F.col("p") + 1).alias("ord"), arg(F.col("t"), "2").alias("cog_word"), arg(F.col("t"), "1").alias("cog_code"))
    return with_names(flat, names, "cog_code", "cog_lang")


def _parts(t: Column) -> Column:
    """Words of arguments 2 to 5 that are no affixes."""
    listed = F.array(*(arg(t, k) for k in ("2", "3", "4", "5")))
    return F.filter(listed, lambda w: (w != "") & ~w.startswith("-") & ~w.endswith("-"))


def component_edges(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Edges from the components of affix templates to the entry, first of each (component, code) within an entry.
    Templates in an unknown language, and entries without word or language, give none."""
    usable = entries.filter((F.coalesce("word", F.lit("")) != "") & (F.coalesce("lang", F.lit("")) != ""))
    affix = F.filter(templates(), lambda t: t["name"].isin(*AFFIXES) & (arg(t, "1") != ""))
    rows = usable.filter(F.size(affix) > 0).select(*KEYS, F.posexplode(affix).alias("p", "t"))
    parts = rows.select(*KEYS, "p", F.col("t.name").alias("source_template"), arg(F.col("t"), "1").alias("from_lang_code"), F.posexplode(_parts(F.col("t"))).alias("q", "from_word"))
    known = names.select(F.col("lang_code").alias("from_lang_code"), F.col("lang").alias("from_lang"))
    first = parts.join(known, "from_lang_code").groupBy(*KEYS, "from_word", "from_lang_code").agg(F.min_by(F.struct("from_lang", "source_template"), F.struct("p", "q")).alias("f"))
    return first.select(
        "entry_id",
        "from_word",
        F.col("f.from_lang").alias("from_lang"),
        "from_lang_code",
        F.col("word").alias("to_word"),
        F.col("lang").alias("to_lang"),
        F.col("lang_code").alias("to_lang_code"),
        F.lit("component").alias("edge_type"),
        F.col("f.source_template").alias("source_template"),
    )


def mentions(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Words that mention and affix templates name and no ancestry template does, first of each (word, code)."""
    of = lambda t, role, words: F.transform(words, lambda w: F.struct(w.alias("word"), arg(t, "1").alias("code"), t["name"].alias("source_template"), F.lit(role).alias("role")))
    named = F.transform(
        F.filter(templates(), lambda t: t["name"].isin(*MENTIONS, *AFFIXES) & (arg(t, "1") != "")),
        lambda t: F.when(t["name"].isin(*MENTIONS), of(t, "mention", F.filter(F.array(arg(t, "2")), lambda w: w != ""))).otherwise(of(t, "component", _parts(t))),
    )
    ancestors = F.transform(ancestry_array(), lambda a: F.struct(a["word"].alias("word"), a["lang_code"].alias("code")))
    free = F.filter(F.flatten(named), lambda m: ~F.array_contains(ancestors, F.struct(m["word"].alias("word"), m["code"].alias("code"))))
    rows = entries.select(*KEYS, F.posexplode(free).alias("p", "m")).select(*KEYS, "p", F.col("m.word").alias("w"), "m.code", "m.source_template", "m.role")
    flat = rows.toDF(*KEYS, "p", "mention", "mention_code", "source_template", "role")
    picked = flat.groupBy(*KEYS, "mention", "mention_code").agg(F.min_by(F.struct("source_template", "role"), "p").alias("f"), F.min("p").alias("p"))
    out = picked.select(*KEYS, "mention", "mention_code", F.col("f.source_template").alias("source_template"), F.col("f.role").alias("role"), "p")
    order = Window.partitionBy("entry_id").orderBy("p")
    return with_names(out.withColumn("ord", F.row_number().over(order)).drop("p"), names, "mention_code", "mention_lang")


def link_lookup(entries: DataFrame) -> DataFrame:
    """Linkable words of an entry and their codes: ancestry before cognates, the last of a kind; raw names only."""
    cog = F.transform(F.filter(templates(), lambda t: t["name"] == COGNATE), lambda t: F.struct(F.lit(0).alias("kind"), arg(t, "2").alias("link"), arg(t, "1").alias("code")))
    anc = F.transform(F.filter(templates(), lambda t: t["name"].isin(*ANCESTRY)), lambda t: F.struct(F.lit(1).alias("kind"), arg(t, "3").alias("link"), arg(t, "2").alias("code")))
    rows = entries.select("entry_id", F.posexplode(F.concat(cog, anc)).alias("p", "x")).select("entry_id", "p", "x.*").filter("link <> '' AND code <> ''")
    return rows.groupBy("entry_id", "link").agg(F.max_by("code", F.struct("kind", "p")).alias("code"))


def quality_flags(uncertain: Column) -> list[Column]:
    """Flags of an entry: uncertain with a chain of one step at most, compound without a chain, calque, doublet."""
    names = F.transform(templates(), lambda t: t["name"])
    has = lambda which: F.arrays_overlap(names, F.array(*map(F.lit, which)))
    steps = F.size(ancestry_array())
    return [
        (uncertain & (steps <= 1)).alias("missing_alternative_origins"),
        (has(GAP_TEMPLATES) & (steps == 0)).alias("missing_compound_components"),
        has(CALQUES).alias("missing_calques"),
        has(DOUBLETS).alias("missing_doublet_link"),
    ]
