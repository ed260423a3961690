"""Columns of one entry: glosses, sounds, summaries, page addresses, sections of the etymology text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.schema import ANCESTRY


def templates() -> Column:
    return F.coalesce(F.col("etymology_templates"), F.expr("array()").cast("array<struct<name:string,args:map<string,string>,expansion:string>>"))


def arg(template: Column, key: str) -> Column:
    """An argument of a template, "" if missing."""
    return F.coalesce(F.element_at(template["args"], key), F.lit(""))


def has_some(array: str) -> Column:
    """Is an array there, and not empty?"""
    return F.size(F.coalesce(F.col(array), F.array())) > 0


def has_template(names: Iterable[str]) -> Column:
    """Does an entry have a template of one of these names?"""
    return F.exists(templates(), lambda t: t["name"].isin(*names))


def node_id(word: Column, lang: Column) -> Column:
    return F.concat_ws(":", word, lang)


def all_glosses(senses: Column) -> Column:
    """The glosses of all senses in order; null senses or glosses count as none."""
    return F.flatten(F.transform(F.coalesce(senses, F.expr("array()").cast("array<struct<glosses:array<string>>>")), lambda s: F.coalesce(s["glosses"], F.expr("array()").cast("array<string>"))))


def first_gloss(senses: Column) -> Column:
    """The first gloss of the first sense that has glosses at all."""
    with_glosses = F.filter(senses, lambda s: s["glosses"].isNotNull())
    return F.try_element_at(F.try_element_at(with_glosses, F.lit(1))["glosses"], F.lit(1))


def first_ipa(sounds: Column) -> Column:
    return F.try_element_at(F.filter(sounds, lambda s: F.coalesce(s["ipa"], F.lit("")) != ""), F.lit(1))["ipa"]


def audio(sounds: Column) -> Column:
    """Sounds that have a recording."""
    recorded = F.filter(sounds, lambda s: s["ogg_url"].isNotNull() | s["mp3_url"].isNotNull())
    return F.transform(recorded, lambda s: F.struct(s["ogg_url"].alias("ogg_url"), s["mp3_url"].alias("mp3_url"), s["tags"].alias("tags")))


def clean_ipa(ipa: Column) -> Column:
    """Without outer delimiters, stress marks and syllable dots, in this order."""
    return F.regexp_replace(F.regexp_replace(F.trim(ipa), r"^[/\[]|[/\]]$", ""), "[ˈˌ.]", "")


def best_ipa(sounds: Column) -> Column:
    """The first IPA without tags (a missing array, not an empty one), else the first."""
    with_ipa = F.filter(sounds, lambda s: s["ipa"].isNotNull())
    untagged = F.filter(with_ipa, lambda s: s["tags"].isNull())
    return clean_ipa(F.coalesce(F.try_element_at(untagged, F.lit(1))["ipa"], F.try_element_at(with_ipa, F.lit(1))["ipa"]))


def summary() -> Column:
    """First non-empty expansion of an ancestry template, else the text: 120 characters, "" if there is neither."""
    expanded = F.filter(templates(), lambda t: t["name"].isin(*ANCESTRY) & (F.coalesce(t["expansion"], F.lit("")) != ""))
    return F.substring(F.coalesce(F.try_element_at(expanded, F.lit(1))["expansion"], F.col("etymology_text"), F.lit("")), 1, 120)


def _encoded(text: Column) -> Column:
    """Percent-encoding as browsers do it for parts of an address."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def page_url(word: Column, lang: Column) -> Column:
    base = "https://en.wiktionary.org/wiki/"
    rebuilt = F.concat(F.lit(base + "Reconstruction:"), _encoded(lang), F.lit("/"), _encoded(F.regexp_replace(word, r"^\*", "")))
    return F.when(lang.startswith("Proto-"), rebuilt).otherwise(F.concat(F.lit(base), _encoded(word), F.lit("#"), _encoded(lang)))


#: Beginnings of a line that end the tree.
PROSE_STARTS = (
    "From |Borrowed |Learned |Coined |Back-formation|A |The |Inherited |Uncertain|Originally|Perhaps|Probably|Possibly|Compare |Cf\\.|Related |See |Also "
    "|Equivalent |Compound |Blend |Variant |Alteration |Clipping |Abbreviation |Acronym |Named "
)


def sections(text: Column) -> Column:
    """struct<tree, prose, cognates>: arrays of trimmed lines, by a state that goes from line to line."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    none = F.expr("array()").cast("array<string>")
    start = F.struct(F.lit("auto").alias("at"), none.alias("tree"), none.alias("prose"), none.alias("cognates"))

    def step(acc: Column, line: Column) -> Column:
        is_tree, is_cognates = line == "Etymology tree", line.isin("Cognates", "Cognates:")
        left = (acc["at"] == "tree") & line.rlike(f"^({PROSE_STARTS})")
        now = F.when(is_tree, "tree").when(is_cognates, "cognates").when(left, "prose").when(acc["at"] == "auto", "prose").otherwise(acc["at"])
        content = ~(is_tree | is_cognates)
        grown = lambda name: F.when(content & (now == name), F.concat(acc[name], F.array(line))).otherwise(acc[name]).alias(name)
        return F.struct(now.alias("at"), grown("tree"), grown("prose"), grown("cognates"))

    return F.aggregate(lines, start, step, lambda acc: F.struct(acc["tree"], acc["prose"], acc["cognates"]))


def tree_line(line: Column) -> Column:
    """struct<lang, word> of ``word (Language)`` or ``Language word``; nulls if it is neither."""
    in_brackets = r"^(\*?\S+)\s*\((.+)\)$"
    spaced = r"^(.+) (\S*)$"
    word = F.when(line.rlike(in_brackets), F.regexp_extract(line, in_brackets, 1)).when(line.rlike(spaced), F.regexp_extract(line, spaced, 2))
    lang = F.when(line.rlike(in_brackets), F.regexp_extract(line, in_brackets, 2)).when(line.rlike(spaced), F.regexp_extract(line, spaced, 1))
    return F.struct(lang.alias("lang"), word.alias("word"))


def cognate_line(line: Column) -> Column:
    """struct<lang, word, gloss> of ``Language word ("gloss")``; nulls without a gloss, lang null for a single word."""
    bare = F.trim(F.regexp_replace(line, r"^\*\s*", ""))
    with_gloss = r'^(.+?)\s+\("(.+)"\)$'
    before = F.when(bare.rlike(with_gloss), F.regexp_extract(bare, with_gloss, 1))
    spaced = r"^(.+) (\S*)$"
    word = F.when(before.rlike(spaced), F.regexp_extract(before, spaced, 2)).otherwise(before)
    lang = F.when(before.rlike(spaced), F.regexp_extract(before, spaced, 1))
    return F.struct(lang.alias("lang"), word.alias("word"), F.when(before.isNotNull(), F.regexp_extract(bare, with_gloss, 2)).alias("gloss"))
