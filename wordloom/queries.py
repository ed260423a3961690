"""Every operator over the lexicon that the test tables give, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import entries as fe
from wordloom.functions import similarity as sim
from wordloom.functions import uncertainty
from wordloom.functions.languages import ERAS, FAMILIES, era_tier, family
from wordloom.functions.normalise import fold, normalise, strip_stars
from wordloom.functions.phonetics import sound_classes
from wordloom.operators import audit, concepts, edges, graph, lookup, templates
from wordloom.schema import AFFIXES
from wordloom.sources import lexicon, tables
from wordloom.storage import read_published, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = lexicon.oracle(sql)
        return f

    return add


def _lex(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries and the names of languages."""
    entries = lexicon.entries(spark, sf_dir)
    return entries, lexicon.once(spark, sf_dir, "names", lambda: tables.language_names(entries))


# SQL fragments, each a list of common table expressions.
ANC = """, anc AS (
  SELECT t.entry_id, e.word, e.lang, e.lang_code, e.pos, e.etym, row_number() OVER (PARTITION BY t.entry_id ORDER BY p) AS ord, a3 AS anc_word, a2 AS anc_code,
         coalesce(n.name, a2) AS anc_lang, CASE WHEN t.name = 'derived' THEN 'der' ELSE t.name END AS type
  FROM tmpl t JOIN ent e USING (entry_id) LEFT JOIN names n ON n.code = a2 WHERE t.name IN ('inh', 'bor', 'der', 'derived'))
"""
ONE = """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, lang ORDER BY pos NULLS FIRST, etym NULLS FIRST, entry_id) AS k FROM ent) WHERE k = 1)
"""
EVERY = ONE + f""", seeds AS (SELECT lc || ':' || word AS seed_id, word, {lexicon._NAME.format('lc')} AS lang, lc AS code FROM wc)
"""
SEEDS = ONE + f""", seeds AS (SELECT lc || ':' || word AS seed_id, word, {lexicon._NAME.format('lc')} AS lang, lc AS code FROM wc
  WHERE length(word) >= {lexicon.SEED_LENGTH} AND left(md5(lc || ':' || word), 2) < '{lexicon.SEED_MD5}')
"""
NORM = "strip_accents(regexp_replace({}, '^\\*', ''))"
COMP = """, comp AS (
  SELECT entry_id, from_word, x.code AS from_lang_code, name AS from_lang, to_word, to_lang, to_lang_code, tname AS source_template,
         row_number() OVER (PARTITION BY entry_id, from_word, x.code ORDER BY p, q) AS k
  FROM (SELECT t.entry_id, e.word AS to_word, e.lang AS to_lang, e.lang_code AS to_lang_code, t.name AS tname, p, a1 AS code, unnest([1, 2, 3]) AS q, unnest([a2, a3, a4]) AS from_word
        FROM tmpl t JOIN ent e USING (entry_id) WHERE t.name IN ('af', 'compound')) x JOIN names ON names.code = x.code
  WHERE coalesce(from_word, '') <> '' AND NOT starts_with(from_word, '-') AND NOT ends_with(from_word, '-')),
compx AS (
  SELECT c.*, w.word IS NOT NULL OR v.word IS NOT NULL AS from_exists FROM comp c
  LEFT JOIN (SELECT DISTINCT word, lang FROM ent) w ON w.word = from_word AND w.lang = from_lang
  LEFT JOIN (SELECT DISTINCT word, lang FROM ent) v ON v.word = strip_accents(from_word) AND v.lang = from_lang WHERE k = 1)
"""
_CHAIN = """, chain AS (
  SELECT s.seed_id, s.word, s.lang, ord, anc_word, anc_code, anc_lang, type, anc_word || ':' || anc_lang AS id,
         coalesce(lag(anc_word || ':' || anc_lang) OVER (PARTITION BY s.seed_id ORDER BY ord), s.word || ':' || s.lang) AS previous
  FROM seeds s JOIN one o USING (word, lang) JOIN anc ON anc.entry_id = o.entry_id),
chain_nodes AS (
  SELECT seed_id, word, lang, code, 0 AS level FROM seeds UNION SELECT seed_id, anc_word, anc_lang, anc_code, CAST(-ord AS INT) FROM chain)
"""
CHAIN, EVERY_CHAIN = ANC + SEEDS + _CHAIN, ANC + EVERY + _CHAIN
KIDS = """, cand AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pw, pc ORDER BY word NULLS FIRST, lang NULLS FIRST, pos NULLS FIRST, etym NULLS FIRST, entry_id) AS place
    FROM (SELECT DISTINCT anc_word AS pw, anc_code AS pc, word, lang, pos, etym, lang_code, entry_id FROM anc)) WHERE place <= 50),
kids AS (
  SELECT pw, pc, c.word, c.lang, c.lang_code, a.type FROM (SELECT *, row_number() OVER (PARTITION BY pw, pc, word, lang ORDER BY place) AS k FROM cand) c
  JOIN anc a ON a.entry_id = c.entry_id AND a.ord = 1 AND a.anc_word = pw AND a.anc_code = pc WHERE k = 1)
"""
GRAPH = CHAIN + KIDS + """, ge0 AS (
  SELECT seed_id, id AS from_id, previous AS to_id, type AS label, 0 AS found FROM chain
  UNION ALL SELECT seed_id, n.word || ':' || n.lang, k.word || ':' || k.lang, k.type, 1 FROM chain_nodes n JOIN kids k ON k.pw = n.word AND k.pc = n.code),
g_edges AS (SELECT seed_id, from_id, to_id, arg_min(label, found) AS label FROM ge0 GROUP BY ALL),
gn0 AS (
  SELECT seed_id, word || ':' || lang AS id, lang AS language, level, 0 AS found FROM chain_nodes
  UNION ALL SELECT seed_id, k.word || ':' || k.lang, k.lang, level + 1, 1 FROM chain_nodes n JOIN kids k ON k.pw = n.word AND k.pc = n.code),
g_nodes AS (SELECT seed_id, id, min(language) AS language, first(level ORDER BY found, abs(level), level) AS level FROM gn0 GROUP BY seed_id, id),
both_ways AS (SELECT seed_id, from_id AS id, to_id AS other, label FROM g_edges UNION ALL SELECT seed_id, to_id, from_id, label FROM g_edges)
"""
PHON = f""", phon AS (
  SELECT entry_id, word, lang, lang_code, pos, etym, ipa, {lexicon.CLASSES.format('ipa')} AS classes FROM ent WHERE has_sounds),
voiced AS (
  SELECT *, replace(classes, 'V', '') AS cons, left(replace(classes, 'V', ''), 2) AS first2
  FROM (SELECT *, row_number() OVER (PARTITION BY word, lang ORDER BY pos NULLS FIRST, etym NULLS FIRST, entry_id) AS k FROM phon WHERE ipa IS NOT NULL) WHERE k = 1)
"""
MEMB = PHON + """, hub AS (SELECT DISTINCT concept_word AS concept FROM trans),
asked AS (SELECT DISTINCT hub AS concept FROM hubs),
by_hub AS (
  SELECT concept, entry_id, word, lang FROM (SELECT DISTINCT concept_word AS concept, word, lang FROM trans UNION SELECT concept, concept, 'English' FROM hub) JOIN voiced USING (word, lang)),
counted AS (SELECT concept, coalesce(n, 0) AS n, hub.concept IS NOT NULL AS has_hub FROM asked LEFT JOIN (SELECT concept, count(*) AS n FROM by_hub GROUP BY concept) USING (concept) LEFT JOIN hub USING (concept)),
glossed AS (SELECT entry_id, word, lang, gloss FROM (
  SELECT entry_id, lower('gloss of ' || word) AS gloss FROM body UNION SELECT entry_id, lower('second of ' || word) FROM body
  UNION SELECT entry_id, lower(hub) FROM body WHERE r IS NOT NULL AND r % 10 IN (1, 2)) JOIN voiced USING (entry_id)),
by_gloss AS (SELECT DISTINCT a.concept, entry_id, word, lang FROM asked a JOIN glossed g ON g.gloss = lower(a.concept)),
added AS (
  SELECT g.* FROM by_gloss g JOIN counted c ON c.concept = g.concept AND c.n < 10
  WHERE NOT EXISTS (SELECT 1 FROM by_hub h WHERE h.concept = g.concept AND h.word = g.word AND h.lang = g.lang)),
resolved AS (
  SELECT m.*, CASE WHEN n >= 10 THEN 'translation_hub' WHEN has_hub THEN 'combined' ELSE 'gloss_search' END AS method
  FROM (SELECT * FROM by_hub UNION ALL SELECT * FROM added) m JOIN counted USING (concept)),
cwords AS (SELECT r.concept, v.word || ':' || v.lang AS id, v.* FROM resolved r JOIN voiced v USING (entry_id))
"""
VERBS = MEMB.replace("FROM phon WHERE ipa IS NOT NULL", "FROM phon WHERE ipa IS NOT NULL AND pos = 'verb'")
PAIRS = MEMB + """, pr AS (
  SELECT a.concept, a.id AS source, b.id AS target, a.cons AS ca, b.cons AS cb,
         1 - levenshtein(a.cons, b.cons) / greatest(length(a.cons), length(b.cons)) AS sim,
         length(a.first2) >= 2 AND a.first2 = b.first2 AS turchin_match
  FROM cwords a JOIN cwords b ON a.concept = b.concept AND a.id < b.id WHERE a.cons <> '' AND b.cons <> ''),
pe AS (
  SELECT concept, source, target, round_even(sim::DOUBLE, 3) AS similarity, turchin_match,
         left(ca, coalesce(list_max(list_filter(range(1, least(length(ca), length(cb)) + 1), lambda n: left(ca, n) = left(cb, n))), 0)::INT) AS shared_classes
  FROM pr WHERE sim >= 0.3 OR turchin_match)
"""
LINKS = MEMB + """, cl AS (
  SELECT DISTINCT r.concept, r.word || ':' || r.lang AS source, m.word || ':' || m.lang AS target
  FROM resolved r JOIN tmpl t ON t.entry_id = r.entry_id AND t.name = 'cog' JOIN resolved m ON m.concept = r.concept AND m.word = t.a2
  WHERE r.word || ':' || r.lang <> m.word || ':' || m.lang),
ml AS (
  SELECT DISTINCT r.concept, r.word || ':' || r.lang AS source, m.word || ':' || m.lang AS target
  FROM resolved r JOIN ent e ON e.entry_id = r.entry_id JOIN resolved m ON m.concept = r.concept AND length(m.word) >= 3 AND contains(e.etymology_text, m.word)
  WHERE r.word || ':' || r.lang <> m.word || ':' || m.lang),
el AS (
  SELECT concept, source, target, relationship FROM (
    SELECT *, row_number() OVER (PARTITION BY concept, least(source, target), greatest(source, target) ORDER BY source, k, target) AS n
    FROM (SELECT *, 0 AS k, 'cognate' AS relationship FROM cl UNION ALL SELECT *, 1, 'mentioned' FROM ml)) WHERE n = 1)
"""


# Sources and sinks.


@query("a01_parse_lines", "SELECT word, lang, lang_code, pos, etym AS etymology_number, etymology_text FROM ent")
def a01(spark, sf_dir):
    entries = lexicon.entries(spark, sf_dir)
    lines = entries.select(F.concat(F.lit("  "), F.to_json(F.struct(*[c for c in entries.columns if c != "entry_id"]))).alias("value"))
    noise = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("value"))
    broken = noise.unionByName(noise.select(F.concat(F.lit("{"), "value").alias("value"))).unionByName(noise.select(F.lit(" ").alias("value")))
    return tables.parse_lines(lines.unionByName(broken)).select("word", "lang", "lang_code", "pos", "etymology_number", "etymology_text")


@query("a02_word_table", "SELECT entry_id, word, lang, pos FROM ent")
def a02(spark, sf_dir):
    path = scratch_path(spark, "words")
    tables.write_entries(lexicon.entries(spark, sf_dir), path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_published(spark, path).select("entry_id", "word", "lang", "pos")


@query("a03_languages", "SELECT DISTINCT lang_code, lang FROM ent")
def a03(spark, sf_dir):
    return tables.languages(lexicon.entries(spark, sf_dir))


@query("a04_component_table", COMP + "SELECT entry_id, from_word, from_lang, to_word, to_lang, source_template, from_exists FROM compx")
def a04(spark, sf_dir):
    entries, names = _lex(spark, sf_dir)
    path = scratch_path(spark, "component_edges")
    found = edges.with_existence(templates.component_edges(entries, names), entries)
    tables.write_component_edges(found, path, reprocess=True)
    tables.write_component_edges(found.limit(0), path)  # there are some: left alone
    return read_published(spark, path).select("entry_id", "from_word", "from_lang", "to_word", "to_lang", "source_template", "from_exists")


@query("a05_new_phonetics", PHON + "SELECT entry_id, ipa, classes AS dolgo_classes, replace(classes, 'V', '') AS dolgo_consonants FROM phon WHERE length(word) % 2 = 1")
def a05(spark, sf_dir):
    entries = lexicon.entries(spark, sf_dir)
    done = entries.filter(F.length("word") % 2 == 0).select("entry_id")
    return tables.missing_phonetics(entries, done).select("entry_id", "ipa", "dolgo_classes", "dolgo_consonants")


def _chain(spark, sf_dir, types=(), seeds=lexicon.seeds):
    entries, names = _lex(spark, sf_dir)
    found = lookup.resolve(seeds(spark, sf_dir), entries).withColumn("level", F.lit(0))
    return found, entries, names, *graph.chain_graph(found, entries, names, types)


def _graph(spark, sf_dir):
    """Chains of the seeds and the children of all their words."""
    found, entries, names, nodes, links = _chain(spark, sf_dir)
    coded = templates.with_codes(nodes, names, "language", "code")
    below = graph.children(entries).select(F.col("parent_word").alias("label"), F.col("parent_code").alias("code"), F.col("word").alias("child"), F.col("lang").alias("child_lang"), "type")
    met = coded.join(below, ["label", "code"])
    child = fe.node_id(F.col("child"), F.col("child_lang"))
    none = F.lit(None).cast("string")
    more = met.select("seed_id", child.alias("id"), F.col("child").alias("label"), F.col("child_lang").alias("language"), (F.col("level") + 1).alias("level"), F.lit(1).alias("at"), none.alias("uncertainty"))
    all_nodes = graph.merge_nodes(nodes.withColumns({"at": F.lit(0), "uncertainty": none}).unionByName(more))
    all_edges = graph.merge_edges(links.drop("ord").withColumn("at", F.lit(0)).unionByName(met.select("seed_id", F.col("id").alias("from_id"), child.alias("to_id"), F.col("type").alias("label"), F.lit(1).alias("at"))))
    return all_nodes, all_edges


@query("a06_graphs", GRAPH + "SELECT seed_id, nodes, coalesce(edges, '') AS edges FROM (SELECT seed_id, string_agg(level || ' ' || id, '|' ORDER BY level, id) AS nodes FROM g_nodes GROUP BY 1) LEFT JOIN (SELECT seed_id, string_agg(from_id || ' ' || to_id || ' ' || label, '|' ORDER BY from_id, to_id) AS edges FROM g_edges GROUP BY 1) USING (seed_id)")
def a06(spark, sf_dir):
    path = scratch_path(spark, "graphs")
    tables.write_graphs(*_graph(spark, sf_dir), path)
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat_ws(" ", n["level"].cast("string"), n["id"])), "|")
    links = F.array_join(F.transform("edges", lambda e: F.concat_ws(" ", e["from"], e["to"], e["label"])), "|")
    return spark.read.json(path).select("seed_id", nodes.alias("nodes"), links.alias("edges"))


# Templates and text.


@query("b01_ancestry", ANC + "SELECT entry_id, ord, anc_word, anc_code, anc_lang, type FROM anc")
def b01(spark, sf_dir):
    return templates.ancestry(*_lex(spark, sf_dir)).select("entry_id", F.col("ord").cast("long").alias("ord"), "anc_word", "anc_code", "anc_lang", "type")


@query("b02_type_names", "SELECT name, count(*) AS n FROM tmpl WHERE name IN ('der', 'derived', 'inh') GROUP BY name")
def b02(spark, sf_dir):
    rows = lexicon.entries(spark, sf_dir).select(F.explode(fe.templates()).alias("t")).select("t.name")
    return rows.filter(F.col("name").isin(*templates.raw_names(["inh", "der"]))).groupBy("name").agg(F.count("*").alias("n"))


@query("b03_cognates", "SELECT t.entry_id, a2 AS cog_word, a1 AS cog_code, coalesce(n.name, a1) AS cog_lang FROM tmpl t LEFT JOIN names n ON n.code = a1 WHERE t.name = 'cog'")
def b03(spark, sf_dir):
    return templates.cognates(*_lex(spark, sf_dir)).select("entry_id", "cog_word", "cog_code", "cog_lang")


@query("b04_node_ids", "SELECT DISTINCT word || ':' || lang AS id FROM ent")
def b04(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select(fe.node_id(F.col("word"), F.col("lang")).alias("id")).distinct()


@query("b05_language_names", "SELECT DISTINCT a2 AS code, coalesce(n.name, a2) AS name, coalesce(m.code, coalesce(n.name, a2)) AS code_again FROM tmpl LEFT JOIN names n ON n.code = a2 LEFT JOIN names m ON m.name = coalesce(n.name, a2) WHERE tmpl.name IN ('inh', 'bor', 'der', 'derived', 'af')")
def b05(spark, sf_dir):
    entries, names = _lex(spark, sf_dir)
    rows = entries.select(F.explode(fe.templates()).alias("t")).filter(F.col("t.name").isin("inh", "bor", "der", "derived", "af")).select(fe.arg(F.col("t"), "2").alias("code")).distinct()
    return templates.with_codes(templates.with_names(rows, names, "code", "name"), names, "name", "code_again")


@query("b06_normalise", f"SELECT DISTINCT a3 AS form, {NORM.format('a3')} AS headword FROM tmpl WHERE name IN ('inh', 'bor', 'der', 'derived')")
def b06(spark, sf_dir):
    forms = templates.ancestry(*_lex(spark, sf_dir)).select(F.col("anc_word").alias("form")).distinct()
    return normalise(forms, "form", "headword")


@query("b07_variants", "SELECT DISTINCT a3 AS form, regexp_replace(a3, '^\\*+', '') AS no_star, strip_accents(a3) AS no_accents, strip_accents(regexp_replace(a3, '^\\*+', '')) AS neither FROM tmpl WHERE name IN ('inh', 'bor', 'der', 'derived')")
def b07(spark, sf_dir):
    forms = templates.ancestry(*_lex(spark, sf_dir)).select(F.col("anc_word").alias("form")).distinct().withColumn("no_star", strip_stars(F.col("form")))
    return fold(fold(forms, "form", "no_accents"), "no_star", "neither")


@query("b08_component_edges", COMP + "SELECT entry_id, from_word, from_lang, from_lang_code, to_word, to_lang, to_lang_code, 'component' AS edge_type, source_template FROM comp WHERE k = 1")
def b08(spark, sf_dir):
    return templates.component_edges(*_lex(spark, sf_dir))


MENTIONED = """said AS (
  SELECT entry_id, p, unnest([1, 2, 3]) AS q, unnest([a2, a3, a4]) AS mention, a1 AS code, name, 'component' AS role FROM tmpl WHERE name IN ('af', 'compound')
  UNION ALL SELECT entry_id, p, 1, a2, a1, name, 'mention' FROM tmpl WHERE name IN ('m', 'm+', 'l')),
free AS (SELECT * FROM said WHERE coalesce(mention, '') <> '' AND (role = 'mention' OR (NOT starts_with(mention, '-') AND NOT ends_with(mention, '-')))
  AND NOT EXISTS (SELECT 1 FROM anc WHERE anc.entry_id = said.entry_id AND anc_word = mention AND anc_code = code)),
mentioned AS (SELECT entry_id, mention, code, first(name ORDER BY p, q) AS source_template, first(role ORDER BY p, q) AS role, min(p * 10 + q) AS spot FROM free GROUP BY entry_id, mention, code)"""


@query("b09_mentions", ANC + f", {MENTIONED} SELECT entry_id, mention, code AS mention_code, coalesce(names.name, code) AS mention_lang, source_template, role FROM mentioned LEFT JOIN names USING (code)")
def b09(spark, sf_dir):
    return templates.mentions(*_lex(spark, sf_dir)).select("entry_id", "mention", "mention_code", "mention_lang", "source_template", "role")


_TEMPLATE_SAYS = "SELECT entry_id, first(CASE name WHEN 'unk' THEN 'unknown' ELSE 'uncertain' END ORDER BY p) AS type, first('template:' || name ORDER BY p) AS source FROM tmpl WHERE name IN ('unk', 'unc') GROUP BY entry_id"
_phrases = [*((p, "disputed") for p in uncertainty.DISPUTED), *((p, "uncertain") for p in uncertainty.UNCERTAIN)]
_TEXT_SAYS = (
    "SELECT entry_id, CASE " + " ".join(f"WHEN contains(t, '{p}') THEN '{k}'" for p, k in _phrases) + " END AS type, CASE " + " ".join(f"WHEN contains(t, '{p}') THEN 'text:{p}'" for p, _ in _phrases)
    + " END AS source FROM (SELECT entry_id, lower(etymology_text) AS t FROM ent)"
)


@query("b10_uncertain_templates", f"{_TEMPLATE_SAYS}")
def b10(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select("entry_id", uncertainty.from_templates().alias("u")).filter("u IS NOT NULL").select("entry_id", "u.type", "u.source")


@query("b11_uncertain_texts", f"SELECT * FROM ({_TEXT_SAYS}) WHERE type IS NOT NULL")
def b11(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select("entry_id", uncertainty.from_text().alias("u")).filter("u IS NOT NULL").select("entry_id", "u.type", "u.source")


@query("b12_classification", f"SELECT e.entry_id, coalesce(a.type, b.type) IS NOT NULL AS is_uncertain, coalesce(a.type, b.type) AS type, coalesce(a.source, b.source) AS source, CASE WHEN a.type IS NULL AND b.type IS NOT NULL THEN 'medium' ELSE 'high' END AS confidence FROM ent e LEFT JOIN ({_TEMPLATE_SAYS}) a USING (entry_id) LEFT JOIN ({_TEXT_SAYS}) b USING (entry_id)")
def b12(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select("entry_id", uncertainty.classify().alias("u")).select("entry_id", "u.*")


_GLOSSES = "'gloss of ' || word || '|second of ' || word || CASE WHEN r IS NOT NULL AND r % 10 IN (1, 2) AND hub IS NOT NULL THEN '|' || " + lexicon.RAISED.format('hub') + " ELSE '' END"


@query("b13_glosses", f"SELECT entry_id, CASE WHEN pos = 'root' THEN '' ELSE {_GLOSSES} END AS glosses FROM ent")
def b13(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select("entry_id", F.array_join(fe.all_glosses(F.col("senses")), "|").alias("glosses"))


_FIRST_IPA = "CASE WHEN asc_ AND len % 7 = 0 THEN '[' || ipa || ']' WHEN asc_ AND len % 2 = 0 THEN '/x' || ipa || '/' WHEN asc_ THEN '/' || ipa || './' END"
_AUDIO = "CASE WHEN asc_ AND len % 7 = 0 THEN NULL WHEN asc_ AND len % 2 = 0 THEN word || '.ogg' WHEN NOT asc_ AND len % 3 = 0 THEN word || '.ogg' END"


@query("b14_sounds", f"SELECT entry_id, {_FIRST_IPA} AS ipa, coalesce({_AUDIO}, '') AS audio FROM ent WHERE has_sounds")
def b14(spark, sf_dir):
    with_sounds = lexicon.entries(spark, sf_dir).filter("sounds IS NOT NULL")
    return with_sounds.select("entry_id", fe.first_ipa(F.col("sounds")).alias("ipa"), F.array_join(F.transform(fe.audio(F.col("sounds")), lambda a: a["ogg_url"]), "|").alias("audio"))


@query("b15_best_ipa", "SELECT entry_id, ipa FROM ent WHERE has_sounds")
def b15(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).filter("sounds IS NOT NULL").select("entry_id", fe.best_ipa(F.col("sounds")).alias("ipa"))


@query("b16_sound_classes", PHON + "SELECT DISTINCT ipa, classes AS dolgo_classes, cons AS dolgo_consonants, first2 AS dolgo_first2, length(classes) AS n_tokens FROM voiced")
def b16(spark, sf_dir):
    strings = lexicon.entries(spark, sf_dir).select(fe.best_ipa(F.col("sounds")).alias("ipa")).filter("ipa IS NOT NULL")
    return sound_classes(strings).select("ipa", "dolgo_classes", "dolgo_consonants", "dolgo_first2", F.size("tokens").cast("long").alias("n_tokens"))


_SUMMARY = "left(coalesce((SELECT first(expansion ORDER BY p) FROM tmpl t WHERE t.entry_id = {0}.entry_id AND t.name IN ('inh', 'bor', 'der') AND t.expansion <> ''), {0}.etymology_text, ''), 120)"


@query("b17_summary", f"SELECT entry_id, {_SUMMARY.format('ent')} AS summary FROM ent")
def b17(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select("entry_id", fe.summary().alias("summary"))


def _phonetics(spark, sf_dir):
    return lexicon.once(spark, sf_dir, "phonetics", lambda: tables.phonetic_rows(lexicon.entries(spark, sf_dir)))


def _voiced(spark, sf_dir, pos=None):
    """All entries, and spoken ones without what only hubs and phonetics are made of."""
    entries = lexicon.entries(spark, sf_dir)
    return entries, lexicon.once(spark, sf_dir, f"spoken_{pos}", lambda: concepts.spoken(entries.drop("sounds", "translations"), _phonetics(spark, sf_dir), pos))


def _asked(spark, sf_dir):
    """The concepts: English words at every tenth rank."""
    top = lexicon.ranked(lexicon.words(spark, sf_dir))
    return top.filter((F.col("lang_code") == "en") & (F.col("r") % lexicon.PER_CONCEPT == 0)).select(F.col("word").alias("concept"))


def _resolved(spark, sf_dir, pos=None):
    entries, voiced = _voiced(spark, sf_dir, pos)
    return entries, voiced, lexicon.once(spark, sf_dir, f"resolved_{pos}", lambda: concepts.resolve_concepts(_asked(spark, sf_dir), entries, voiced))


def _concept_words(spark, sf_dir):
    _, voiced, found = _resolved(spark, sf_dir)
    return lexicon.once(spark, sf_dir, "concept_words", lambda: concepts.word_rows(found, voiced))


@query("b18_word_rows", MEMB + f"SELECT c.concept, id, c.word, c.lang, c.lang_code, c.pos, c.ipa, classes AS dolgo_classes, cons AS dolgo_consonants, first2 AS dolgo_first2, EXISTS (SELECT 1 FROM tmpl WHERE tmpl.entry_id = c.entry_id) AS has_etymology, {_SUMMARY.format('ent')} AS etymology_summary FROM cwords c JOIN ent USING (entry_id)")
def b18(spark, sf_dir):
    return _concept_words(spark, sf_dir).drop("entry_id")


_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in FAMILIES.items()) + " ELSE 'other' END"
_TIER = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN {t}" for p, t in ERAS) + " ELSE 6 END"


@query("b19_family", f"SELECT DISTINCT lang, {_FAMILY.format('lang')} AS family FROM ent")
def b19(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select("lang").distinct().select("lang", family(F.col("lang")).alias("family"))


@query("b20_era", f"SELECT DISTINCT lang, {_TIER.format('lang')} AS tier FROM ent")
def b20(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select("lang").distinct().select("lang", era_tier(F.col("lang")).alias("tier"))


@query("b21_node_families", GRAPH + f"SELECT seed_id, id, {_FAMILY.format('language')} AS family, {_TIER.format('language')} AS tier FROM g_nodes")
def b21(spark, sf_dir):
    return graph.with_family(_graph(spark, sf_dir)[0]).select("seed_id", "id", "family", "tier")


_THREE = "len % 4 = 1 AND etymology_text IS NOT NULL AND len % 9 <> 0 AND len % 10 <> 1"


@query("b22_sections", f"""SELECT entry_id, CASE WHEN {_THREE} THEN 'Proto-' || lang || ' *' || left(word, 2) || '|' || left(word, 3) || ' (' || lang || ')' ELSE '' END AS tree,
  CASE WHEN {_THREE} THEN 'From older ' || left(word, 3) || '.' ELSE coalesce(etymology_text, '') END AS prose,
  CASE WHEN {_THREE} THEN '* ' || CASE nx WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Spanish' END || ' ' || word || ' ("sense")|' || left(word, 4) ELSE '' END AS cognates FROM ent""")
def b22(spark, sf_dir):
    cut = lexicon.entries(spark, sf_dir).select("entry_id", fe.sections(F.col("etymology_text")).alias("s"))
    return cut.select("entry_id", *(F.array_join(f"s.{c}", "|").alias(c) for c in ("tree", "prose", "cognates")))


@query("b23_lines", f"""SELECT entry_id, 'tree' AS part, 'Proto-' || lang AS line_lang, '*' || left(word, 2) AS line_word, NULL::VARCHAR AS gloss FROM body WHERE {_THREE}
  UNION ALL SELECT entry_id, 'tree', lang, left(word, 3), NULL FROM body WHERE {_THREE}
  UNION ALL SELECT entry_id, 'cognate', CASE nx WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Spanish' END, word, 'sense' FROM body WHERE {_THREE}
  UNION ALL SELECT entry_id, 'cognate', NULL, NULL, NULL FROM body WHERE {_THREE}""")
def b23(spark, sf_dir):
    cut = lexicon.entries(spark, sf_dir).select("entry_id", fe.sections(F.col("etymology_text")).alias("s"))
    tree = cut.select("entry_id", F.lit("tree").alias("part"), F.explode("s.tree").alias("x")).select("entry_id", "part", fe.tree_line(F.col("x")).alias("l"))
    cognate = cut.select("entry_id", F.lit("cognate").alias("part"), F.explode("s.cognates").alias("x")).select("entry_id", "part", fe.cognate_line(F.col("x")).alias("l"))
    shape = lambda df, gloss: df.select("entry_id", "part", F.col("l.lang").alias("line_lang"), F.col("l.word").alias("line_word"), gloss.alias("gloss"))
    return shape(tree, F.lit(None).cast("string")).unionByName(shape(cognate, F.col("l.gloss")))


@query("b24_links", "SELECT entry_id, link, arg_max(code, kind * 1000 + p) AS code FROM (SELECT entry_id, p, 0 AS kind, a2 AS link, a1 AS code FROM tmpl WHERE name = 'cog' UNION ALL SELECT entry_id, p, 1, a3, a2 FROM tmpl WHERE name IN ('inh', 'bor', 'der')) GROUP BY entry_id, link")
def b24(spark, sf_dir):
    return templates.link_lookup(lexicon.entries(spark, sf_dir))


_URL = "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~')"


@query("b25_urls", f"SELECT DISTINCT word, lang, 'https://en.wiktionary.org/wiki/' || CASE WHEN starts_with(lang, 'Proto-') THEN 'Reconstruction:' || {_URL.format('lang')} || '/' || {_URL.format('word')} ELSE {_URL.format('word')} || '#' || {_URL.format('lang')} END AS url FROM ent")
def b25(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select("word", "lang").distinct().withColumn("url", fe.page_url(F.col("word"), F.col("lang")))


@query("b26_quality", ANC + f""", u AS (SELECT e.entry_id, coalesce(a.type, b.type) IS NOT NULL AS uncertain FROM ent e LEFT JOIN ({_TEMPLATE_SAYS}) a USING (entry_id) LEFT JOIN ({_TEXT_SAYS}) b USING (entry_id)),
s AS (SELECT entry_id, count(*) AS steps FROM anc GROUP BY 1), t AS (SELECT entry_id, list(name) AS ns FROM tmpl GROUP BY 1)
SELECT entry_id, uncertain AND coalesce(steps, 0) <= 1 AS missing_alternative_origins, coalesce(list_has_any(ns, ['compound', 'af', 'affix', 'suffix', 'prefix', 'blend', '+']), false) AND coalesce(steps, 0) = 0 AS missing_compound_components,
  coalesce(list_has_any(ns, ['cal', 'calque']), false) AS missing_calques, coalesce(list_contains(ns, 'doublet'), false) AS missing_doublet_link FROM u LEFT JOIN s USING (entry_id) LEFT JOIN t USING (entry_id)""")
def b26(spark, sf_dir):
    return lexicon.entries(spark, sf_dir).select("entry_id", *templates.quality_flags(uncertainty.classify()["is_uncertain"]))


# Filters and look-ups.


@query("c01_resolve", ANC + ONE + f"SELECT DISTINCT anc_word, anc_lang, coalesce(o.word, p.word) AS found_word, coalesce(o.entry_id, p.entry_id) AS found_id, CASE WHEN o.word IS NOT NULL THEN 'exact' WHEN p.word IS NOT NULL THEN 'normalised' END AS how FROM anc LEFT JOIN one o ON o.word = anc_word AND o.lang = anc_lang LEFT JOIN one p ON p.word = {NORM.format('anc_word')} AND p.lang = anc_lang")
def c01(spark, sf_dir):
    entries, names = _lex(spark, sf_dir)
    wanted = templates.ancestry(entries, names).select("anc_word", "anc_lang").distinct()
    return lookup.resolve(wanted, entries, "anc_word", "anc_lang")


@query("c02_etymology_number", EVERY + f""", w AS (SELECT CASE WHEN length(word) % 2 = 0 THEN '*' ELSE '' END || word AS word, lang, CASE length(word) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS etym, seed_id FROM seeds),
num AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, lang, etym ORDER BY pos, entry_id) AS k2 FROM ent WHERE etym IS NOT NULL) WHERE k2 = 1),
t AS (SELECT w.*, {NORM.format('w.word')} AS norm FROM w)
SELECT seed_id, CASE WHEN t.etym IS NULL THEN coalesce(o.entry_id, p.entry_id) ELSE coalesce(n.entry_id, m.entry_id) END AS strict_id, coalesce(n.entry_id, o.entry_id, p.entry_id) AS loose_id
FROM t LEFT JOIN num n ON n.word = t.word AND n.lang = t.lang AND n.etym = t.etym LEFT JOIN num m ON m.word = norm AND m.lang = t.lang AND m.etym = t.etym
LEFT JOIN one o ON o.word = t.word AND o.lang = t.lang LEFT JOIN one p ON p.word = norm AND p.lang = t.lang""")
def c02(spark, sf_dir):
    """All words, every other one in a reconstructed form; of number 1, 2 or none."""
    entries = lexicon.entries(spark, sf_dir)
    n = F.length("word")
    wanted = lexicon.every_word(spark, sf_dir).withColumn("etym", F.when(n % 3 == 0, 1).when(n % 3 == 1, 2))
    wanted = wanted.withColumn("word", F.when(n % 2 == 0, F.concat(F.lit("*"), "word")).otherwise(F.col("word")))
    strict = lookup.with_etymology(wanted, entries, True).select("seed_id", F.col("found_id").alias("strict_id"))
    return strict.join(lookup.with_etymology(wanted, entries, False).select("seed_id", F.col("found_id").alias("loose_id")), "seed_id")


_ASKED = SEEDS + ", q AS (SELECT DISTINCT left(word, 4) AS q FROM seeds UNION SELECT word FROM seeds), hit AS (SELECT q.q, o.word, o.lang, o.pos, o.word = q.q AS exact FROM q JOIN one o ON starts_with(o.word, q.q))"


def _queries(spark, sf_dir):
    seeds = lexicon.seeds(spark, sf_dir)
    return seeds.select(F.substring("word", 1, 4).alias("q")).unionByName(seeds.select(F.col("word").alias("q"))).distinct()


@query("c03_prefix", _ASKED + " SELECT q, word, lang, exact FROM hit")
def c03(spark, sf_dir):
    return lookup.prefix_hits(_queries(spark, sf_dir), lookup.one_entry(lexicon.entries(spark, sf_dir)).select("word", "lang")).select("q", "word", "lang", "exact")


@query("c04_naming", ANC + "SELECT DISTINCT anc_word AS parent_word, anc_code AS parent_code, entry_id FROM anc")
def c04(spark, sf_dir):
    return graph.naming(lexicon.entries(spark, sf_dir)).select("parent_word", "parent_code", "entry_id")


_SUGGEST = f""", q AS (SELECT DISTINCT {lexicon.RAISED.format('left(concept_word, 2)')} AS q FROM trans), c AS (SELECT e.word AS concept, pos, e.entry_id, (SELECT count(*) FROM trans t WHERE t.hub_id = e.entry_id) AS translation_count FROM ent e WHERE is_hub),
s AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY translation_count DESC, concept, pos, entry_id) AS rank, concept, pos, translation_count FROM q JOIN c ON starts_with(replace(lower(concept), 'ß', 'ss'), replace(lower(q), 'ß', 'ss')))"""


def _prefixes(spark, sf_dir):
    return concepts.hubs(lexicon.entries(spark, sf_dir)).select(lexicon.raised(F.substring("concept", 1, 2)).alias("q")).distinct()


@query("c05_suggest", _SUGGEST + " SELECT q, concept, pos, translation_count FROM s")
def c05(spark, sf_dir):
    found = concepts.suggest(_prefixes(spark, sf_dir), lexicon.entries(spark, sf_dir), 1 << 30)
    return found.select("q", "concept", "pos", F.col("translation_count").cast("long").alias("translation_count"))


@query("c06_gloss_match", MEMB + "SELECT concept, word, lang FROM by_gloss")
def c06(spark, sf_dir):
    return concepts.gloss_members(_asked(spark, sf_dir), _voiced(spark, sf_dir)[1]).select("concept", "word", "lang")


@query("c07_predicates", "SELECT entry_id, has_sounds AS with_sounds, is_hub AS with_translations, EXISTS (SELECT 1 FROM tmpl t WHERE t.entry_id = ent.entry_id AND t.name IN ('af', 'compound')) AS with_affixes, pos = 'verb' AS verb FROM ent")
def c07(spark, sf_dir):
    shown = lexicon.entries(spark, sf_dir).select("entry_id", fe.has_some("sounds").alias("with_sounds"), fe.has_some("translations").alias("with_translations"), fe.has_template(AFFIXES).alias("with_affixes"), (F.col("pos") == "verb").alias("verb"))
    return shown


@query("c08_select_pairs", PAIRS + "SELECT concept, source, target, similarity FROM pe WHERE similarity >= 0.5 OR turchin_match")
def c08(spark, sf_dir):
    return concepts.select_pairs(concepts.pairs(_concept_words(spark, sf_dir)), 0.5).select("concept", "source", "target", "similarity")


@query("c09_details", EVERY + ANC + f""", w AS (SELECT CASE WHEN length(word) % 2 = 0 THEN '*' ELSE '' END || word AS asked_word, lang AS asked_lang, word AS base FROM seeds),
ph AS (SELECT entry_id, ipa, classes, replace(classes, 'V', '') AS cons FROM (SELECT entry_id, ipa, {lexicon.CLASSES.format('ipa')} AS classes FROM ent WHERE has_sounds)),
tl AS (SELECT entry_id, string_agg(name, '|' ORDER BY p) AS ns FROM tmpl GROUP BY 1),
{MENTIONED},
ml AS (SELECT entry_id, string_agg(mention || ' ' || coalesce(names.name, code) || ' ' || role, '|' ORDER BY spot) AS said FROM mentioned LEFT JOIN names USING (code) GROUP BY 1)
SELECT asked_word, asked_lang, o.entry_id, o.word, o.pos, {_GLOSSES} AS glosses, CASE WHEN has_sounds THEN {_FIRST_IPA.replace('ipa', 'o.ipa')} END AS ipa, o.etymology_text, coalesce(ns, '') AS template_names,
  coalesce(a.type, b.type) AS type, coalesce(a.source, b.source) AS source, CASE WHEN has_sounds THEN coalesce({_AUDIO}, '') ELSE '' END AS audio, ph.ipa AS phonetic_ipa, ph.classes AS dolgo_classes, ph.cons AS dolgo_consonants, coalesce(said, '') AS mentions
FROM w JOIN one o ON o.word = CASE WHEN asked_word = base THEN base ELSE strip_accents(base) END AND o.lang = asked_lang LEFT JOIN ({_TEMPLATE_SAYS}) a USING (entry_id) LEFT JOIN ({_TEXT_SAYS}) b USING (entry_id) LEFT JOIN ph USING (entry_id) LEFT JOIN tl USING (entry_id) LEFT JOIN ml USING (entry_id)""")
def c09(spark, sf_dir):
    """All words, every other one asked for in a reconstructed form."""
    entries, names = _lex(spark, sf_dir)
    wanted = lexicon.every_word(spark, sf_dir).select(F.when(F.length("word") % 2 == 0, F.concat(F.lit("*"), "word")).otherwise(F.col("word")).alias("word"), "lang")
    shown = lookup.word_details(wanted, entries, names, _phonetics(spark, sf_dir))
    joined = lambda c, of: F.coalesce(F.array_join(F.transform(c, of), "|"), F.lit(""))
    return shown.select(
        "asked_word", "asked_lang", "entry_id", "word", "pos", F.array_join("glosses", "|").alias("glosses"), "ipa", "etymology_text", joined("etymology_templates", lambda t: t["name"]).alias("template_names"),
        F.col("uncertainty.type").alias("type"), F.col("uncertainty.source").alias("source"), joined("audio", lambda a: a["ogg_url"]).alias("audio"), "phonetic_ipa", "dolgo_classes", "dolgo_consonants",
        joined("mentions", lambda m: F.concat_ws(" ", m["word"], m["lang"], m["role"])).alias("mentions"),
    )


# Joins.


@query("d01_component_exists", COMP + "SELECT entry_id, from_word, from_lang, to_word, to_lang, source_template, from_exists FROM compx")
def d01(spark, sf_dir):
    entries, names = _lex(spark, sf_dir)
    return edges.with_existence(templates.component_edges(entries, names), entries).select("entry_id", "from_word", "from_lang", "to_word", "to_lang", "source_template", "from_exists")


@query(
    "d02_mention_edges",
    ANC + ONE + f""", said AS (
  SELECT entry_id, unnest([a2, a3, a4]) AS mention, a1 AS code, 1 AS k, p FROM tmpl WHERE name IN ('af', 'compound') UNION ALL SELECT entry_id, a2, a1, 0, p FROM tmpl WHERE name IN ('m', 'l')),
f AS (SELECT o.word, o.lang, mention, coalesce(n.name, said.code) AS mlang, arg_min(said.k, p) AS k FROM said JOIN one o USING (entry_id) LEFT JOIN names n ON n.code = said.code
  WHERE coalesce(mention, '') <> '' AND (said.k = 0 OR (NOT starts_with(mention, '-') AND NOT ends_with(mention, '-'))) AND NOT EXISTS (SELECT 1 FROM anc WHERE anc.entry_id = o.entry_id) GROUP BY ALL)
SELECT f.word, f.lang, mention, mlang AS mention_lang, CASE k WHEN 0 THEN 'mention' ELSE 'component' END AS role FROM f
WHERE EXISTS (SELECT 1 FROM one x WHERE x.word = mention AND x.lang = mlang) OR EXISTS (SELECT 1 FROM one x WHERE x.word = {NORM.format('mention')} AND x.lang = mlang)""",
)
def d02(spark, sf_dir):
    entries, names = _lex(spark, sf_dir)
    all_words = lookup.one_entry(entries).select(F.lit("all").alias("seed_id"), "word", "lang", F.lit(0).alias("level"), F.col("entry_id").alias("found_id"))
    return graph.mention_edges(all_words, entries, names).select("word", "lang", "mention", "mention_lang", "role")


@query("d03_chain_components", EVERY_CHAIN + COMP + "SELECT DISTINCT seed_id, n.word, n.lang, from_word, from_lang FROM chain_nodes n JOIN compx c ON c.to_word = n.word AND c.to_lang = n.lang AND from_exists")
def d03(spark, sf_dir):
    _, entries, names, nodes, _ = _chain(spark, sf_dir, seeds=lexicon.every_word)
    found = edges.with_existence(templates.component_edges(entries, names), entries)
    words = nodes.select("seed_id", F.col("label").alias("word"), F.col("language").alias("lang"))
    return edges.leading_to(words, found).select("seed_id", "word", "lang", "from_word", "from_lang").distinct()


@query("d04_children", ANC + KIDS + "SELECT pw AS parent_word, pc AS parent_code, word, lang, lang_code, type FROM kids")
def d04(spark, sf_dir):
    return graph.children(lexicon.entries(spark, sf_dir))


@query("d05_members", MEMB + "SELECT concept, word, lang FROM by_hub")
def d05(spark, sf_dir):
    entries, voiced = _voiced(spark, sf_dir)
    return concepts.members(concepts.hubs(entries), voiced).select("concept", "word", "lang")


@query("d05_members_verb", VERBS + "SELECT concept, word, lang FROM by_hub")
def d05_verb(spark, sf_dir):
    entries, voiced = _voiced(spark, sf_dir, "verb")
    return concepts.members(concepts.hubs(entries), voiced).select("concept", "word", "lang")


@query("d06_gloss_added", MEMB + "SELECT concept, word, lang FROM added")
def d06(spark, sf_dir):
    entries, voiced, found = _resolved(spark, sf_dir)
    return found.join(concepts.members(concepts.hubs(entries), voiced), ["concept", "word", "lang"], "left_anti").select("concept", "word", "lang")


@query("d07_pairs", PAIRS + "SELECT * FROM pe")
def d07(spark, sf_dir):
    return concepts.pairs(_concept_words(spark, sf_dir))


@query("d08_cognate_links", LINKS + "SELECT * FROM cl")
def d08(spark, sf_dir):
    entries, _, found = _resolved(spark, sf_dir)
    return concepts.cognate_links(found, entries)


@query("d09_mention_links", LINKS + "SELECT * FROM ml")
def d09(spark, sf_dir):
    entries, _, found = _resolved(spark, sf_dir)
    return concepts.mention_links(found, entries)


AUDIT = ANC + """, known AS (SELECT DISTINCT word, lang_code FROM ent), aud AS (
  SELECT a.*, CASE WHEN k0.word IS NOT NULL THEN 'exact' WHEN k1.word IS NOT NULL THEN 'asterisk' WHEN k2.word IS NOT NULL THEN 'macron' WHEN k3.word IS NOT NULL THEN 'both' ELSE 'missing' END AS form FROM anc a
  LEFT JOIN known k0 ON k0.word = anc_word AND k0.lang_code = anc_code LEFT JOIN known k1 ON k1.word = regexp_replace(anc_word, '^\\*+', '') AND k1.lang_code = anc_code
  LEFT JOIN known k2 ON k2.word = strip_accents(anc_word) AND k2.lang_code = anc_code LEFT JOIN known k3 ON k3.word = strip_accents(regexp_replace(anc_word, '^\\*+', '')) AND k3.lang_code = anc_code)
"""


def _audit(spark, sf_dir):
    entries, names = _lex(spark, sf_dir)
    return audit.chain_audit(templates.ancestry(entries, names), entries)


@query("d10_chain_audit", AUDIT + "SELECT entry_id, ord, anc_word, anc_code, form FROM aud")
def d10(spark, sf_dir):
    return _audit(spark, sf_dir).select("entry_id", F.col("ord").cast("long").alias("ord"), "anc_word", "anc_code", "form")


@query("d11_named_templates", "SELECT t.entry_id, t.name AS template, a1 AS code, coalesce(n.name, a1) AS lang FROM tmpl t LEFT JOIN names n ON n.code = a1")
def d11(spark, sf_dir):
    entries, names = _lex(spark, sf_dir)
    rows = entries.select("entry_id", F.explode(fe.templates()).alias("t")).select("entry_id", F.col("t.name").alias("template"), fe.arg(F.col("t"), "1").alias("code"))
    return templates.with_names(rows, names, "code", "lang")


# Graphs.


@query("g01_chain", EVERY_CHAIN + "SELECT seed_id, id AS from_id, previous AS to_id, type AS label, ord FROM chain WHERE ord <= 10")
def g01(spark, sf_dir):
    return _chain(spark, sf_dir, seeds=lexicon.every_word)[4].select("seed_id", "from_id", "to_id", "label", F.col("ord").cast("long").alias("ord"))


@query("g02_tree_chain", ANC + EVERY + """, t AS (SELECT s.seed_id, s.word, s.lang, anc_word || ':' || anc_lang AS id, type, row_number() OVER (PARTITION BY s.seed_id ORDER BY ord) AS n FROM seeds s JOIN one o USING (word, lang) JOIN anc ON anc.entry_id = o.entry_id AND type IN ('inh', 'der'))
SELECT DISTINCT seed_id, id AS from_id, coalesce(lag(id) OVER (PARTITION BY seed_id ORDER BY n), word || ':' || lang) AS to_id, type AS label FROM t""")
def g02(spark, sf_dir):
    return graph.merge_edges(_chain(spark, sf_dir, ("inh", "der"), lexicon.every_word)[4].withColumn("at", F.col("ord")))


@query("g03_descendants", CHAIN + KIDS + """, d1 AS (SELECT DISTINCT seed_id, n.word || ':' || n.lang AS from_id, k.word || ':' || k.lang AS to_id, k.type AS label, k.word, k.lang_code FROM chain_nodes n JOIN kids k ON pw = n.word AND pc = n.code),
d2 AS (SELECT DISTINCT seed_id, to_id AS from_id, k.word || ':' || k.lang AS to_id, k.type AS label, k.word, k.lang_code FROM d1 JOIN kids k ON pw = d1.word AND pc = d1.lang_code),
d3 AS (SELECT DISTINCT seed_id, to_id AS from_id, k.word || ':' || k.lang AS to_id, k.type AS label FROM d2 JOIN kids k ON pw = d2.word AND pc = d2.lang_code)
SELECT seed_id, from_id, to_id, min(label) AS label FROM (SELECT seed_id, from_id, to_id, label FROM d1 UNION SELECT seed_id, from_id, to_id, label FROM d2 UNION SELECT * FROM d3) GROUP BY ALL""")
def g03(spark, sf_dir):
    found, entries, names, nodes, _ = _chain(spark, sf_dir)
    trees = graph.Trees(_dictionary(spark, sf_dir), templates.component_edges(entries, names).limit(0).withColumn("from_exists", F.lit(False)), names, ("inh", "bor", "der"))
    start = templates.with_codes(nodes.select("seed_id", F.col("label").alias("word"), F.col("language").alias("lang"), "level"), names, "lang", "code")
    trees.descend(start)
    return trees.edges()


_DEALT: dict[tuple[str, str], lookup.Dictionary] = {}


def _dictionary(spark, sf_dir):
    """The dictionary in buckets, dealt out once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DEALT:
        _DEALT[key] = lookup.Dictionary(lexicon.entries(spark, sf_dir))
    return _DEALT[key]


def _trees(spark, sf_dir, types):
    entries, names = _lex(spark, sf_dir)
    found = lexicon.once(spark, sf_dir, "components", lambda: edges.with_existence(templates.component_edges(entries, names), entries))
    return graph.Trees(_dictionary(spark, sf_dir), found, names, types).build(lexicon.seeds(spark, sf_dir))


@query("g04_components")
def g04(spark, sf_dir):
    return _trees(spark, sf_dir, ("inh",))[1].filter("label = 'component'")


@query("g05_cognate_trees")
def g05(spark, sf_dir):
    return _trees(spark, sf_dir, ("inh", "cog"))[1]


@query("g06_trees")
def g06(spark, sf_dir):
    return _trees(spark, sf_dir, ("inh", "bor", "der"))[0].select("seed_id", "id", "label", "language", "level", F.col("uncertainty.type").alias("uncertainty"))


@query("g07_merge", GRAPH + "SELECT seed_id, id, level FROM g_nodes")
def g07(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("seed_id", "id", "level")


@query("g08_hops")
def g08(spark, sf_dir):
    start = lexicon.seeds(spark, sf_dir).select("seed_id", fe.node_id(F.col("word"), F.col("lang")).alias("id"))
    return graph.hop_distances(start, _graph(spark, sf_dir)[1])


# A chain has three words at most and all children hang on it: five hops reach all of a graph.
SQL["g08_hops"] = lexicon.oracle(GRAPH + ", h0 AS (SELECT seed_id, word || ':' || lang AS id, 0 AS hops FROM seeds)" + "".join(
    f", h{k} AS (SELECT * FROM h{k - 1} UNION SELECT seed_id, other, {k} FROM h{k - 1} JOIN both_ways USING (seed_id, id) WHERE hops = {k - 1})" for k in range(1, 8)
) + " SELECT seed_id, id, min(hops) AS hops FROM h7 GROUP BY ALL")


@query("g09_neighbours", GRAPH + "SELECT DISTINCT b.seed_id, id, other FROM both_ways b JOIN seeds s ON s.seed_id = b.seed_id AND s.word || ':' || s.lang = id")
def g09(spark, sf_dir):
    focus = lexicon.seeds(spark, sf_dir).select("seed_id", fe.node_id(F.col("word"), F.col("lang")).alias("id"))
    return graph.neighbours(focus, _graph(spark, sf_dir)[1])


@query("g10_roots", GRAPH + ", d AS (SELECT seed_id, id, count(*) AS degree FROM both_ways GROUP BY ALL) SELECT seed_id, root, centre FROM (SELECT seed_id, first(id ORDER BY level, id) AS root FROM g_nodes GROUP BY 1) LEFT JOIN (SELECT seed_id, first(id ORDER BY degree DESC, id) AS centre FROM d GROUP BY 1) USING (seed_id)")
def g10(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    return graph.roots(nodes).join(graph.centres(links), "seed_id", "left")


# Aggregations.

POLY = """, gr AS (SELECT word, lang, etym, string_agg(DISTINCT pos, ', ' ORDER BY pos) AS pos, 'gloss of ' || word AS first_gloss FROM ent WHERE etym IS NOT NULL GROUP BY word, lang, etym),
poly AS (SELECT *, count(*) OVER (PARTITION BY word, lang) AS n FROM gr)
"""


@query("e01_polysemy", POLY + "SELECT word, lang, etym AS etymology_number, pos, first_gloss FROM poly WHERE n >= 2")
def e01(spark, sf_dir):
    return lookup.polysemy(lexicon.entries(spark, sf_dir))


@query("e02_translation_counts", "SELECT e.word AS concept, e.pos, (SELECT count(*) FROM trans t WHERE t.hub_id = e.entry_id) AS translation_count FROM ent e WHERE is_hub")
def e02(spark, sf_dir):
    hubs = lexicon.entries(spark, sf_dir).filter(F.size(F.coalesce("translations", F.array())) > 0)
    return hubs.select(F.col("word").alias("concept"), "pos", F.size("translations").cast("long").alias("translation_count"))


@query("e03_clusters", MEMB + "SELECT concept, 'cluster_' || first2 AS id, left(first2, 1) || '-' || right(first2, 1) || ' group' AS label, string_agg(id, '|' ORDER BY id) AS words FROM cwords WHERE length(first2) >= 2 GROUP BY concept, first2 HAVING count(*) >= 2")
def e03(spark, sf_dir):
    return concepts.clusters(_concept_words(spark, sf_dir)).withColumn("words", F.array_join("words", "|"))


@query("e04_merged_words", MEMB + "SELECT id, string_agg(DISTINCT concept, '|' ORDER BY concept) AS concepts, min(word) AS word, min(lang) AS lang FROM cwords GROUP BY id")
def e04(spark, sf_dir):
    return concepts.merge_words(_concept_words(spark, sf_dir)).withColumn("concepts", F.array_join("concepts", "|"))


@query("e05_edge_lengths", GRAPH + ", d AS (SELECT seed_id, id, count(*) AS degree FROM both_ways GROUP BY ALL) SELECT e.seed_id, from_id, to_id, a.degree + b.degree AS degree_sum, greatest(a.degree, b.degree) AS degree_max, round_even(110 + 50 * log2(1 + a.degree + b.degree), 6) AS length FROM g_edges e JOIN d a ON a.seed_id = e.seed_id AND a.id = from_id JOIN d b ON b.seed_id = e.seed_id AND b.id = to_id")
def e05(spark, sf_dir):
    return graph.edge_lengths(_graph(spark, sf_dir)[1]).select("seed_id", "from_id", "to_id", "degree_sum", "degree_max", F.bround("length", 6).alias("length"))


@query("e06_families", GRAPH + f"SELECT seed_id, {_FAMILY.format('language')} AS family, count(*) AS nodes, count(*) >= 2 AS collapsed FROM g_nodes GROUP BY 1, 2")
def e06(spark, sf_dir):
    return graph.families(_graph(spark, sf_dir)[0])


@query("e07_tiers", GRAPH + f"SELECT seed_id, {_TIER.format('language')} AS tier, {_FAMILY.format('language')} AS family, string_agg(id, '|' ORDER BY id) AS ids FROM g_nodes GROUP BY 1, 2, 3")
def e07(spark, sf_dir):
    return graph.tiers(_graph(spark, sf_dir)[0]).withColumn("ids", F.array_join("ids", "|"))


@query("e08_connections", GRAPH + "SELECT seed_id, id, label, string_agg(other, '|' ORDER BY other) AS others FROM both_ways GROUP BY ALL")
def e08(spark, sf_dir):
    return graph.connections(_graph(spark, sf_dir)[1]).withColumn("others", F.array_join("others", "|"))


@query("e09_audit_totals", AUDIT + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (form = '{f}') AS {f}" for f in (*audit.FORMS, "missing")) + ", round_even((100 * count(*) FILTER (form <> 'missing') / count(*))::DOUBLE, 3) AS match_rate FROM aud")
def e09(spark, sf_dir):
    return audit.audit_totals(_audit(spark, sf_dir))


@query("e10_statistics", COMP + PHON + "SELECT * FROM (SELECT count(DISTINCT (to_word, to_lang)) AS words, count(*) AS edges, sum(from_exists::INT) AS matched, round_even((100 * sum(from_exists::INT) / count(*))::DOUBLE, 3) AS match_rate FROM compx), (SELECT count(*) AS processed, count(ipa) AS enriched, count(*) - count(ipa) AS no_ipa, 0 AS errors FROM phon)")
def e10(spark, sf_dir):
    entries, names = _lex(spark, sf_dir)
    a = audit.edge_statistics(edges.with_existence(templates.component_edges(entries, names), entries))
    return a.withColumn("k", F.lit(1)).join(audit.phonetic_statistics(tables.phonetic_rows(entries)).withColumn("k", F.lit(1)), "k").drop("k")


@query("e11_fingerprints", GRAPH + "SELECT seed_id, sha256(string_agg(id, chr(10) ORDER BY id)) AS hash FROM g_nodes GROUP BY seed_id")
def e11(spark, sf_dir):
    return graph.fingerprints(_graph(spark, sf_dir)[0])


# Rankings.


@query("f01_first_entries", ONE + "SELECT entry_id, word, lang FROM one")
def f01(spark, sf_dir):
    return lookup.one_entry(lexicon.entries(spark, sf_dir)).select("entry_id", "word", "lang")


@query("f02_capped_candidates", ANC + KIDS + "SELECT pw AS parent_word, pc AS parent_code, entry_id, place FROM cand")
def f02(spark, sf_dir):
    return graph.candidates(lexicon.entries(spark, sf_dir)).select("parent_word", "parent_code", "entry_id", "place")


@query("f03_previous", EVERY_CHAIN + "SELECT seed_id, ord, previous FROM chain")
def f03(spark, sf_dir):
    return _chain(spark, sf_dir, seeds=lexicon.every_word)[4].select("seed_id", F.col("ord").cast("long").alias("ord"), F.col("to_id").alias("previous"))


SEARCH = _ASKED + POLY + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY exact DESC, word, lang, pos) AS rank FROM hit) WHERE rank <= 20),
res AS (SELECT q, rank, top.word, top.lang, coalesce(p.pos, top.pos) AS pos, p.etym AS etymology_number, p.first_gloss FROM top LEFT JOIN poly p ON exact AND n >= 2 AND p.word = top.word AND p.lang = top.lang)
"""


@query("f04_search", SEARCH + "SELECT * FROM res")
def f04(spark, sf_dir):
    return lookup.search(_queries(spark, sf_dir), lexicon.entries(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("f05_top_concepts", _SUGGEST + " SELECT * FROM s WHERE rank <= 10")
def f05(spark, sf_dir):
    return concepts.suggest(_prefixes(spark, sf_dir), lexicon.entries(spark, sf_dir)).withColumns({"rank": F.col("rank").cast("long"), "translation_count": F.col("translation_count").cast("long")})


@query("f06_best_match", SEARCH + "SELECT q, first(word ORDER BY lower(word) <> lower(q), rank, coalesce(etymology_number, 0)) AS word, first(lang ORDER BY lower(word) <> lower(q), rank, coalesce(etymology_number, 0)) AS lang FROM res GROUP BY q")
def f06(spark, sf_dir):
    return lookup.best_match(lookup.search(_queries(spark, sf_dir), lexicon.entries(spark, sf_dir)))


@query("f07_ordered", LINKS + "SELECT * FROM el ORDER BY ALL")
def f07(spark, sf_dir):
    return concepts.canonical(h03(spark, sf_dir), "concept", "source", "target", "relationship")


# Set operations.


@query("h01_search_union", SEARCH + "SELECT DISTINCT q, word, lang FROM res")
def h01(spark, sf_dir):
    return lookup.search(_queries(spark, sf_dir), lexicon.entries(spark, sf_dir)).select("q", "word", "lang").distinct()


@query("h02_resolution", MEMB + "SELECT concept, word, lang, method FROM resolved")
def h02(spark, sf_dir):
    return _resolved(spark, sf_dir)[2].select("concept", "word", "lang", "method")


@query("h02_resolution_verb", VERBS + "SELECT concept, word, lang, method FROM resolved")
def h02_verb(spark, sf_dir):
    return _resolved(spark, sf_dir, "verb")[2].select("concept", "word", "lang", "method")


@query("h03_links", LINKS + "SELECT * FROM el")
def h03(spark, sf_dir):
    entries, _, found = _resolved(spark, sf_dir)
    return concepts.etymology_links(concepts.cognate_links(found, entries), concepts.mention_links(found, entries))


@query("h04_merged_links", LINKS + "SELECT source, target, relationship FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY concept, source, target) AS n FROM el) WHERE n = 1")
def h04(spark, sf_dir):
    return concepts.merge_links(h03(spark, sf_dir))


@query("h05_coverage", AUDIT + "SELECT DISTINCT anc_lang AS lang, anc_word AS word FROM aud WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.word = anc_word AND ent.lang = anc_lang)")
def h05(spark, sf_dir):
    entries, names = _lex(spark, sf_dir)
    expected = templates.ancestry(entries, names).select(F.col("anc_lang").alias("lang"), F.col("anc_word").alias("word")).distinct()
    return audit.coverage(expected, entries.select("lang", "word").distinct())


def _changed(nodes: DataFrame) -> DataFrame:
    """The nodes as they were stored before: one language was missing."""
    return nodes.filter("language <> 'Proto-English'")


@query("h06_stale", GRAPH + "SELECT seed_id FROM g_nodes GROUP BY seed_id HAVING count(*) FILTER (language = 'Proto-English') > 0")
def h06(spark, sf_dir):
    nodes = _graph(spark, sf_dir)[0]
    return audit.stale(graph.fingerprints(_changed(nodes)), graph.fingerprints(nodes))


@query("h07_drift", ONE + "SELECT word, lang, CASE WHEN len % 3 = 0 THEN 'missing' WHEN len % 3 = 1 THEN 'drift' ELSE 'none' END AS state FROM one")
def h07(spark, sf_dir):
    new = lookup.one_entry(lexicon.entries(spark, sf_dir)).select("word", "lang", "pos", "etymology_text", F.lit("now").alias("collected"))
    n = F.length("word") % 3
    old = new.filter(n != 0).withColumns({"pos": F.when(n == 1, "changed").otherwise(F.col("pos")), "collected": F.lit("then")})
    return audit.drift(old, new, ["word", "lang"], ["collected"])


# Similarity.


def _string_pairs(spark, sf_dir):
    """The plain letters of words beside those of each of their ancestors, and the consonants alone. (DuckDB measures
    distances in bytes.)"""
    rows = templates.ancestry(*_lex(spark, sf_dir)).select("word", F.col("anc_word").alias("other"))
    cut = lambda of: rows.select(F.regexp_replace("word", of, "").alias("a"), F.regexp_replace("other", of, "").alias("b"))
    return cut("[^a-z]").unionByName(cut("[^b-df-hj-np-tv-xz]")).distinct()


STRINGS = ANC + "".join(f", st{k} AS (SELECT regexp_replace(word, '{of}', '', 'g') AS a, regexp_replace(anc_word, '{of}', '', 'g') AS b FROM anc)" for k, of in enumerate(("[^a-z]", "[^b-df-hj-np-tv-xz]"))) + ", st AS (SELECT * FROM st0 UNION SELECT * FROM st1) "
_DISTANCE = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0::DOUBLE ELSE levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END"


@query("s01_distance", STRINGS + f"SELECT a, b, round_even({_DISTANCE}, 9) AS distance FROM st")
def s01(spark, sf_dir):
    return _string_pairs(spark, sf_dir).withColumn("distance", F.bround(sim.distance(F.col("a"), F.col("b")), 9))


@query("s02_similarity", STRINGS + f"SELECT a, b, round_even(1 - ({_DISTANCE}), 3) AS similarity FROM st")
def s02(spark, sf_dir):
    return _string_pairs(spark, sf_dir).withColumn("similarity", sim.rounded(sim.similarity(F.col("a"), F.col("b"))))


@query("s03_first_two", STRINGS + "SELECT a, b, length(a) >= 2 AND length(b) >= 2 AND left(a, 2) = left(b, 2) AS turchin_match FROM st")
def s03(spark, sf_dir):
    two = lambda c: F.substring(c, 1, 2)
    return _string_pairs(spark, sf_dir).withColumn("turchin_match", sim.first_two_match(two("a"), two("b")))


@query("s04_common_prefix", STRINGS + "SELECT a, b, left(a, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda n: left(a, n) = left(b, n))), 0)::INT) AS shared FROM st")
def s04(spark, sf_dir):
    return _string_pairs(spark, sf_dir).withColumn("shared", sim.common_prefix(F.col("a"), F.col("b")))
