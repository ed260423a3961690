"""A dictionary derived from the ``documents`` table by fixed rules, for running the operators on the test data.

``entries`` builds it with DataFrames; ``SQL`` says the same for DuckDB, in tables ``ent`` (one row per entry), ``tmpl``
(one row per template) and ``trans`` (translations). Both are derived once in a session and kept as tables in the shared
folder, as a dictionary is loaded once and asked many times.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.storage import exists, scratch_path, write

NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
NEXT = {"en": "de", "de": "fr", "fr": "es", "es": "en"}
#: Words of a language in each concept.
PER_CONCEPT = 10
COMMON = 50
#: Seeds are the words whose MD5 begins with less than this, about 1.2 % of all, and of this length at least.
SEED_MD5, SEED_LENGTH = "03", 5

#: How spellings are said, besides ``ch``: with a tie bar in words of even length, without in others.
TIED = "t͡ʃ"
SPELLED = {"sh": "ʃ", "th": "θ", "nd": "ⁿd"}.items()
#: The tone at the end of words whose length 7 divides.
FALLING = "˥˩"
_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_KEPT: dict[tuple[str, str, str], str] = {}


def raised(word: Column) -> Column:
    """With capitals for the letters a to z: others have no capital that all systems agree on."""
    return F.translate(word, _SMALL, _LARGE)


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once for each input in a session, and read from the shared folder afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT or not exists(spark, _KEPT[key]):
        path = scratch_path(spark, name)
        write(make(), path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def _named(code: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(code == k, v) for k, v in names.items()))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang_code, word, n): words of three letters or more with their counts."""
    return once(spark, sf_dir, "words", lambda: _words(spark, sf_dir))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    found = docs.select(F.col("lang").alias("lang_code"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return found.filter(F.length("word") >= 3).groupBy("lang_code", "word").agg(F.count("*").alias("n"))


def ranked(found: DataFrame) -> DataFrame:
    """(lang_code, word, r): all words of each language, ranked from 0 by falling count and then by word.

    Words are ranked among those of the same count and first two letters, and moved by how many stand before these: no
    language is sorted in one task, only its table of such groups."""
    keyed = found.withColumn("b", F.substring("word", 1, 2))
    within = Window.partitionBy("lang_code", "n", "b").orderBy("word")
    before = Window.partitionBy("lang_code").orderBy(F.desc("n"), "b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("lang_code", "n", "b").agg(F.count("*").alias("m"))
    starts = sizes.select("lang_code", "n", "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    placed = keyed.withColumn("k", F.row_number().over(within) - 1).join(starts, ["lang_code", "n", "b"])
    return placed.select("lang_code", "word", (F.col("start") + F.col("k")).cast("int").alias("r"))


def _template(when: Column, name: Column | str, args: dict[str, Column], expansion: Column | None = None) -> Column:
    made = F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        F.create_map(*(x for k, v in args.items() for x in (F.lit(k), v))).alias("args"),
        (F.lit("") if expansion is None else expansion).alias("expansion"),
    )
    return F.when(when, made)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the schema of ``wordloom.schema.ENTRY``, with ``entry_id``."""
    return once(spark, sf_dir, "entries", lambda: _entries(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = words(spark, sf_dir)
    top = ranked(found)
    hubs = top.filter((F.col("lang_code") == "en") & (F.col("r") % PER_CONCEPT == 0)).select((F.col("r") / PER_CONCEPT).cast("int").alias("concept"), F.col("word").alias("hub"))
    members = top.select((F.floor(F.col("r") / PER_CONCEPT)).cast("int").alias("concept"), "word", _named(F.col("lang_code"), NAMES).alias("lang"))
    translations = members.join(hubs.select("concept"), "concept", "left_semi").groupBy("concept").agg(F.sort_array(F.collect_list(F.struct("word", "lang"))).alias("translations"))
    top = top.withColumn("concept", F.floor(F.col("r") / PER_CONCEPT).cast("int")).join(hubs, "concept", "left")
    heads = (F.col("lang_code") == "en") & (F.col("r") % PER_CONCEPT == 0)
    top = top.join(translations.withColumnRenamed("concept", "of"), (F.col("concept") == F.col("of")) & heads, "left").drop("of")

    w, n, lc = F.col("word"), F.length("word"), F.col("lang_code")
    lang, after = _named(lc, NAMES), _named(lc, NEXT)
    base = found.join(top, ["lang_code", "word"], "left").withColumn("etymology_number", F.explode(F.when(F.col("n") >= COMMON, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(None).cast("int")))))
    pos = (n + F.coalesce("etymology_number", F.lit(1)) - 1) % 3
    left = lambda k: F.substring(w, 1, k)
    right2 = F.expr("right(word, 2)")
    ancestry = F.when(n % 4 == 0, "inh").when(n % 4 == 1, "bor").when(n % 4 == 2, "der").otherwise("derived")
    chain = n % 6 != 0
    proto_lang = F.concat(F.lit("Proto-"), lang)
    made = F.array(
        _template(chain & (n >= 7), ancestry, {"1": lc, "2": lc, "3": left(5)}, F.when(n % 5 == 1, "").otherwise(F.concat(lang, F.lit(" "), left(5)))),
        _template(chain & (n >= 5), ancestry, {"1": lc, "2": lc, "3": left(3)}, F.concat(lang, F.lit(" "), left(3))),
        _template(chain, ancestry, {"1": lc, "2": F.concat(lc, F.lit("-pro")), "3": F.concat(F.lit("*"), left(2))}, F.when(n % 2 == 0, "").otherwise(F.concat(proto_lang, F.lit(" *"), left(2)))),
        _template(~chain, "m", {"1": lc, "2": left(3)}),
        _template(~chain & (n % 4 == 0), "l", {"1": lc, "2": left(4)}),
        _template(n % 5 == 0, "cog", {"1": after, "2": w}),
        _template(F.col("hub").isNotNull() & (F.col("r") % PER_CONCEPT == 3), "cog", {"1": F.lit("en"), "2": F.col("hub")}),
        _template((n >= 8) | ~chain, "af", {"1": lc, "2": left(4), "3": F.expr("substring(word, 5)"), "4": F.concat(F.lit("-"), right2)}),
        _template(n >= 13, "compound", {"1": F.when(n % 2 == 0, "xx").otherwise(lc), "2": left(6), "3": left(4)}),
        _template(n % 11 == 0, "unk", {"1": lc}),
        _template(n % 13 == 0, "unc", {"1": lc}),
        _template(n % 7 == 4, "cal", {"1": lc}),
        _template(n % 8 == 7, "doublet", {"1": lc, "2": left(6)}),
    )
    ascii_word = w.rlike("^[a-z]+$")
    said = F.concat(reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), SPELLED, F.replace(w, F.lit("ch"), F.when(n % 2 == 0, TIED).otherwise("tʃ"))), F.when(n % 7 == 0, FALLING).otherwise(""))
    sound = lambda ipa, tags, ogg: F.struct(ipa.alias("ipa"), tags.alias("tags"), ogg.alias("ogg_url"), F.lit(None).cast("string").alias("mp3_url"))
    none, no_tags, british = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.array(F.lit("UK"))
    sounds = (
        F.when(ascii_word & (n % 7 == 0), F.array(sound(F.concat(F.lit("["), said, F.lit("]")), british, none)))
        .when(ascii_word & (n % 2 == 0), F.array(sound(F.concat(F.lit("/x"), said, F.lit("/")), british, F.concat(w, F.lit(".ogg"))), sound(F.concat(F.lit(" /ˈ"), said, F.lit("/ ")), no_tags, none)))
        .when(ascii_word, F.array(sound(F.concat(F.lit("/"), said, F.lit("./")), no_tags, none)))
        .when(n % 3 == 0, F.array(sound(none, no_tags, F.concat(w, F.lit(".ogg")))))
    )
    text = (
        F.when(n == 12, None)
        .when(n % 9 == 0, F.concat(F.lit("Possibly from "), left(3), F.lit(".")))
        .when(n % 10 == 1, "The origin is Disputed.")
        .when(
            n % 4 == 1,
            F.concat(F.lit("Etymology tree\n"), proto_lang, F.lit(" *"), left(2), F.lit("\n "), left(3), F.lit(" ("), lang, F.lit(")\nFrom older "), left(3), F.lit(".\nCognates:\n* "), _named(after, NAMES), F.lit(" "), w, F.lit(' ("sense")\n'), left(4)),
        )
        .otherwise(F.concat(F.lit("From "), left(3), F.lit(" and "), left(4), F.lit(".")))
    )
    gloss = lambda x: F.struct(x.alias("glosses"))
    senses = F.array_compact(
        F.array(
            F.when(n % 5 == 2, gloss(F.lit(None).cast("array<string>"))),
            gloss(F.array(F.concat(F.lit("gloss of "), w), F.concat(F.lit("second of "), w))),
            F.when(F.col("r").isNotNull() & (F.col("r") % PER_CONCEPT).isin(1, 2), gloss(F.array(raised(F.col("hub"))))),
        )
    )
    is_hub = (lc == "en") & (F.col("r") % PER_CONCEPT == 0) & (F.col("concept") % 7 != 0)
    listed = base.select(
        F.concat_ws(":", lc, w, F.coalesce("etymology_number", F.lit(0)).cast("string")).alias("entry_id"),
        w,
        lang.alias("lang"),
        lc,
        F.when(pos == 0, "noun").when(pos == 1, "verb").otherwise("adj").alias("pos"),
        "etymology_number",
        text.alias("etymology_text"),
        F.array_compact(made).alias("etymology_templates"),
        senses.alias("senses"),
        sounds.alias("sounds"),
        F.when(is_hub, F.col("translations")).alias("translations"),
    )
    proto = found.select("lang_code", left(2).alias("word")).filter(F.col("word").rlike("^[a-m]")).distinct()
    roots = proto.select(
        F.concat_ws(":", F.concat(lc, F.lit("-pro")), w, F.lit("0")).alias("entry_id"),
        w,
        F.concat(F.lit("Proto-"), lang).alias("lang"),
        F.concat(lc, F.lit("-pro")).alias("lang_code"),
        F.lit("root").alias("pos"),
    )
    return listed.unionByName(roots, allowMissingColumns=True)


def every_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed_id, word, lang): all words of all languages."""
    found = words(spark, sf_dir)
    return found.select("word", _named(F.col("lang_code"), NAMES).alias("lang"), F.concat_ws(":", "lang_code", "word").alias("seed_id"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed_id, word, lang): a query set of words of all languages, by a fixed rule on the id. It grows with the table."""
    return every_word(spark, sf_dir).filter((F.length("word") >= SEED_LENGTH) & (F.substring(F.md5("seed_id"), 1, 2) < SEED_MD5))


_NAME = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
RAISED = f"translate({{}}, '{_SMALL}', '{_LARGE}')"
_SAID = reduce(lambda x, r: f"replace({x}, '{r[0]}', '{r[1]}')", SPELLED, f"replace(word, 'ch', CASE WHEN len % 2 = 0 THEN '{TIED}' ELSE 'tʃ' END)") + f" || CASE WHEN len % 7 = 0 THEN '{FALLING}' ELSE '' END"
_NEXT = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NEXT.items()) + " END"

SQL = f"""
tok AS (SELECT lang AS lc, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents),
wc AS MATERIALIZED (SELECT lc, word, count(*) AS n FROM tok WHERE length(word) >= 3 GROUP BY lc, word),
rk AS (SELECT lc, word, r, r // 10 AS concept FROM (SELECT lc, word, row_number() OVER (PARTITION BY lc ORDER BY n DESC, word) - 1 AS r FROM wc)),
hubs AS (SELECT concept, word AS hub FROM rk WHERE lc = 'en' AND r % 10 = 0),
ent0 AS (
  SELECT wc.lc AS lang_code, wc.word, {_NAME.format('wc.lc')} AS lang, {_NEXT.format('wc.lc')} AS nx, length(wc.word) AS len, n, r, concept, hub,
         unnest(CASE WHEN n >= {COMMON} THEN [1, 2] ELSE [NULL::INT] END) AS etym
  FROM wc LEFT JOIN rk USING (lc, word) LEFT JOIN hubs USING (concept)),
ent1 AS (
  SELECT *, lang_code || ':' || word || ':' || coalesce(etym, 0) AS entry_id,
         ['noun', 'verb', 'adj'][(len + coalesce(etym, 1) - 1) % 3 + 1] AS pos, regexp_matches(word, '^[a-z]+$') AS asc_,
         CASE WHEN len = 12 THEN NULL WHEN len % 9 = 0 THEN 'Possibly from ' || left(word, 3) || '.' WHEN len % 10 = 1 THEN 'The origin is Disputed.'
              WHEN len % 4 = 1 THEN 'Etymology tree' || chr(10) || 'Proto-' || lang || ' *' || left(word, 2) || chr(10) || ' ' || left(word, 3) || ' (' || lang || ')' || chr(10)
                || 'From older ' || left(word, 3) || '.' || chr(10) || 'Cognates:' || chr(10) || '* ' || {_NAME.format('nx')} || ' ' || word || ' ("sense")' || chr(10) || left(word, 4)
              ELSE 'From ' || left(word, 3) || ' and ' || left(word, 4) || '.' END AS etymology_text,
         lang_code = 'en' AND r % 10 = 0 AND concept % 7 <> 0 AS is_hub
  FROM ent0),
ent AS MATERIALIZED (
  SELECT entry_id, word, lang, lang_code, pos, etym, etymology_text, len, r, concept, hub, coalesce(is_hub, false) AS is_hub, nx, asc_,
         CASE WHEN asc_ THEN {_SAID} END AS ipa,
         (asc_ OR len % 3 = 0) AS has_sounds
  FROM ent1
  UNION ALL
  SELECT DISTINCT lc || '-pro:' || left(word, 2) || ':0', left(word, 2), 'Proto-' || {_NAME.format('lc')}, lc || '-pro', 'root', NULL::INT, NULL, 2, NULL::INT, NULL::INT, NULL, false, NULL, false, NULL, false
  FROM wc WHERE regexp_matches(word, '^[a-m]')),
body AS (SELECT *, CASE len % 4 WHEN 0 THEN 'inh' WHEN 1 THEN 'bor' WHEN 2 THEN 'der' ELSE 'derived' END AS anc, len % 6 <> 0 AS ch FROM ent WHERE pos <> 'root'),
tmpl AS (
  SELECT entry_id, 10 AS p, anc AS name, lang_code AS a1, lang_code AS a2, left(word, 5) AS a3, NULL AS a4, CASE WHEN len % 5 = 1 THEN '' ELSE lang || ' ' || left(word, 5) END AS expansion FROM body WHERE ch AND len >= 7
  UNION ALL SELECT entry_id, 20, anc, lang_code, lang_code, left(word, 3), NULL, lang || ' ' || left(word, 3) FROM body WHERE ch AND len >= 5
  UNION ALL SELECT entry_id, 30, anc, lang_code, lang_code || '-pro', '*' || left(word, 2), NULL, CASE WHEN len % 2 = 0 THEN '' ELSE 'Proto-' || lang || ' *' || left(word, 2) END FROM body WHERE ch
  UNION ALL SELECT entry_id, 40, 'm', lang_code, left(word, 3), NULL, NULL, '' FROM body WHERE NOT ch
  UNION ALL SELECT entry_id, 41, 'l', lang_code, left(word, 4), NULL, NULL, '' FROM body WHERE NOT ch AND len % 4 = 0
  UNION ALL SELECT entry_id, 50, 'cog', nx, word, NULL, NULL, '' FROM body WHERE len % 5 = 0
  UNION ALL SELECT entry_id, 51, 'cog', 'en', hub, NULL, NULL, '' FROM body WHERE hub IS NOT NULL AND r % 10 = 3
  UNION ALL SELECT entry_id, 60, 'af', lang_code, left(word, 4), substring(word, 5), '-' || right(word, 2), '' FROM body WHERE len >= 8 OR NOT ch
  UNION ALL SELECT entry_id, 61, 'compound', CASE WHEN len % 2 = 0 THEN 'xx' ELSE lang_code END, left(word, 6), left(word, 4), NULL, '' FROM body WHERE len >= 13
  UNION ALL SELECT entry_id, 70, 'unk', lang_code, NULL, NULL, NULL, '' FROM body WHERE len % 11 = 0
  UNION ALL SELECT entry_id, 80, 'unc', lang_code, NULL, NULL, NULL, '' FROM body WHERE len % 13 = 0
  UNION ALL SELECT entry_id, 90, 'cal', lang_code, NULL, NULL, NULL, '' FROM body WHERE len % 7 = 4
  UNION ALL SELECT entry_id, 95, 'doublet', lang_code, left(word, 6), NULL, NULL, '' FROM body WHERE len % 8 = 7),
names AS (SELECT lang_code AS code, min(lang) AS name FROM ent GROUP BY lang_code),
trans AS (SELECT e.word AS concept_word, e.entry_id AS hub_id, rk.word, {_NAME.format('rk.lc')} AS lang FROM ent e JOIN rk ON e.is_hub AND e.concept = rk.concept)
"""

_ONCE = reduce(lambda x, c: f"regexp_replace({x}, '{c}+', '{c}', 'g')", "bcdfghjklmnpqrstvwxzʃθ", "regexp_replace(replace(replace({}, '͡', ''), 'ⁿ', ''), '[aeiouy]+', 'V', 'g')")
_JOINED = reduce(lambda x, r: f"regexp_replace({x}, '{r[0]}', '{r[1]}', 'g')", {"[td][szʃ]": "K", "[td]θ": "T", "pf|bv": "P", "kx": "K", FALLING: "1"}.items(), _ONCE)
#: The classes of what words are said to sound like.
CLASSES = f"translate({_JOINED}, 'bdfpgckqxhjlrmnstvwzʃθ', 'PTPPKKKKKHJRRMNSTWWSST')"


def oracle(query: str) -> str:
    """A query over the lexicon's tables as one statement. Its rows are put in order, so that all of them are there when
    the first is read."""
    own = query.lstrip()
    return f"SELECT * FROM (WITH {SQL.strip()}{'' if own.startswith(',') else ' '}{own}) ORDER BY ALL"
