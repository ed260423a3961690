"""Column functions and templates against hand-made values."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom import storage
from wordloom.functions import entries as fe
from wordloom.functions import similarity as sim
from wordloom.functions import uncertainty
from wordloom.functions.languages import era_tier, family
from wordloom.functions.normalise import fold, normalise, strip_stars
from wordloom.functions.phonetics import sound_classes
from wordloom.operators import audit, concepts, graph, lookup, templates
from wordloom.operators.edges import with_existence
from wordloom.plans import jobs
from wordloom.schema import ENTRY
from wordloom.sources import tables


def t(name, expansion="", **args):
    return {"name": name, "args": {k.lstrip("_"): v for k, v in args.items()}, "expansion": expansion}


CODES = {"English": "en", "Old French": "fro", "Arabic": "ar", "Ancient Greek": "grc", "Latin": "la", "Middle English": "enm", "Old English": "ang"}


def entry(word, lang="English", templates=(), text=None, pos="noun", number=None, senses=None, sounds=None, translations=None):
    return (word, lang, CODES.get(lang, lang[:3].lower()), pos, number, text, list(templates), senses, sounds, translations)


def kept(spark, rows):
    numbered = [(*r, f"{i:04d}") for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, T.StructType([*ENTRY.fields, T.StructField("entry_id", T.StringType())]))


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "lang, want",
    [
        *((x, "germanic") for x in ("English", "German", "Old English", "Middle English", "Early Modern English", "Proto-Germanic")),
        *((x, "romance") for x in ("French", "Spanish", "Latin")),
        *((x, "other") for x in ("Italian", "Anglo-Norman", "SomeUnknownLanguage")),
        ("Proto-Indo-European", "pie"), ("Ancient Greek", "greek"), ("Russian", "slavic"), ("Sanskrit", "indoiranian"), ("Mandarin", "indoiranian"), ("Arabic", "semitic"),
        ("Finnish", "uralic"), ("Turkish", "turkic"), ("Welsh", "celtic"), ("Georgian", "kartvelian"), ("Armenian", "armenian"), ("Albanian", "albanian"),
    ],
)
def test_family(spark, lang, want):
    assert values(spark, family(F.col("x")), [(lang,)], "x string") == [want]


def test_era(spark):
    names = ["Proto-Indo-European", "Proto-Germanic", "Latin", "Ancient Greek", "Old English", "Middle English", "Anglo-Norman", "Early Modern English", "English", None]
    assert values(spark, era_tier(F.col("x")), [(x,) for x in names], "x string") == [0, 1, 2, 2, 3, 4, 4, 5, 6, 6]


def test_sound_classes(spark):
    raw = [("/ˈælkəmi/",), ("/ˈkɛm.ɪ.stɹi/",), ("/ˈt͡ʃʌkəl/",), ("[aː?]",)]
    found = spark.createDataFrame(raw, "x string").select(fe.clean_ipa(F.col("x")).alias("ipa"))
    got = {r.ipa: (r.tokens, r.dolgo_classes, r.dolgo_consonants, r.dolgo_first2) for r in sound_classes(found).collect()}
    assert got["ælkəmi"] == (["æ", "l", "k", "ə", "m", "i"], "VRKVMV", "RKM", "RK")
    assert got["kɛmɪstɹi"] == (list("kɛmɪstɹi"), "KVMVSTRV", "KMSTR", "KM")
    assert got["t͡ʃʌkəl"] == (["t͡ʃ", "ʌ", "k", "ə", "l"], "KVKVR", "KKR", "KK")
    assert got["aː?"] == (["aː", "?"], "V0", "", "")


SEGMENTED = [
    ("tʃɜːtʃ", "tʃ ɜː tʃ", "KVK"), ("t͡ʃɜːt͡ʃ", "t͡ʃ ɜː t͡ʃ", "KVK"), ("ʧɜːʧ", "ʧ ɜː ʧ", "KVK"), ("dʒʌdʒ", "dʒ ʌ dʒ", "KVK"), ("d͜ʒʌd͜ʒ", "d͜ʒ ʌ d͜ʒ", "KVK"),
    ("tsaɪt", "ts aɪ t", "KVT"), ("pfɛɐ̯t", "pf ɛɐ̯ t", "PVT"), ("d̪z̪a", "d̪z̪ a", "KV"), ("atʰsa", "a tʰs a", "VKV"), ("tsʼa", "tsʼ a", "KV"), ("tɬʼa", "tɬʼ a", "TV"), ("qχa", "qχ a", "KV"),
    ("sts", "s ts", "SK"), ("tsts", "ts ts", "KK"), ("tds", "t ds", "TK"), ("t-ʃa", "t ʃ a", "TSV"), ("t ʃa", "t ʃ a", "TSV"),
    ("ttʃa", "ttʃ a", "KV"), ("mattʃa", "m a ttʃ a", "MVKV"), ("fatto", "f a tt o", "PVTV"), ("fatːo", "f a tː o", "PVTV"), ("fat to", "f a t t o", "PVTTV"), ("ʃʃ", "ʃʃ", "S"),
    ("faɪə", "f aɪə", "PV"), ("teo", "t eo", "TV"), ("a-a", "a a", "VV"), ("ja", "j a", "JV"), ("ɥi", "ɥ i", "WV"), ("bɔ̃", "b ɔ̃", "PV"), ("bãː", "b ãː", "PV"),
    ("ⁿdala", "ⁿd a l a", "TVRV"), ("aⁿda", "a ⁿd a", "VTV"), ("dⁿa", "dⁿ a", "TV"), ("kaʰt", "k a ʰt", "KVT"), ("tʰa", "tʰ a", "TV"), ("bʰaːɾət", "bʰ aː ɾ ə t", "PVRVT"), ("kʷa", "kʷ a", "KV"), ("aʲ", "aʲ", "V"),
    ("ǃa", "ǃ a", "KV"), ("ŋǃʰa", "ŋǃʰ a", "KV"), ("kǃxa", "kǃx a", "KV"), ("ɡ͡ǁa", "ɡ͡ǁ a", "KV"), ("ʘa", "ʘ a", "KV"),
    ("ma˥˩", "m a ˥˩", "MV1"), ("ma⁵¹", "m a ⁵¹", "MV1"), ("ni˧˥hɑʊ̯˨˩˦", "n i ˧˥ h ɑʊ̯ ˨˩˦", "NV1HV1"),
    ("k͡pa", "k͡p a", "KV"), ("ʃtʁaːsə", "ʃ t ʁ aː s ə", "STKVSV"), ("ɪŋɡlɪʃ", "ɪ ŋ ɡ l ɪ ʃ", "VNKRVS"), ("", "", ""), ("͡", "", ""), ("ʰ", "", ""), ("??", "? ?", "00"),
]


def test_segments(spark):
    """Affricates, clicks, diphthongs, doubled consonants and tones, one segment and one class each, however they are written."""
    assert len({ipa for ipa, _, _ in SEGMENTED}) == len(SEGMENTED) >= 50
    found = spark.createDataFrame([(ipa,) for ipa, _, _ in SEGMENTED], "ipa string")
    got = {r.ipa: (" ".join(r.tokens), r.dolgo_classes) for r in sound_classes(found).collect()}
    assert got == {ipa: (cut, classes) for ipa, cut, classes in SEGMENTED}
    r = sound_classes(spark.createDataFrame([("ni˧˥hɑʊ̯˨˩˦",)], "ipa string")).first()
    assert (r.dolgo_consonants, r.dolgo_first2) == ("N1H1", "N1")  # tones stay among the consonants; only vowels, unknown and blank go


def test_prefixes_in_one_case(spark):
    words = ["ßkeit", "SSK", "sska", "straße", "STRASSEN", "İzmir", "izmir", "Éclair", "éCLAT", "eclat"]
    e = kept(spark, [entry(w, translations=[("x", "French")]) for w in words] + [entry("ssk", lang="French", translations=[("x", "English")]), entry("sskno")])
    asked = ["ßK", "ssk", "ẞk", "STRASS", "straß", "S", "İ", "i", "I", "éc", "É", "e"]
    got = {}
    for r in concepts.suggest(spark.createDataFrame([(q,) for q in asked], "q string"), e, 20).collect():
        got.setdefault(r.q, set()).add(r.concept)
    sharp = {"ßkeit", "SSK", "sska"}
    assert got["ßK"] == got["ssk"] == got["ẞk"] == sharp and got["STRASS"] == got["straß"] == {"straße", "STRASSEN"}
    assert got["S"] == sharp | {"straße", "STRASSEN"} and got["İ"] == {"İzmir"} and got["éc"] == got["É"] == {"Éclair", "éCLAT"} and got["e"] == {"eclat"}
    assert "izmir" in got["i"] and got["i"] == got["I"]


def test_prefix_join_plans(spark):
    """A small query set is broadcast, and no beginnings of words are shuffled; a large one joins by a shuffle, with the same rows."""
    e = kept(spark, [entry(w) for w in ("fire", "fires", "fir", "wire", "Fire")])
    asked = spark.createDataFrame([("fir",), ("fire",), ("x",), ("",)], "q string")
    want = sorted([("fir", w, w == "fir") for w in ("fire", "fires", "fir")] + [("fire", "fire", True), ("fire", "fires", False)] + [("", w, False) for w in ("fire", "fires", "fir", "wire", "Fire")])
    hits = lookup.prefix_hits(asked, e.select("word"))
    assert "Exchange hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.q, r.word, r.exact) for r in hits.collect()) == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted((r.q, r.word, r.exact) for r in lookup.prefix_hits(asked, e.select("word")).collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_best_ipa(spark):
    rows = [("a", [(None, None, "x.ogg", None), ("/t/", ["US"], None, None), ("/u/", None, None, None)]), ("b", [("/t/", [], None, None)]), ("c", []), ("d", None)]
    df = spark.createDataFrame(rows, "k string, sounds array<struct<ipa:string,tags:array<string>,ogg_url:string,mp3_url:string>>")
    got = {r.k: r for r in df.select("k", fe.best_ipa(F.col("sounds")).alias("best"), fe.first_ipa(F.col("sounds")).alias("first"), F.size(fe.audio(F.col("sounds"))).alias("n")).collect()}
    assert [(got[k].best, got[k]["first"]) for k in "abcd"] == [("u", "/t/"), ("t", "/t/"), (None, None), (None, None)] and got["a"].n == 1


def test_normalise(spark):
    df = spark.createDataFrame([("*wīną",), ("vīnum",), ("*wīn",), ("øðþ",), ("**a",)], "w string")
    assert {r.w: r.n for r in normalise(df, "w", "n").collect()} == {"*wīną": "wina", "vīnum": "vinum", "*wīn": "win", "øðþ": "øðþ", "**a": "*a"}
    assert {r.w: r.n for r in fold(df, "w", "n").collect()}["*wīną"] == "*wina"
    assert values(spark, strip_stars(F.col("w")), [("**a",)], "w string") == ["a"]


def test_similarity(spark):
    rows = [("KNS", "KN"), ("PR", "TS"), ("", ""), ("", "K"), ("KNPRST", "KN"), ("A" * 16, "A" * 15 + "B")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r) for r in df.select(sim.distance(F.col("a"), F.col("b")), sim.rounded(sim.similarity(F.col("a"), F.col("b"))), sim.common_prefix(F.col("a"), F.col("b"))).collect()]
    assert [round(g[0], 6) for g in got] == [0.333333, 1.0, 0.0, 1.0, 0.666667, 0.0625]
    assert [g[2] for g in got] == ["KN", "", "", "", "KN", "A" * 15]
    assert values(spark, sim.rounded(F.lit(0.0625)), [(1,)], "x int") == [0.062]


def test_uncertainty(spark):
    rows = [entry("a", templates=[t("unk")], text="disputed"), entry("b", templates=[t("m"), t("unc")]), entry("c", text="There are Two Interpretations, possibly from x"), entry("d", text="Perhaps from y"), entry("e"), entry("f", text="")]
    got = {r.word: (r.u.is_uncertain, r.u.type, r.u.source, r.u.confidence) for r in kept(spark, rows).select("word", uncertainty.classify().alias("u")).collect()}
    assert got == {
        "a": (True, "unknown", "template:unk", "high"), "b": (True, "uncertain", "template:unc", "high"), "c": (True, "disputed", "text:two interpretations", "medium"),
        "d": (True, "uncertain", "text:perhaps from", "medium"), "e": (False, None, None, "high"), "f": (False, None, None, "high"),
    }


ALCHEMY = entry("alchemy", templates=[t("root", _1="en", _2="ine-pro"), t("der", _1="en", _2="fro", _3="alkimie"), t("der", _1="en", _2="la-med", _3="alchēmia"), t("der", _1="en", _2="ar", _3="كيمياء"), t("der", _1="en", _2="grc", _3="χυμείᾱ"), t("der", _1="en", _2="", _3="x")])
CHEMISTRY = entry("chemistry", templates=[t("suf", _1="en", _2="chemist", _3="ry"), t("derived", _1="en", _2="la", _3="alchimista"), t("derived", _1="en", _2="ar", _3="كيمياء")])
CHUCKLE = entry("chuckle", templates=[t("af", _1="en", _2="chuck", _3="-le")])


def names(spark, *more):
    return spark.createDataFrame([("en", "English"), ("fro", "Old French"), ("ar", "Arabic"), ("grc", "Ancient Greek"), ("la", "Latin"), ("enm", "Middle English"), ("ang", "Old English"), *more], "lang_code string, lang string")


def test_chains(spark):
    e, n = kept(spark, [ALCHEMY, CHEMISTRY, CHUCKLE]), names(spark)
    seeds = e.select(F.col("word").alias("seed_id"), "word", "lang", F.lit(0).alias("level"), F.col("entry_id").alias("found_id"))
    nodes, edges = graph.chain_graph(seeds, e, n)
    got = sorted((r.level, r.id) for r in nodes.collect() if r.seed_id == "alchemy")
    assert got == [(-4, "χυμείᾱ:Ancient Greek"), (-3, "كيمياء:Arabic"), (-2, "alchēmia:la-med"), (-1, "alkimie:Old French"), (0, "alchemy:English")]
    chem = sorted((r.ord, r.from_id, r.to_id, r.label) for r in edges.collect() if r.seed_id == "chemistry")
    assert chem == [(1, "alchimista:Latin", "chemistry:English", "der"), (2, "كيمياء:Arabic", "alchimista:Latin", "der")]
    assert nodes.filter("seed_id = 'chuckle'").count() == 1
    assert templates.ancestry(e, n, ("inh",)).count() == 0 and templates.ancestry(e, n, ("der",)).count() == 6
    assert templates.raw_names(()) == [] and templates.raw_names(("der",)) == ["der", "derived"]


def test_mentions_and_components(spark):
    e, n = kept(spark, [ALCHEMY, CHEMISTRY, CHUCKLE]), names(spark)
    got = sorted((r.word, r.ord, r.mention, r.role, r.source_template) for r in templates.mentions(e, n).collect())
    assert got == [("chemistry", 1, "chemist", "component", "suf"), ("chemistry", 2, "ry", "component", "suf"), ("chuckle", 1, "chuck", "component", "af")]
    found = sorted((r.to_word, r.from_word) for r in templates.component_edges(e, n).collect())
    assert found == [("chemistry", "chemist"), ("chemistry", "ry"), ("chuckle", "chuck")]


def test_sections_and_urls(spark):
    text = "Etymology tree\n Old English wæter\nwater (English)\nFrom Old English.\nmore\nCognates:\n* Scots watter (\"water\")\nx"
    r = spark.createDataFrame([(text,)], "x string").select(fe.sections(F.col("x")).alias("s")).first().s
    assert (r.tree, r.prose, r.cognates) == (["Old English wæter", "water (English)"], ["From Old English.", "more"], ['* Scots watter ("water")', "x"])
    lines = [tuple(x) for x in values(spark, fe.tree_line(F.col("x")), [(x,) for x in r.tree], "x string")]
    assert lines == [("Old English", "wæter"), ("English", "water")]
    assert [tuple(x) for x in values(spark, fe.cognate_line(F.col("x")), [(x,) for x in r.cognates], "x string")] == [("Scots", "watter", "water"), (None, None, None)]
    url = lambda w, lang: values(spark, fe.page_url(F.col("w"), F.col("l")), [(w, lang)], "w string, l string")[0]
    assert url("*wīną", "Proto-Germanic") == "https://en.wiktionary.org/wiki/Reconstruction:Proto-Germanic/w%C4%ABn%C4%85"
    assert url("it's (a) b", "Old English") == "https://en.wiktionary.org/wiki/it's%20(a)%20b#Old%20English"


def test_json_lines(spark, tmp_path):
    lines = ['{"word":"a","lang":"English","etymology_number":"odd","sounds":[{"ipa":"x","tags":[]}]}', "  ", "not json", '{"word":', '{"word":"b","extra":[1,2]}']
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    got = {r.word: r for r in tables.read_json_lines(spark, f"file://{tmp_path}/d.jsonl", 2).collect()}
    assert set(got) == {"a", "b"} and got["a"].etymology_number is None and got["a"].sounds[0].tags == [] and got["b"].lang is None
    assert len({r.entry_id for r in got.values()}) == 2


def test_edge_lengths(spark):
    rows = [("s", f"leaf{i}", "word", "x") for i in range(4)] + [("s", "root", "mid", "x"), ("s", "mid", "word", "x")]
    got = {(r.from_id, r.to_id): round(r.length, 3) for r in graph.edge_lengths(spark.createDataFrame(rows, "seed_id string, from_id string, to_id string, label string")).collect()}
    assert (got["root", "mid"], got["mid", "word"], got["leaf0", "word"]) == (210.0, 260.0, round(110 + 50 * math.log2(7), 3))


def test_clusters_and_pairs(spark):
    rows = [("c", "a", "KN", "KN"), ("c", "b", "KNPRST", "KN"), ("c", "d", "PR", "PR"), ("c", "e", "", ""), ("c", "f", "K", "K"), ("c", "g", "K", "K")]
    words = spark.createDataFrame(rows, "concept string, id string, dolgo_consonants string, dolgo_first2 string")
    assert [(r.id, r.label, r.words) for r in concepts.clusters(words).collect()] == [("cluster_KN", "K-N group", ["a", "b"])]
    got = {(r.source, r.target): (r.similarity, r.turchin_match, r.shared_classes) for r in concepts.pairs(words, 0.9).collect()}
    assert got == {("a", "b"): (0.333, True, "KN"), ("f", "g"): (1.0, False, "K")}
    assert {(r.source, r.target) for r in concepts.select_pairs(concepts.pairs(words, 0.0), 0.5).collect()} >= {("a", "b"), ("f", "g"), ("a", "f")}


def test_tiers(spark):
    rows = [("s", "d", "Old English"), ("s", "e", "Old English"), ("s", "f", "Latin"), ("s", "a", "English"), ("s", "b", "German"), ("s", "c", "French")]
    got = {(r.tier, r.family): r.ids for r in graph.tiers(spark.createDataFrame(rows, "seed_id string, id string, language string")).collect()}
    assert got == {(2, "romance"): ["f"], (3, "germanic"): ["d", "e"], (6, "germanic"): ["a", "b"], (6, "romance"): ["c"]}


def test_drift_and_fingerprints(spark):
    old, new = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 5)], "k int, v string, at int"), spark.createDataFrame([(1, "a", 9), (2, "c", 9), (4, "d", 9)], "k int, v string, at int")
    assert {r.k: r.state for r in audit.drift(old, new, ["k"], ["at"]).collect()} == {1: "none", 2: "drift", 3: "missing", 4: "missing"}
    nodes = spark.createDataFrame([("s", "b"), ("s", "a")], "seed_id string, id string")
    assert graph.fingerprints(nodes).first().hash == graph.fingerprints(nodes.orderBy("id")).first().hash


def test_polysemy_and_details(spark):
    rows = [entry("bank", number=1, pos="noun", senses=[{"glosses": None}, {"glosses": ["river"]}]), entry("bank", number=1, pos="verb", senses=[{"glosses": ["tilt"]}]), entry("bank", number=2, senses=[{"glosses": ["money"]}]), entry("one", number=1)]
    got = sorted((r.etymology_number, r.pos, r.first_gloss) for r in lookup.polysemy(kept(spark, rows)).collect())
    assert got == [(1, "noun, verb", "river"), (2, "noun", "money")]
    hits = lookup.search(spark.createDataFrame([("ba",), ("bank",)], "q string"), kept(spark, rows))
    assert sorted((r.q, r.etymology_number) for r in hits.collect() if r.q == "bank") == [("bank", 1), ("bank", 2)]
    assert [(r.q, r.etymology_number) for r in hits.collect() if r.q == "ba"] == [("ba", None)]


def test_strict_etymology(spark):
    """The number holds for the normalised form too; without a number any entry will do."""
    e = kept(spark, [entry("win", number=1), entry("win", number=2), entry("plain")])
    asked = [("a", "*wīn", 1), ("b", "*wīn", 3), ("c", "*wīn", None), ("d", "win", 2), ("e", "plain", None), ("f", "plain", 1), ("g", "nothing", None)]
    wanted = spark.createDataFrame([(k, w, "English", n) for k, w, n in asked], "k string, word string, lang string, etym int")
    strict = {r.k: r.found_id for r in lookup.with_etymology(wanted, e, True).collect()}
    assert strict == {"a": "0000", "b": None, "c": "0000", "d": "0001", "e": "0002", "f": None, "g": None}
    loose = {r.k: r.found_id for r in lookup.with_etymology(wanted, e, False).collect()}
    assert loose == {"a": "0000", "b": "0000", "c": "0000", "d": "0001", "e": "0002", "f": "0002", "g": None}


def plain_hops(starts, edges):
    """(seed, id, hops) by a walk over each seed's edges."""
    out = set()
    for seed in {s for s, _ in starts}:
        hops = {i: 0 for s, i in starts if s == seed}
        k = 0
        while any(h == k for h in hops.values()):
            for s, a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if s == seed and hops.get(x) == k:
                        hops.setdefault(y, k + 1)
            k += 1
        out |= {(seed, i, h) for i, h in hops.items()}
    return out


@pytest.mark.parametrize("in_memory", [0, 12, graph.IN_MEMORY])
def test_hops_have_no_limit(spark, in_memory):
    """In a task, by rounds of joins, and some graphs so and some so."""
    edges = [("s", f"n{i}", f"n{i + 1}") for i in range(9)] + [("s", "n3", "n3"), ("s", "n9", "n0")] + [("t", f"n{i}", f"n{i * 7 % 11}") for i in range(20)] + [("u", "x", "y")]
    starts = [("s", "n0"), ("s", "n0"), ("t", "n1"), ("t", "n2"), ("v", "alone"), ("u", "elsewhere")]
    got = graph.hop_distances(spark.createDataFrame(starts, "seed_id string, id string"), spark.createDataFrame([(*e, "x") for e in edges], "seed_id string, from_id string, to_id string, label string"), in_memory)
    assert {(r.seed_id, r.id, r.hops) for r in got.collect()} == plain_hops(set(starts), edges) and got.count() == len(plain_hops(set(starts), edges))


def test_hops_along_a_line(spark):
    """200 nodes in a line take a few jobs, not one a hop."""
    line = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}", "x") for i in range(199)], "seed_id string, from_id string, to_id string, label string")
    start = spark.createDataFrame([("s", "n0")], "seed_id string, id string")
    spark.sparkContext.setJobGroup("hops", "hops")
    try:
        assert {r.id: r.hops for r in graph.hop_distances(start, line).collect()} == {f"n{i}": i for i in range(200)}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("hops")) < 10
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def build(spark, rows, seeds, **options):
    e = kept(spark, rows)
    n = tables.language_names(e)
    components = with_existence(templates.component_edges(e, n), e)
    wanted = spark.createDataFrame([(f"{w}", w, lang) for w, lang in seeds], "seed_id string, word string, lang string")
    nodes, edges = graph.Trees(e, components, n, **options).build(wanted)
    return {r.id: r.level for r in nodes.collect()}, {(r.from_id, r.to_id, r.label) for r in edges.collect()}


def test_tree_chain_and_orphan(spark):
    rows = [entry("cheese", templates=[t("inh", _1="en", _2="enm", _3="chese"), t("inh", _1="en", _2="ang", _3="ciese")]), entry("chese", "Middle English"), entry("ciese", "Old English")]
    nodes, edges = build(spark, rows, [("cheese", "English")])
    assert nodes == {"cheese:English": 0, "chese:Middle English": -1, "ciese:Old English": -2}
    assert edges == {("chese:Middle English", "cheese:English", "inh"), ("ciese:Old English", "chese:Middle English", "inh")}
    assert build(spark, rows, [("nothing", "English")]) == ({"nothing:English": 0}, set())


def test_tree_children_only_immediate_and_capped(spark):
    rows = [entry("root")] + [entry(f"d{i:03d}", templates=[t("der", _1="en", _2="en", _3="root")]) for i in range(54, -1, -1)]
    nodes, _ = build(spark, rows, [("root", "English")], types=("der",))
    assert {k for k in nodes if k != "root:English"} == {f"d{i:03d}:English" for i in range(50)}
    grand = [entry("root"), entry("mid", templates=[t("inh", _1="en", _2="en", _3="root")]), entry("leaf", templates=[t("inh", _1="en", _2="en", _3="mid"), t("inh", _1="en", _2="en", _3="root")])]
    nodes, edges = build(spark, grand, [("root", "English")])
    assert nodes == {"root:English": 0, "mid:English": 1, "leaf:English": 2} and ("root:English", "leaf:English", "inh") not in edges
    assert set(build(spark, grand, [("root", "English")], max_descendants=1)[0]) == {"root:English", "mid:English"}


def test_tree_mentions_and_components(spark):
    """A component that a bare chain already met as a mention is not traced upward; one of a longer chain is."""
    parts = t("af", _1="en", _2="chuck", _3="-le")
    others = [entry("chuck", templates=[t("inh", _1="en", _2="ang", _3="cocc")]), entry("cocc", "Old English")]
    nodes, edges = build(spark, [entry("chuckle", templates=[parts, t("m", _1="en", _2="ghost")]), *others], [("chuckle", "English")])
    assert nodes == {"chuckle:English": 0, "chuck:English": -1} and edges == {("chuck:English", "chuckle:English", "component")}
    nodes, edges = build(spark, [entry("chuckle", templates=[parts, t("inh", _1="en", _2="enm", _3="chukel")]), *others], [("chuckle", "English")])
    assert nodes == {"chuckle:English": 0, "chukel:enm": -1, "chuck:English": -1, "cocc:Old English": -2}
    assert edges == {("chukel:enm", "chuckle:English", "inh"), ("chuck:English", "chuckle:English", "component"), ("cocc:Old English", "chuck:English", "inh")}


def test_tree_cognate_rounds(spark):
    rows = [entry(w, templates=[t("cog", _1="en", _2=x)]) for w, x in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"))]
    nodes, edges = build(spark, rows, [("a", "English")], types=("cog",))
    assert nodes == {"a:English": 0, "b:English": 0, "c:English": 0} and len(edges) == 2


def test_rounds_leave_the_dictionary_where_it_lies(spark):
    """No look-up of a tree shuffles the dictionary: only what it looks for."""
    rows = [entry("a", templates=[t("inh", _1="en", _2="en", _3="b")]), entry("b", number=1), entry("b", number=2)]
    e = kept(spark, rows)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        own = lookup.Dictionary(e)
        wanted = storage.materialise(spark.createDataFrame([("s", "a", "English", 0, 1), ("s", "*b", "English", 0, None), ("s", "b", "English", 0, 2)], "seed_id string, word string, lang string, level int, etym int"))
        found = lookup.numbered_or_any(wanted, own)
        assert sorted((r.word, r.found_id) for r in found.collect()) == [("*b", "0001"), ("a", "0000"), ("b", "0002")]
        met = found.join(own.facts.select(F.col("entry_id").alias("found_id"), "etymology_text"), "found_id", "left")
        shown = met._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = [len(line) - len(line.lstrip(" :+-*|")) for line in shown]
        scans = [i for i, line in enumerate(shown) if "Scan parquet" in line and ("wordloom_words" in line or "wordloom_facts" in line)]
        assert len(scans) >= 3
        for i in scans:  # upwards from a scan: a join is met before any exchange
            above, d = [], depth[i]
            for k in range(i - 1, -1, -1):
                if depth[k] < d:
                    above, d = [*above, shown[k]], depth[k]
            assert "SortMergeJoin" in next(x for x in above if "Join" in x or "Exchange" in x), (shown[i], above)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_snapshots(spark, tmp_path):
    """A write that fails, and one that is under way, leave readers the table as it was."""
    path = f"file://{tmp_path}/table"
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "n int")
    there = lambda: sorted(r.n for r in storage.read_published(spark, path).collect())
    assert storage.published(spark, path) == []
    storage.publish(rows(1, 2), path)
    before = storage.read_published(spark, path)
    with pytest.raises(Exception, match="no luck"):
        storage.publish(rows(3, 4).withColumn("n", F.when(F.col("n") == 4, F.raise_error(F.lit("no luck"))).otherwise(F.col("n"))), path)
    assert there() == [1, 2]
    storage.publish(rows(5), path, add=True)
    assert there() == [1, 2, 5]
    storage.publish(storage.read_published(spark, path).filter("n > 1"), path)  # made of what it replaces
    assert there() == [2, 5] and sorted(r.n for r in before.collect()) == [1, 2]
    storage.publish(rows(9), path)
    assert there() == [9] and len(list((tmp_path / "table").iterdir())) <= 4  # the oldest, and what failed, are gone
    with pytest.raises(Exception, match="no luck"):
        tables.write_entries(kept(spark, [entry("x")]).withColumn("word", F.raise_error(F.lit("no luck")).cast("string")), path, 2)
    assert there() == [9]


def plain_pairs(words, threshold):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    out = set()
    for c, i, a in words:
        for d, j, b in words:
            if c == d and i < j and a and b:
                sim = 1 - distance(a, b) / max(len(a), len(b))
                match = len(a) >= 2 and len(b) >= 2 and a[:2] == b[:2]
                if sim >= threshold or match:
                    out.add((c, i, j, match))
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 1.0])
def test_pairs_of_small_and_large_concepts(spark, monkeypatch, threshold):
    monkeypatch.setattr(concepts, "TOGETHER", 20)
    rng = random.Random(6)
    words = [(c, f"w{k:03d}", "".join(rng.choices("KTPRMNSH", k=rng.randint(0, 6)))) for c, n in (("hot", 90), ("warm", 21), ("cold", 20), ("tiny", 2)) for k in range(n)]
    got = concepts.pairs(spark.createDataFrame(words, "concept string, id string, dolgo_consonants string"), threshold).collect()
    assert {(r.concept, r.source, r.target, r.turchin_match) for r in got} == plain_pairs(words, threshold) and len(got) == len(plain_pairs(words, threshold))


def test_hot_concept_is_spread(spark):
    """The comparisons of one concept of 20,000 words are dealt to several tasks."""
    rng = random.Random(8)
    words = [("hot", f"w{k}", "".join(rng.choices("KTPRMNSHJW", k=3))) for k in range(20_000)]
    large = storage.materialise(spark.createDataFrame(words, "concept string, id string, dolgo_consonants string"))
    found = storage.materialise(concepts.pairs(large, 0.8).withColumn("task", F.spark_partition_id()))
    made = {r.task: r["count"] for r in found.groupBy("task").count().collect()}
    assert len(made) >= 3 and max(made.values()) < 0.6 * sum(made.values())


def test_jobs(spark, tmp_path):
    e = kept(spark, [ALCHEMY, CHEMISTRY, CHUCKLE, entry("chuck", sounds=[("/tʃʌk/", None, None, None)]), entry("fire", translations=[("chuck", "English")], sounds=[("/faɪə/", None, None, None)])])
    e.drop("entry_id").write.json(f"file://{tmp_path}/in")
    jobs.load_dictionary(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", 2)
    jobs.load_dictionary(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", 2)  # nothing new the second time
    assert storage.read_published(spark, f"file://{tmp_path}/out/phonetics").count() == 2
    assert storage.read_published(spark, f"file://{tmp_path}/out/component_edges").filter("from_exists").count() == 1
    maps = jobs.concept_maps(spark, f"file://{tmp_path}/out", spark.createDataFrame([("fire",)], "concept string"))
    assert {r.id for r in maps["words"].collect()} == {"fire:English", "chuck:English"}
    nodes, _ = jobs.trees(spark, f"file://{tmp_path}/out", spark.createDataFrame([("s", "chuckle", "English")], "seed_id string, word string, lang string"))
    assert {r.id for r in nodes.collect()} == {"chuckle:English", "chuck:English"}
