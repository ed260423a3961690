"""Families and eras of languages by their names. Apply them to the language table, then join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family and the names (or parts of names) that it is known by, in the order they are tried.
FAMILIES = {
    "germanic": "english|german|norse|dutch|frisian|gothic|proto-germanic|proto-west germanic|saxon|scots|yiddish|afrikaans|plautdietsch|limburgish|luxembourgish|cimbrian|alemannic|bavarian|vilamovian|saterland|icelandic|faroese|norwegian|swedish|danish",
    "romance": "latin|italic|french|spanish|portuguese|romanian|proto-italic|catalan|occitan|sardinian|galician|venetian|sicilian|neapolitan|asturian|aragonese|friulian|ladin|romansch|aromanian|dalmatian",
    "greek": "greek",
    "pie": "proto-indo-european",
    "slavic": "russian|polish|czech|slovak|serbian|croatian|bulgarian|ukrainian|slovene|proto-slavic|old church slavonic|belarusian|macedonian|sorbian|rusyn|kashubian",
    "celtic": "irish|welsh|scottish gaelic|breton|cornish|manx|proto-celtic|old irish|gaulish|celtiberian|galatian",
    "indoiranian": "sanskrit|hindi|persian|urdu|bengali|punjabi|avestan|pali|proto-indo-iranian|farsi|dari|tajik|pashto|kurdish|balochi|marathi|gujarati|nepali|sinhalese|romani|ossetian|sogdian|bactrian",
    "semitic": "arabic|hebrew|aramaic|akkadian|proto-semitic|amharic|tigrinya|maltese|phoenician|ugaritic|ge'ez|syriac",
    "uralic": "finnish|hungarian|estonian|proto-uralic|proto-finnic|sami|karelian|veps|mari|mordvin|udmurt|komi|mansi|khanty|nenets|selkup",
    "baltic": "lithuanian|latvian|proto-baltic|proto-balto-slavic|old prussian|samogitian",
    "turkic": "turkish|ottoman|azerbaijani|kazakh|uzbek|uyghur|turkmen|kyrgyz|tatar|bashkir|chuvash|proto-turkic|gagauz|crimean tatar|yakut",
    "sinotibetan": "chinese|mandarin|cantonese|tibetan|burmese|proto-sino-tibetan|middle chinese|old chinese|wu|min|hakka|shanghainese|hokkien",
    "austronesian": "indonesian|malay|tagalog|javanese|proto-austronesian|hawaiian|maori|samoan|tongan|fijian|cebuano|ilocano|sundanese|malagasy|chamorro|rapanui",
    "japonic": "japanese|proto-japonic|okinawan|ryukyuan|old japanese",
    "koreanic": "korean|proto-koreanic|middle korean|old korean|jeju",
    "bantu": "swahili|zulu|xhosa|yoruba|igbo|proto-bantu|lingala|shona|kikuyu|luganda|kinyarwanda|setswana|sesotho|chichewa",
    "dravidian": "tamil|telugu|malayalam|kannada|proto-dravidian|brahui|tulu|gondi",
    "kartvelian": "georgian|mingrelian|svan|laz|proto-kartvelian|old georgian",
    "armenian": "armenian|proto-armenian|classical armenian|old armenian",
    "albanian": "albanian|proto-albanian|gheg|tosk",
}
# Pattern and tier, in the order they are tried.
ERAS = (
    ("(?i)^Proto-(Indo-European|Uralic|Afro-Asiatic|Sino-Tibetan|Austronesian|Niger-Congo|Trans-New Guinea|Dravidian|Turkic|Mongolic|Japonic|Koreanic|Tai|Austroasiatic|Nilo-Saharan)$", 0),
    ("^Proto-", 1),
    ("^(Ancient |Classical |Biblical )", 2),
    ("(?i)^(Latin|Sanskrit|Avestan|Gothic|Akkadian|Sumerian|Tocharian [AB]|Pali|Oscan|Umbrian|Mycenaean Greek|Hittite|Luwian|Lydian|Lycian|Sogdian|Bactrian|Prakrit|Elamite)$", 2),
    ("^Old ", 3),
    ("(?i)^Middle |^Anglo-Norman$", 4),
    ("^Early Modern ", 5),
)
OTHER, MODERN = "other", 6


def family(lang: Column) -> Column:
    return F.coalesce(*(F.when(lang.rlike(f"(?i){pattern}"), name) for name, pattern in FAMILIES.items()), F.lit(OTHER))


def era_tier(lang: Column) -> Column:
    return F.coalesce(*(F.when(lang.rlike(pattern), tier) for pattern, tier in ERAS), F.lit(MODERN))
