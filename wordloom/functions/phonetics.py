"""Sound classes of IPA strings, after Dolgopolsky's scheme: P T S K M N R W J H, vowels V and tones 1; unknown symbols 0.

A string is first cut into symbols, each with its marks, and these are joined into segments: affricates, clicks with what
they are released from, and whatever a tie bar joins, by the longest match in a trie of segments; vowels that follow each
other (diphthongs); doubled consonants; tone letters that follow each other. White space, hyphens and bars keep
neighbours apart. So an affricate is one segment of one class whether it is written with a tie bar, without, or as a
ligature.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The symbols of each class.
CLASSES = {
    "V": "aeiouyæøœɶɐɑɒɔəɘɵɞɜɚɝɛɤɨʉɯɪʏʊʌɿʅ",
    "P": "pbfɸβɓ",
    "T": "tdʈɖθðɗ",
    "S": "szʃʒʂʐɕʑɧ",
    "K": "kgɡcɟqɢxɣχʁçʝɠʛʄʦʣʧʤʨʥʘǀǁǂǃ",
    "M": "mɱ",
    "N": "nɳɲŋɴ",
    "R": "rlɹɾɽɻʀɭʎʟɫɺɬɮ",
    "W": "wvʋʍɥ",
    "J": "jɰ",
    "H": "hɦħʕʔʜʢ",
    "1": "˥˦˧˨˩¹²³⁴⁵⁰",
}
_CLASS = {symbol: name for name, symbols in CLASSES.items() for symbol in symbols}
_CLICKS = "ʘǀǁǂǃ"
# Stops and the fricatives that they release into as one sound, and what comes before a click.
_AFFRICATES = {"td": "szʃʒɕʑʂʐθðɬɮ", "ʈɖ": "ʂʐ", "c": "çɕ", "ɟ": "ʝʑ", "p": "fɸ", "b": "vβ", "k": "xχ", "gɡ": "ɣ", "q": "χ", "ɢ": "ʁ"}
_BEFORE_CLICKS = "kgɡŋqɢɴ"
SEGMENTS = [
    *(pair for stops, releases in _AFFRICATES.items() for pair in product(stops, releases)),
    *product(_BEFORE_CLICKS, _CLICKS),
    *product(_CLICKS, "xχ"),
    *product(_BEFORE_CLICKS, _CLICKS, "xχ"),
]
_TIES, _BREAKS = "͜͡", "-.|‖‿–"
#: Raised letters that belong to what follows them where no consonant is before them.
_BEFORE = "ʰʱⁿᵐᵑ"
NOT_CONSONANTS = "V0_"
SCHEMA = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("classes", T.StringType())])


def _trie(segments: list[tuple[str, ...]]) -> dict:
    """Nested tables by symbol; "" marks the end of a segment."""
    root: dict = {}
    for segment in segments:
        node = root
        for symbol in segment:
            node = node.setdefault(symbol, {})
        node[""] = True
    return root


_TRIE = _trie(SEGMENTS)


@dataclass
class Symbol:
    """A base symbol with its marks. ``tied``: to the next one; ``apart``: from the one before."""

    base: str
    text: str
    apart: bool
    tied: bool = False

    @property
    def kind(self) -> str:
        return _CLASS.get(self.base) or _CLASS.get(unicodedata.normalize("NFD", self.base)[0], "0")


def symbols(ipa: str) -> list[Symbol]:
    """The base symbols of a string. Marks belong to the symbol before, those of _BEFORE after a vowel or at the beginning
    to the consonant that follows."""
    out: list[Symbol] = []
    waiting, apart = "", True
    for c in ipa:
        if c.isspace() or c in _BREAKS:
            if out:
                out[-1].text += waiting
                waiting = ""
            apart = True
        elif c in _TIES:
            if out and not apart:
                out[-1].text += c
                out[-1].tied = True
        elif _CLASS.get(c) != "1" and (c in "ːˑ" or unicodedata.category(c) in ("Mn", "Lm", "Sk")):
            if apart or waiting or (c in _BEFORE and out[-1].kind in "V1"):
                waiting += c
            else:
                out[-1].text += c
        else:
            new = Symbol(c, c, apart)
            if waiting and new.kind in "V1" and out and not apart:
                out[-1].text += waiting
            else:
                new.text = waiting + c
            out.append(new)
            waiting, apart = "", False
    if out:
        out[-1].text += waiting
    return out


def segments(ipa: str) -> list[list[Symbol]]:
    """The symbols of each segment."""
    all_, out, i = symbols(ipa), [], 0

    def follows(k: int) -> bool:
        return k < len(all_) and not all_[k].apart

    def doubled(k: int) -> int:
        while follows(k) and all_[k].base == all_[k - 1].base and all_[k].kind != "0":
            k += 1
        return k

    while i < len(all_):
        kind, end = all_[i].kind, i + 1
        if kind in "V1":
            while follows(end) and (all_[end].kind == kind or all_[end - 1].tied):
                end += 1
        else:
            end = k = doubled(end)
            node = _TRIE.get(all_[i].base, {})
            while follows(k) and all_[k].base in node:  # the longest path that ends a segment
                node = node[all_[k].base]
                k = doubled(k + 1)
                end = k if "" in node else end
            while follows(end) and all_[end - 1].tied:
                end = doubled(end + 1)
        out.append(all_[i:end])
        i = end
    return out


def sound_class(segment: list[Symbol]) -> str:
    """That of the first symbol; K for affricates of a dental and a sibilant, and for clicks."""
    kinds = [s.kind for s in segment]
    if (kinds[0] == "T" and "S" in kinds) or any(s.base in _CLICKS for s in segment):
        return "K"
    return kinds[0]


def tokens(ipa: str) -> list[str]:
    return ["".join(s.text for s in segment) for segment in segments(ipa)]


@F.pandas_udf(SCHEMA)
def _classes(ipa: pd.Series) -> pd.DataFrame:
    cut = ipa.map(segments)
    return pd.DataFrame({"tokens": cut.map(lambda x: ["".join(s.text for s in segment) for segment in x]), "classes": cut.map(lambda x: "".join(map(sound_class, x)))})


def consonants(classes: Column) -> Column:
    return F.translate(classes, NOT_CONSONANTS, "")


def sound_classes(strings: DataFrame) -> DataFrame:
    """(ipa) to (ipa, tokens, dolgo_classes, dolgo_consonants, dolgo_first2), once per distinct string."""
    made = strings.select("ipa").distinct().select("ipa", _classes("ipa").alias("c"))
    found = made.select("ipa", F.col("c.tokens").alias("tokens"), F.col("c.classes").alias("dolgo_classes"))
    return found.withColumn("dolgo_consonants", consonants(F.col("dolgo_classes"))).withColumn("dolgo_first2", F.substring("dolgo_consonants", 1, 2))
