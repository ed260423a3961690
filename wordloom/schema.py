"""The entry schema and the template names that carry meaning."""

from pyspark.sql import types as T

TEMPLATE = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("args", T.MapType(T.StringType(), T.StringType())), T.StructField("expansion", T.StringType())]
)
SENSE = T.StructType([T.StructField("glosses", T.ArrayType(T.StringType()))])
SOUND = T.StructType([T.StructField("ipa", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("ogg_url", T.StringType()), T.StructField("mp3_url", T.StringType())])
TRANSLATION = T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType())])

ENTRY = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("lang_code", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("etymology_number", T.IntegerType()),
        T.StructField("etymology_text", T.StringType()),
        T.StructField("etymology_templates", T.ArrayType(TEMPLATE)),
        T.StructField("senses", T.ArrayType(SENSE)),
        T.StructField("sounds", T.ArrayType(SOUND)),
        T.StructField("translations", T.ArrayType(TRANSLATION)),
    ]
)

#: The order that decides between entries of the same word; nulls first.
ENTRY_ORDER = ("word", "lang", "pos", "etymology_number")

# Template names.
ANCESTRY = ("inh", "bor", "der")
ANCESTRY_ALIASES = {"derived": "der"}
COGNATE = "cog"
MENTIONS = ("m", "m+", "l")
AFFIXES = ("af", "affix", "suffix", "suf", "prefix", "pre", "compound", "confix", "blend")
UNCERTAIN_TEMPLATES = {"unk": "unknown", "unc": "uncertain"}
GAP_TEMPLATES = ("compound", "af", "affix", "suffix", "prefix", "blend", "+")
CALQUES = ("cal", "calque")
DOUBLETS = ("doublet",)
