"""Token counts with a public tokenizer, huge documents by overlap resynchronisation.

Documents of more than ``CHUNK`` characters are encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced at a boundary that is proven stable and that both encodings have: a token starts there, white space stands
there, and a character other than white space before it. Byte-level pre-tokens never hold white space after other
characters, so a pre-token starts at such a place whatever stands further left, and everything left of it is final
however the text goes on. If the overlap has no such place, it is widened, up to the whole text.

Other documents fall apart at the same places into units of white space and one word; the count of a unit is
remembered, so the tokenizer itself sees each unit once in a worker's life. Texts with white space other than blank,
tab and line ends are encoded whole. So are all texts by a tokenizer for which these places are not proven: one with a
normaliser, or with another pre-tokenizer than byte-level (``splits``).

Edge cases: equal rows get equal counts; null and empty texts have 0 tokens; strings of special tokens inside texts are tokens, as the library has
it by default; tables without rows give none; columns named like a result are replaced.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import map_texts, table, worker_memory

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Characters of a chunk, and of the first overlap.
CHUNK, OVERLAP = 32_768, 256
#: Units remembered in a worker; beyond, it keeps those of the texts at hand.
REMEMBERED = 800_000

#: White space that does not simply separate units, or that the libraries see differently.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -     　]")
UNIT = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")


def load(name: str):
    """The tokenizer of a file: a path, or a name that ``public_tokenizers`` knows."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = name
    if not os.path.isabs(name):
        import public_tokenizers

        path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(str(path))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def described(part) -> dict:
    """A tokenizer's normaliser or pre-tokenizer as its file has it; the whole file would be its vocabulary too."""
    return json.loads(part.__getstate__()) if part is not None else {}


def splits(tokenizer) -> bool:
    """Do boundaries of pre-tokens follow from the characters beside them, as ``stable`` has it? So they do without a
    normaliser, in byte-level pre-tokens by the usual pattern, if no added token takes white space with it."""
    before = described(tokenizer.pre_tokenizer)
    plain = not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in tokenizer.get_added_tokens_decoder().values())
    return plain and tokenizer.normalizer is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


def stable(text: str, at: int) -> bool:
    """Is ``at`` a boundary of pre-tokens whatever stands left of ``at - 1``?"""
    return text[at] in " \t\r\n" and not text[at - 1].isspace() and not RARE_SPACE.match(text[at - 1])


def resynchronised(starts: Callable[[str], list[int]], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``starts`` gives the first character of every token of a string."""
    n, total = len(text), 0
    at, end = 0, min(len(text), chunk)
    left, begin = starts(text[:end]), 0  # tokens from ``begin`` on are not yet counted
    while end < n:
        wide, grow = overlap, chunk
        while True:
            start = max(at, end - wide)
            stop = min(n, end + chunk)
            if start > at:
                right = [start + x for x in starts(text[start:stop])]
                inside = set(right[bisect_left(right, start + 1) : bisect_left(right, end)])
                if common := [x for x in left[bisect_left(left, begin + 1) :] if x in inside and stable(text, x)]:
                    break
                wide *= 2
                continue
            end = min(n, end + grow)  # nowhere in the left chunk: make it longer
            grow, wide = grow * 2, overlap
            left = [at + x for x in starts(text[at:end])]
            if end == n:
                return total + len(left) - bisect_left(left, begin)
        splice = common[-1]
        total += bisect_left(left, splice) - bisect_left(left, begin)
        at, end, left, begin = start, stop, right, splice
    return total + len(left) - bisect_left(left, begin)


class Remembered:
    """Values of units, computed for many unseen ones at once."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = REMEMBERED):
        self.compute, self.most, self.known = compute, most, {}

    def of(self, texts: list[list[str]]) -> dict:
        """The known values, with those of all units of ``texts`` among them."""
        if len(self.known) > self.most:  # go on with those in use
            self.known = {u: self.known[u] for units in texts for u in units if u in self.known}
        known, unseen = self.known, set()
        for units in texts:
            unseen.update(set(units).difference(known))
        new = list(unseen)
        for i in range(0, len(new), 8192):
            known.update(zip(new[i : i + 8192], self.compute(new[i : i + 8192]), strict=True))
        return known


class Counts:
    """A tokenizer, and the counts of units that a worker remembers."""

    def __init__(self, tokenizer: str):
        self.tokenizer = load(tokenizer)
        self.splits = splits(self.tokenizer)
        self.memory = Remembered(lambda units: [len(e.ids) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)])

    def starts(self, text: str) -> list[int]:
        return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def whole(self, text: str, chunk: int, overlap: int) -> int:
        if self.splits and len(text) > chunk:
            return resynchronised(self.starts, text, chunk, overlap)
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def of(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        units = [[] if not self.splits or len(x) > chunk or RARE_SPACE.search(x) else UNIT.findall(x) for x in texts]
        value = self.memory.of(units).__getitem__
        return [sum(map(value, u)) if u else self.whole(x, chunk, overlap) if x else 0 for u, x in zip(units, texts, strict=True)]


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, chunk: int = CHUNK, overlap: int = OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    key = f"tokens {tokenizer}"

    def make():
        counts: Counts = worker_memory(key, lambda: Counts(tokenizer))  # type: ignore[assignment]
        return lambda texts: [[len(x.encode("utf-8", "surrogatepass")) for x in texts], counts.of(texts, chunk, overlap)]

    return map_texts(docs, text_col, make, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], keep, key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
