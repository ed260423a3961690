"""Packing of documents into windows of tokens by best-fit decreasing.

Every document becomes its token ids and an end id. Overlong documents are first cut into full windows; what remains of
each is placed, longest first, into the open window with the least room that still fits, found by a segment tree over
remaining capacities. A task packs its partition in blocks of bounded size; windows that still have room stay open for
the next block, so a task leaves only a few windows short. Windows of different tasks differ by their ids, whose high
part is the partition. Nothing is shuffled.

Sequences are padded to the window by whoever reads them, unless their length is a power of two.

The packing follows the order of rows within partitions, so the input should be a table scan or otherwise give the same
partitions when a task is run again. Ids are those of the library on whole texts: word by word where the tokenizer's
normaliser and pre-tokenizer allow it (``by_words``), else text by text. Edge cases: very long texts are cut into windows
of one task; null and empty texts are one end id; equal rows are packed one by one;
tables without rows give none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import col, give_back, pieces, small_batches, table, worker_memory
from wordloom.llm.tokens import described, load

TOKENIZER = "word_bpe_49k.json"
WINDOW = 4096
END = 2
#: Pieces and ids of a block.
BLOCK_PIECES, BLOCK_IDS = 20_000, 1 << 20
#: Bytes of texts whose words are looked up together, of no bearing on the result: larger blocks meet a word less often,
#: smaller ones take less memory (150 MB of a worker beside the tokenizer for 4 MB of texts, 80 MB for 1 MB).
GATHERED, SMALL = 4 << 20, 1 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity. Leaf ``c`` of the segment tree tells whether a window with room ``c`` is open."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _set(self, room: int) -> None:
        k = room + self.leaves
        self.any[k] = bool(self.open[room])
        while k > 1:
            k >>= 1
            value = self.any[2 * k] | self.any[2 * k + 1]
            if self.any[k] == value:
                break
            self.any[k] = value

    def tightest(self, need: int) -> int | None:
        """The least room of an open window that is ``need`` at least."""
        k, tree = need + self.leaves, self.any
        if tree[k]:
            return need
        while k > 1:
            if not k & 1 and tree[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if tree[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """(window id, offset) for a piece."""
        room = self.tightest(length)
        if room is None:
            where, room = self.next_id, self.window
            self.next_id += 1
        else:
            where = self.open[room].pop()
            self._set(room)
        if room > length:
            self.open[room - length].append(where)
            self._set(room - length)
        return where, self.window - room


def cut(ids: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of the full windows and of what remains."""
    for start in range(0, len(ids), window):
        yield start, ids[start : start + window]


#: Words of these characters alone are the same in every normal form and hold no special token (no "|").
PLAIN = re.compile("[!-{}~À-įı-ɏ]+")
LETTERS = re.compile("[a-zß-öø-ɏ]+")
CLOSING = ".,;:!?"
#: Words of letters that are encoded together, words of a batch, and the length of words that are not remembered.
TOGETHER, BATCH, LONG = 512, 4096, 64
#: Fixed value: the pre-tokens for which all of this holds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker remembers; beyond, it keeps those of the texts at hand.
REMEMBERED = 150_000
#: Slots, by hash, in which words are noted when first met.
SLOTS = 1 << 22


def by_words(tokenizer) -> bool:
    """Are the ids of a text those of its words, one after another? So they are if white space is collapsed and dropped,
    letters are lower-cased, and pre-tokens are runs of letters, single digits, or runs of other signs, as here."""
    steps = [x["type"] for x in described(tokenizer.normalizer).get("normalizers", [])]
    cut = described(tokenizer.pre_tokenizer).get("pretokenizers", [])
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    return steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": PATTERN} and bool(suffix)


class Words:
    """Ids of words (little-endian uint32), remembered in a worker's life.

    The tokenizer must drop white space and lower-case, and end a word's last token with a suffix. A plain word is
    lower-cased first, and closing punctuation after a letter is a word of its own, as the tokenizer has it too; so fewer
    words are unseen. Words of letters alone are encoded many at a time, and told apart by the suffix. Most distinct words
    of a large corpus occur once: a word is remembered from the second block on that has it.
    """

    def __init__(self, tokenizer: str):
        self.tokenizer = load(tokenizer)
        self.by_words = by_words(self.tokenizer)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.met = bytearray(SLOTS)

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        out = []
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(group):
                out += self._each(group)
                continue
            data = ids.tobytes()
            out += [data[i:j] for i, j in zip([0, *stops], stops, strict=False)]
        return out

    @staticmethod
    def _parts(word: str) -> tuple[str, str]:
        """The word, and what closes it."""
        if not PLAIN.fullmatch(word):
            return word, ""
        low = word.lower()
        core = low.rstrip(CLOSING)
        return (core, low[len(core) :]) if core and LETTERS.fullmatch(core[-1]) else (low, "")

    def _add(self, words: list[str], fresh: dict[str, bytes]) -> None:
        """Put the ids of ``words``, which are not known, into ``fresh``; those of words cut from them as well."""
        others = {w: self._parts(w) for w in words if not LETTERS.fullmatch(w)}
        parts = {core for core, _ in others.values()}.union({closing for _, closing in others.values()})
        unseen = [p for p in parts if p not in self.known and p not in fresh]
        rest = [p for p in unseen if not LETTERS.fullmatch(p)]
        letters = [w for w in {w for w in words if w not in others}.union(unseen).difference(rest) if w not in fresh]
        fresh.update(zip(letters, self._letters(letters), strict=True))
        fresh.update(zip(rest, self._each(rest), strict=True))
        ids = lambda p: fresh[p] if p in fresh else self.known[p]
        fresh.update([(w, ids(core) + ids(closing)) for w, (core, closing) in others.items() if core != w])

    def _remember(self, fresh: dict[str, bytes]) -> None:
        met = self.met
        for w, ids in fresh.items():
            slot = hash(w) % SLOTS
            if not met[slot]:
                met[slot] = 1
            elif len(w) <= LONG:
                self.known[w] = ids

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_words:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if len(self.known) > REMEMBERED:  # go on with those in use
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        values = list(map(self.known.get, distinct))
        new = [w for w, ids in zip(distinct, values, strict=True) if ids is None]
        fresh: dict[str, bytes] = {}
        for i in range(0, len(new), BATCH):
            self._add(new[i : i + BATCH], fresh)
        values = [fresh[w] if ids is None else ids for w, ids in zip(distinct, values, strict=True)]
        self._remember(fresh)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begins, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(values), "<u4")
        per_word = lengths[which]
        stops = np.concatenate([[0], np.cumsum(per_word)])
        ids = flat[np.repeat(begins[which] - stops[:-1], per_word) + np.arange(stops[-1])]
        bounds = split.offsets.to_numpy()
        bounds = stops[bounds - bounds[0]]
        return [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def token_ids(tokenizer: str = TOKENIZER) -> Words:
    """The ids of words, which a worker remembers."""
    return worker_memory(f"packing {tokenizer}", lambda: Words(tokenizer))  # type: ignore[return-value]


def _gathered(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``most`` bytes, in which a word is looked up once."""
    waiting, size = [], 0
    for whole in batches:
        for batch in pieces(whole, most):
            waiting.append(batch)
            size += batch.nbytes
            if size >= most:
                yield pa.concat_batches(waiting)
                waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW, end: int = END, gathered: int = GATHERED
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    source = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        windows = OpenWindows(window, TaskContext.get().partitionId() << 32)
        words, tail = token_ids(tokenizer), np.array([end], "<u4")
        waiting: list[tuple[int | None, int, np.ndarray, int]] = []
        held = 0

        def placed() -> pa.RecordBatch:
            rows = [(doc, start, len(ids), ids.tobytes(), total, *windows.place(len(ids))) for doc, start, ids, total in sorted(waiting, key=lambda x: -len(x[2]))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in _gathered(batches, gathered):
            for doc, ids in zip(batch.column(0).to_pylist(), words.of(batch.column(1)), strict=True):
                ids = np.concatenate([ids, tail])
                for start, part in cut(ids, window):
                    waiting.append((doc, start, part, len(ids)))
                    held += len(part)
                    if held >= BLOCK_IDS or len(waiting) >= BLOCK_PIECES:
                        yield placed()
                        waiting, held = [], 0
        if waiting:
            yield placed()
        del waiting
        give_back()

    return small_batches(source).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
