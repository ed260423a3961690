"""op7 and op8 against the library on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wordloom.llm import packing, tokens


def test_counts(spark, documents):
    t = tokens.load(tokens.TOKENIZER)
    want = {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x, _ in documents}
    rows = tokens.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def test_counts_awkward(spark, awkward, write_tables):
    t = tokens.load(tokens.TOKENIZER)
    rows = tokens.query(spark, write_tables(documents=awkward)).collect()
    want = sorted(((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == want
    assert tokens.token_counts(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_resynchronisation(seed):
    t, rng = tokens.load(tokens.TOKENIZER), random.Random(seed)
    starts = lambda x: [a for a, _ in t.encode(x, add_special_tokens=False).offsets]
    parts = ["a", "b ", "  ", "\n\n", "é", "…", "1", "!", "<|endoftext|>", "'s", "　", "\xa0 ", "x" * 50, " " * 30, "漢字", "👍🏽", "\x1c "]
    text = "".join(rng.choice(parts) for _ in range(3000))
    whole = len(t.encode(text, add_special_tokens=False).ids)
    assert {tokens.resynchronised(starts, text, c, o) for c, o in ((300, 5), (700, 10), (2000, 300), (10**6, 10))} == {whole}


def test_resynchronisation_without_spaces():
    t = tokens.load(tokens.TOKENIZER)
    text = "x" * 5000 + "é" * 900 + " end"
    starts = lambda x: [a for a, _ in t.encode(x, add_special_tokens=False).offsets]
    assert tokens.resynchronised(starts, text, 500, 8) == len(t.encode(text, add_special_tokens=False).ids)


def check_packing(rows, texts):
    t = tokens.load(packing.TOKENIZER)
    want = sorted((len(ids) + 1, d, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for d, ids in ((d, t.encode(x or "", add_special_tokens=False).ids) for d, x in texts) if len(ids) < 4096)
    assert sorted((r.doc_tokens, r.doc_id, r.ids_crc32) for r in rows if r.doc_tokens <= 4096) == want
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 4096
    return by_doc, by_sequence


def test_packing(spark, documents):
    rows = packing.query(spark, "/root/testdata/sf0.001").collect()
    by_doc, by_sequence = check_packing(rows, [(i, x) for i, x, _ in documents])
    total = {r.doc_id: r.doc_tokens for r in rows}
    assert all(sum(n for _, n in x) == total[d] and sorted(x)[0][0] == 0 for d, x in by_doc.items())
    used = sum(total.values())
    assert used / (4096 * len(by_sequence)) > 0.97


def test_packing_awkward(spark, awkward, write_tables):
    named = awkward.filter("doc_id is not null")
    rows = packing.query(spark, write_tables(documents=named)).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in named.collect()])
    assert packing.pack(awkward.limit(0)).count() == 0
    assert packing.pack(awkward).filter("doc_id is null").count() == 1


def test_tightest_window():
    rng, windows = random.Random(1), packing.OpenWindows(64, 0)
    room = {}
    for _ in range(500):
        need = rng.randint(1, 64)
        fits = [r for r in room.values() if r >= need]
        where, offset = windows.place(need)
        before = room.get(where, 64)
        assert before == (min(fits) if fits else 64) and offset == 64 - before
        room[where] = before - need


AWKWARD_PARTS = [*"abAB'',,..!?;:<|> \t\n 12éÉßİıſǅΣσς̧́\xa0\x85\x1c\x0b\x0c日", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "'re", "Wort, ", "Ende."]


@pytest.mark.parametrize("seed", range(4))
def test_word_ids(seed):
    t, rng = tokens.load(packing.TOKENIZER), random.Random(seed)
    texts = ["", "  ", "x" * 9000 + ",", "<|ENDOFTEXT|>, Σίσυφος, İst. ﬁne, Straße."] + ["".join(rng.choices(AWKWARD_PARTS, k=rng.randint(1, 30))) for _ in range(3000)]
    got = packing.Words(packing.TOKENIZER).of(pa.array(texts))
    assert [x.tolist() for x in got] == [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_tokenizers(spark, awkward):
    """Tokenizers of another kind are given whole texts."""
    named = awkward.filter("doc_id is not null").select("doc_id", "text").distinct()
    t = tokens.load(packing.TOKENIZER)
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(named, tokenizer=packing.TOKENIZER, chunk=100).collect()}
    assert got == {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in named.collect()}
    t = tokens.load(tokens.TOKENIZER)
    got = {r.doc_id: r.doc_tokens for r in packing.pack(named, tokenizer=tokens.TOKENIZER, end=50256).collect()}
    assert got == {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in named.collect()}


def test_packing_ids_of_long_documents(spark, awkward):
    """The pieces of a document beyond one window, put together."""
    t = tokens.load(packing.TOKENIZER)
    text = awkward.filter("doc_id = 7").first().text
    rows = sorted(packing.pack(awkward.filter("doc_id = 7")).collect(), key=lambda r: r.start)
    assert len(rows) > 5 and np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_packing_in_blocks_of_any_size(spark, awkward):
    """How many texts are looked up together changes nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    want = packing.pack(docs).collect()
    assert packing.pack(docs, gathered=packing.SMALL).collect() == want and packing.pack(docs, gathered=1000).collect() == want
