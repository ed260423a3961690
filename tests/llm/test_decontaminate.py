"""op6 against brute force and SQL, and the search against plain find."""

import hashlib
import random
import re

import duckdb

from wordloom.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_sql(spark):
    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({decontaminate.SQL})").fetchall()
    rows = decontaminate.query(spark, d).collect()
    assert sorted(tuple(r) for r in rows) == sorted(want)
    assert any(r.contaminated for r in rows)


def test_awkward(spark, awkward, write_tables):
    items = [(1, "Quick brown FOX"), (1, "lazy dog"), (12, "jumps over the lazy dog and runs on the quick brown fox"), (2, "..."), (3, None), (4, "one"), (5, "e"), (6, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.query(spark, write_tables(documents=awkward, benchmark=bench)).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute([(r.doc_id, r.text) for r in awkward.collect()], items)
    in_blocks = decontaminate.find_overlaps(awkward.select("doc_id", "text"), bench, block_bytes=20, keep=["doc_id"])
    assert sorted((r.doc_id, r.n_hit, len(r["items"])) for r in in_blocks.collect() if r.doc_id) == sorted((r.doc_id, r.n_hit, r.n_items) for r in rows if r.doc_id)
    in_passes = decontaminate.find_overlaps(awkward.select("doc_id", "text"), bench, block_bytes=20, keep=["doc_id"], pass_blocks=2)
    assert sorted(map(repr, in_passes.collect())) == sorted(map(repr, in_blocks.collect()))
    assert in_passes.dtypes == in_blocks.dtypes
    clean = {r.doc_id for r in decontaminate.drop_contaminated(awkward, bench).collect()}
    assert clean == {r.doc_id for r in rows if not r.contaminated} == {r.doc_id for r in decontaminate.drop_contaminated(awkward, bench, block_bytes=20).collect()}
    assert decontaminate.find_overlaps(awkward.limit(0), bench).count() == 0
    assert decontaminate.find_overlaps(awkward, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_search_finds_all():
    rng = random.Random(2)
    text = bytes(rng.choices(b"ab ", k=4000))
    patterns = sorted({text[i : i + n] for i, n in ((rng.randrange(3900), rng.randint(3, 40)) for _ in range(60))})
    got = sorted((start, patterns[k]) for start, k in decontaminate.WuManber(patterns).search(text))
    want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
    assert got == want
