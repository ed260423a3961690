"""op1 against Python's regular expressions, and planted random strings."""

import hashlib
import random
import re

from wordloom.llm import secrets

KINDS = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def brute(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, regex, group, least) in enumerate(KINDS) for m in regex.finditer(text or "") if len(m[group]) >= least]
    counts = [sum(s[1] == k for s in spans) for k in range(3)]
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
    return (*counts, hashlib.sha256(listed.encode()).hexdigest())


def check(rows, texts):
    want = sorted(((i, *brute(t)) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows), key=repr) == want


def test_documents(spark, documents):
    check(secrets.query(spark, "/root/testdata/sf0.001").collect(), [(i, t) for i, t, _ in documents])


def test_awkward(spark, awkward, write_tables):
    rows = secrets.query(spark, write_tables(documents=awkward)).collect()
    check(rows, [(r.doc_id, r.text) for r in awkward.collect()])


def test_empty(spark, awkward):
    assert secrets.find_secrets(awkward.limit(0)).count() == 0


def test_random_strings_found_and_words_left(spark, documents):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [t for _, t, _ in documents] + [f"see {''.join(rng.choices(letters, k=32))} here" for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans if s.kind == "random"] for r in secrets.find_secrets(docs).collect()}
    n = len(documents)
    assert sum(bool(found[i]) for i in range(n)) <= n // 100
    assert sum(bool(found[n + i]) and (found[n + i][0].start, found[n + i][0].end) == (4, 36) for i in range(200)) >= 194


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a token = abcdef0123456789abcdef0123456789 b"), (2, None), (3, "clean")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {1: "a [SECRET] b", 2: None, 3: "clean"}


def test_redact_keeps_columns(spark, awkward):
    """A column named like the result is kept, and clean rows are left as they are."""
    clean = secrets.redact(awkward)
    assert clean.columns == awkward.columns
    assert {r.spans for r in clean.collect()} == {"clash"}


def test_native(spark, awkward):
    plan = secrets.find_secrets(awkward, ratios=[0.0] * 16384)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_random(text, ratios):
    """The spans that the method adds, written out."""
    masked = list(text)
    for _, regex, group, least in KINDS:
        for m in regex.finditer(text):
            if len(m[group]) >= least:
                masked[m.start() : m.end()] = " " * (m.end() - m.start())
    out = []
    for run in re.finditer("[A-Za-z0-9+/_=-]{20,}", "".join(masked)):
        value, found, total, since, best, until = run[0], [], 0.0, 0, 0.0, 0
        for i in range(len(value) - 1):
            total += float(f"{ratios[ord(value[i]) * 128 + ord(value[i + 1])]:.6g}")
            if total <= 0 or total < best - secrets.THRESHOLD:
                found += [(since, until)] if best > secrets.THRESHOLD else []
                total, since, best = 0.0, i + 1, 0.0
            elif total > best:
                best, until = total, i + 2
        found += [(since, until)] if best > secrets.THRESHOLD else []
        for a, b in dict.fromkeys(found):
            while a and value[a - 1].isalnum():
                a -= 1
            while b < len(value) and value[b].isalnum():
                b += 1
            if b - a >= secrets.RUN_LEAST and (run.start() + a, run.start() + b) not in out:
                out.append((run.start() + a, run.start() + b))
    return sorted(out)


def test_added_spans(spark, documents):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choices(letters, k=n))
    words = [w for _, t, lang in documents if lang == "en" and t for w in re.findall(r"\b[a-z]{7,12}\b", t)]
    path = "/".join(dict.fromkeys(words[:6]))
    planted = [f"{path}/{key(24)}" for _ in range(30)] + [f"{key(32)}/{path}" for _ in range(30)] + [f"token=abcdef {key(40)} deadbeefdeadbeefdeadbeef_{key(30)}" for _ in range(10)]
    texts = [t or "" for _, t, _ in documents] + planted + [path, "x" * 300, ""] + [f"https//downloads/customers/documents/{key(30)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratios = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in secrets.find_secrets(docs, ratios=ratios).collect()}
    assert got == {i: brute_random(t, ratios) for i, t in enumerate(texts)}
    n = len(documents)
    assert sum(bool(got[i]) for i in range(n)) <= n // 100
    covered = lambda i, start, end: any(a <= start and end <= b for a, b in got[i])
    assert sum(covered(n + i, len(path) + 1, len(path) + 25) for i in range(30)) >= 27
    assert sum(covered(n + 30 + i, 0, 32) for i in range(30)) >= 27
    assert covered(len(texts) - 1, len(texts[-1]) - 30, len(texts[-1])) and not got[len(texts) - 4]


def test_many_matches(spark):
    """A text full of matches, in several blocks, and its redaction."""
    text = " ".join(f"token=secret{i:05d} é" for i in range(700))
    r = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), ratios=[0.0] * 16384).first()
    assert [(s.start, s.end) for s in r.spans] == [m.span() for m in re.finditer("token=secret[0-9]{5}", text)]
    clean = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == re.sub("token=secret[0-9]{5}", lambda _: secrets.MARK, text)
