"""op10 against brute force over all pairs."""

import math
import random
import re
from functools import lru_cache

import numpy as np
import xxhash

from wordloom.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def test_documents(spark, documents):
    rows = simhash.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute([(i, t) for i, t, _ in documents])


def test_awkward(spark, awkward, write_tables):
    rows = simhash.query(spark, write_tables(documents=awkward)).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute([(r.doc_id, r.text) for r in awkward.collect()])


def test_empty(spark, awkward):
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_links_and_components(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:20]:  # chains of steps of up to three bits
        for _ in range(12):
            for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                b ^= 1 << bit
            prints.add(b)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    root = {r.u: r.v for r in simhash.components(simhash.links(frame)).collect()}
    label = {s: s for s in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {s: root.get(s, s) for s in signed} == label


def test_deduplicate_keeps_one(spark, awkward):
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7, 9, 10]


def test_ids_of_any_name(spark, awkward):
    named = awkward.select("doc_id", "text").toDF("a.b", "t`x")
    got = sorted((tuple(r) for r in simhash.near_duplicates(named, "a.b", "t`x").collect()), key=repr)
    assert got == sorted((tuple(r) for r in simhash.near_duplicates(awkward).collect()), key=repr)
    assert simhash.deduplicate(named, "a.b", "t`x").columns == ["a.b", "t`x"]


def similarity(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@lru_cache(None)
def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_deduplicate_near_copies(spark):
    """Pairs at 0.8 to 0.99 lose one document, pairs under 0.8 lose none."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 8))) for _ in range(3000)]
    rows, levels = [], {}
    for k in range(400):
        words = rng.choices(vocabulary, k=rng.randint(80, 600))
        copy = list(words)
        for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.uniform(0.001, 0.03)))):
            copy[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        levels[2 * k + 1] = similarity(rows[-2][1], rows[-1][1])
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i in kept for i in range(0, 800, 2)) and all(i in kept for i, s in levels.items() if s < 0.8)
    for least, most in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.991)):
        some = [i for i, s in levels.items() if least <= s < most]
        assert len(some) >= 20 and sum(i not in kept for i in some) >= 0.9 * len(some)


def family(rng, vocabulary, size, words, most):
    """Copies of copies: each is made of one before it, so that many are alike, and many are unlike the first."""
    texts = [rng.choices(vocabulary, k=words)]
    for _ in range(size - 1):
        copy = list(rng.choice(texts[-6:]))
        for at in rng.sample(range(words), max(1, round(words * rng.uniform(0.002, most)))):
            copy[at] = rng.choice(vocabulary)
        texts.append(copy)
    return [" ".join(t) for t in texts]


def test_families_of_near_copies(spark):
    """Pairs at 0.8 and more meet in one component though they are unlike the smallest of their bucket."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 8))) for _ in range(3000)]
    families = [family(rng, vocabulary, 12, 150, 0.03) for _ in range(25)] + [family(rng, vocabulary, 120, 200, 0.03)]
    rows = [(i, t) for i, t in enumerate(t for f in families for t in f)]
    texts = spark.createDataFrame([(i, i, t) for i, t in rows], "node long, doc long, text string")
    root = {r.u: r.v for r in simhash.near_components(texts).collect()}
    pairs, start = [], 0
    for f in families:
        own = range(start, start + len(f))
        pairs += [(a, b) for a in own for b in own if a < b and similarity(rows[a][1], rows[b][1]) >= 0.8]
        start += len(f)
    unlike_first = sum(similarity(f[0], t) < 0.8 for f in families for t in f)
    assert len(pairs) > 400 and unlike_first > 150
    assert sum(root.get(a, a) == root.get(b, b) for a, b in pairs) >= 0.97 * len(pairs)
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert all(label[u] == label[v] for u, v in root.items())  # nothing is joined that isn't linked


def grouped(rows):
    """The smallest id of each text's component, by all pairs that share a shingle."""
    holders, shared = {}, {}
    for i, t in rows:
        for x in shingle_set(t):
            for j in holders.setdefault(x, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            holders[x].append(i)
    sizes = {i: len(shingle_set(t)) for i, t in rows}
    pairs = [p for p, n in shared.items() if 5 * n >= 4 * (sizes[p[0]] + sizes[p[1]] - n)]
    label, changed = {i: i for i, _ in rows}, True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def crowd(seed):
    """Texts of one large group, each unlike most others, all with one passage in common; and short ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 8))) for _ in range(3000)]
    texts = family(rng, vocabulary, 350, 100, 0.06)
    line = " ".join(rng.choices(vocabulary, k=12))
    texts += [f"{line} {' '.join(rng.choices(vocabulary, k=rng.randint(1, 60)))}" for _ in range(60)]
    texts += [" ".join(rng.choices(vocabulary[:3], k=rng.randint(1, 7))) for _ in range(60)]
    return list(enumerate(dict.fromkeys(texts)))


def roots(spark, rows):
    texts = spark.createDataFrame([(i, i, t) for i, t in rows], "node long, doc long, text string")
    found = {r.u: r.v for r in simhash.near_components(texts).collect()}
    return {i: found.get(i, i) for i, _ in rows}


def test_no_link_of_a_crowd_is_lost(spark):
    """Every pair at 0.8 is in one component, however many texts share a bucket, and nothing else is."""
    rows = crowd(13)
    want = grouped(rows)
    assert 20 < len(set(want.values())) < len(rows) - 20
    assert roots(spark, rows) == want


def test_pairs_without_a_common_anchor(spark):
    """Texts at 0.8 or more that no anchor brings together are found all the same."""
    rng, rows = random.Random(15), []
    while len(rows) < 6:
        words = [f"{rng.getrandbits(24):x}" for _ in range(94)]
        copy = [*words[:20], "changed", *words[21:60], "changed", *words[61:]]
        texts = [" ".join(words), " ".join(copy)]
        anchors = [set(enumerate(simhash.sketch(simhash.shingles(t))[0])) for t in texts]
        if not anchors[0] & anchors[1]:
            assert similarity(*texts) >= 0.8
            rows += enumerate(texts, len(rows))
    assert roots(spark, rows) == {i: i - i % 2 for i in range(6)}


def test_links_without_heads_and_by_shares(spark, monkeypatch):
    """The join of prefixes finds every link by itself, and where a shingle's texts are dealt out in shares."""
    rows = crowd(14)
    monkeypatch.setattr(simhash, "NEAR_BITS", -1)
    monkeypatch.setattr(simhash, "SHARE", 20)
    assert roots(spark, rows) == grouped(rows)


def test_prefixes_meet_in_any_order():
    """Two sets at 0.8 or more share a shingle of their prefixes, at places that leave room for all they share."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n).astype("<u8"))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype("<u8")]))
        shared = len(np.intersect1d(a, b))
        if 5 * shared < 4 * (len(a) + len(b) - shared):
            continue
        tokens = np.unique(rng.choice(a, len(a) // 2))
        x, y = (list(simhash.prefix(s, tokens, np.arange(len(tokens))[::-1] // 3 + 1)) for s in (a, b))
        first = next(t for t in x if t in y)
        assert min(len(a) - x.index(first), len(b) - y.index(first)) >= shared
        odd = np.bitwise_count((simhash.parities(a) ^ simhash.parities(b)).view("<u8")).sum()
        assert odd <= len(a) + len(b) - 2 * shared


def test_long_sets_share_as_many_as_needed():
    """Two sets at 0.8 or more share ``needed`` shingles of their prefixes, each at a place that the bound allows."""
    rng, least_spare = np.random.default_rng(4), 1000
    for k in range(200):
        n, order = int(rng.integers(1, 3000)), (np.zeros(0, "<u8"), np.zeros(0, "<i8"))
        a = np.sort(rng.integers(0, 1 << 63, n).astype("<u8"))
        turned = int(n * rng.uniform(0.08, 0.12))
        # every other pair differs in its first shingles, so that what it shares begins as late as can be
        b = np.unique(np.concatenate([a[turned:], rng.integers(0, a[min(turned, n - 1)] if k % 2 else 1 << 63, turned).astype("<u8")]))
        shared, (x, y) = len(np.intersect1d(a, b)), (simhash.prefix(s, *order) for s in (a, b))
        least = math.ceil((len(a) + len(b)) * 4 / 9 - 1e-3)
        if shared < least:
            continue
        must = simhash.needed(min(len(a), len(b)))
        places = [(np.searchsorted(a, t), np.searchsorted(b, t)) for t in np.intersect1d(x, y)]
        fit = sum(min(len(a) - i, len(b) - j) > least - must for i, j in places)
        assert fit >= must
        least_spare = min(least_spare, fit - must)
    assert least_spare < 40


def test_long_texts_that_meet_by_chance_are_not_verified(spark, monkeypatch):
    """Long texts that share some rare shingles with every other are told apart without their sets, and links are found."""
    rng = random.Random(16)
    texts = [[f"{rng.getrandbits(32):x}" for _ in range(1200)] for _ in range(30)]
    for i, t in enumerate(texts):
        for u in texts[:i]:
            line = [f"{rng.getrandbits(32):x}" for _ in range(12)]
            t += line
            u += line
    copy = [w if k % 60 else "changed" for k, w in enumerate(texts[3])]
    rows = list(enumerate(" ".join(t) for t in [*texts, copy]))
    assert similarity(rows[3][1], rows[-1][1]) >= 0.8
    asked, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "NEAR_BITS", -1)
    monkeypatch.setattr(simhash, "verified", lambda texts, nodes, pairs: asked.append(pairs.count()) or verified(texts, nodes, pairs))
    assert roots(spark, rows) == {i: 3 if i == 30 else i for i, _ in rows}
    assert sum(asked) <= 5
