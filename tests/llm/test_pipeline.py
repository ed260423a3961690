"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm import test_decontaminate, test_secrets, test_simhash

from wordloom.llm import secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    inputs = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(inputs[-1], docs.schema), d)
        assert out.columns == COLUMNS
        inputs.append(out.collect())
    before, languages, distinct, clean, redacted = inputs
    assert len(languages) >= 0.99 * len(before) and set(languages) <= set(before)
    assert set(distinct) <= set(languages) and set(clean) <= set(distinct)
    assert sorted(r.doc_id for r in redacted) == sorted(r.doc_id for r in clean)
    for old, new in zip(sorted(clean), sorted(redacted), strict=True):
        assert test_secrets.brute(new.text)[:3] == (0, 0, 0)
        assert new.text == old.text or secrets.MARK in new.text
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in redacted}


CLASHING = ["a.b", "__text", "__cell", "__runs", "__spans", "spans", "__kept", "__component", "c0", "node", "row", "component_id", "fingerprint", "TEXT_", "n`q"]


def test_awkward_columns_and_rows(spark, awkward):
    """Every stage but packing keeps columns of any name, on awkward rows and on none."""
    d = "/root/testdata/sf0.001"
    rows = awkward.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, d)
        assert out.columns == rows.columns, name
        kept = out.collect()
        assert kept and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in kept for c in CLASHING), name
        assert stage(spark, rows.limit(0), d).collect() == [], name
    assert corpus_pipeline.pack(spark, rows, d).count() >= rows.count()
    assert corpus_pipeline.pack(spark, rows.limit(0), d).count() == 0


def test_stages_after_language(spark):
    """The near-duplicates stage against all pairs of texts, and the stages after it."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    inputs = [languages := corpus_pipeline.language(spark, docs, d).collect()]
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        inputs.append(stage(spark, spark.createDataFrame(inputs[-1], docs.schema), d).collect())
    _, distinct, clean, redacted = inputs
    group = {r.doc_id: r.doc_id for r in languages}
    linked = [(a.doc_id, b.doc_id) for a in languages for b in languages if a.doc_id < b.doc_id and test_simhash.similarity(a.text, b.text) >= 0.8]
    for _ in languages:
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    assert sorted(r.doc_id for r in distinct) == sorted(i for i, g in group.items() if i == g)
    hit = {r[0] for r in test_decontaminate.brute([(r.doc_id, r.text) for r in distinct], items) if r[-1]}
    assert hit and sorted(clean) == sorted(r for r in distinct if r.doc_id not in hit)
    assert sorted(r.doc_id for r in redacted) == sorted(r.doc_id for r in clean)
    assert all(test_secrets.brute(r.text)[:3] == (0, 0, 0) for r in redacted)
