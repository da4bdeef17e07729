"""The pipeline's stages, each against a plain version of itself."""

from __future__ import annotations

import corpus_pipeline as pipeline
from larkspur.sources.shared import durable

from . import brute


def test_stages(spark, docs, sf):
    rows = docs.filter("doc_id is not null")
    kept = durable(pipeline.language_id(spark, rows, sf), "t")
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in rows.collect() if r.text and any(c.isalpha() for c in r.text))
    assert sorted(r.doc_id for r in kept.collect()) == want

    before = kept.collect()
    kept = durable(pipeline.exact_dedup(spark, kept, sf), "t")
    assert kept.columns == docs.columns
    last = {}
    for r in before:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(last.values())

    before = {r.doc_id: r.text for r in kept.collect()}
    kept = durable(pipeline.jaccard_dedup(spark, kept, sf), "t")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in brute.jaccard_components(before).items() if c == d)

    mixed = durable(pipeline.mix_sources(spark, kept, sf), "t")
    assert mixed.columns == docs.columns
    tokens = lambda df: sum(len(brute.words(r.text)) for r in df.collect())
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in kept.collect()}
    assert 0.88 * tokens(kept) < tokens(mixed)

    packed = pipeline.pack(spark, mixed, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}


def test_run_follows_the_stages(spark, sf):
    out = pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_dedup", "mix_sources", "pack"]
