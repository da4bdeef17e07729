"""Cases of the pipeline's stages that the shared tables do not have."""

from __future__ import annotations

import corpus_pipeline as pipeline
from larkspur.sources.shared import durable
from pyspark.sql import functions as F


def test_without_any_language_texts_stay(spark):
    rows = [(1, "clean text", None), (2, None, None), (3, "12 34 --", "fr"), (4, "漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(1, None), (4, None)]


def test_odd_rows_pass_through_the_stages(spark):
    """Null and shared ids, repeats, extra columns with clashing names."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a + " q", "en", "src1"), (5, b + " q", "en", None), (9, a, None, "src1"), (9, a, "en", "src1"), (9, "its own text", "en", "src1"), (None, "no id", "en", "src2"), (None, None, None, None), (12, "", "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({n: F.lit("x") for n in ("_keep", "_id", "_digest", "n", "component_id", "text_digest", "shard")})
    kept = docs
    want = [{1, 5, 9, None}, {1, 5, 9, None}, {1, 5, 9, None}]
    for (_, stage), ids in zip(pipeline.STAGES, want):
        kept = durable(stage(spark, kept, ""), "t")
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids
    assert sorted(r.text for r in kept.collect()) == sorted([a + " q", b + " q", "its own text", "no id"])
    packed = pipeline.pack(spark, pipeline.mix_sources(spark, kept, ""), "").collect()
    assert all(r.ids[-1] == 2 and len(r.ids) == r.length for r in packed)


def test_empty_documents(spark, empty_sf):
    out = pipeline.run(spark, empty_sf)
    assert out.count() == 0 and {"doc_id", "ids", "sequence_id"} <= set(out.columns)


def test_each_stage_begins_with_a_collection(spark):
    """Heaps that one stage has grown are given back before the next, or executors end with the sum of all stages."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "a text of some words", "en", "src1")], "doc_id long, text string, lang string, source string")
    for name, stage in pipeline.STAGES:
        before = whole()
        stage(spark, docs, "")
        assert whole() > before, name
