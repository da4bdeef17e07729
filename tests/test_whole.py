"""Queries that take whole texts, on tables where a cut would show."""

from __future__ import annotations

import pytest
from larkspur.plans.registry import queries

LATER = "later words decide"
LONG = " ".join(f"w{i:02}" for i in range(20)) + f" {LATER}"


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(1, LATER, "en", "src1", 18), (2, "nothing of it", "en", "src1", 13), (3, f"  {LONG} ÀBC".upper() + " \n", "en", "src2", 90), (4, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, LONG)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_batched_recall_asks_for_every_word(spark, whole):
    rows = queries()["recall_batched_benchmark"](spark, whole).collect()
    assert {r.id: int(r.total) for r in rows} == {"doc-3": 23, "doc-1": 3}


def test_lowered_texts_are_whole(spark, whole):
    rows = {r.doc_id: r.lowered for r in queries()["text_functions"](spark, whole).collect()}
    assert rows == {1: LATER, 2: "nothing of it", 3: f"{LONG} Àbc", 4: ""}


def test_own_texts_are_validated(spark, whole):
    """Three planted rules (ids 1, 2 and 4) and the text that is blank by itself."""
    assert sorted(tuple(r) for r in queries()["validation_failures"](spark, whole).collect()) == [("actor_id", 1), ("content", 1), ("importance_score", 1), ("namespace", 1)]
