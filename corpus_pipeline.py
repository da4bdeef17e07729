"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of docs. ``run`` writes each stage's
result to the shared folder and reads it again, so a lost executor costs one stage at most.
Stages that drop rows join texts with the ids that stay by sort and merge at every size.

1. language_id: a byte-level recurrent network, trained on the documents whose language is
   given, labels each text; texts that it rejects (``und``: null or without a letter) go, and
   lang is what it says. Where no text with a letter has a language there is no network: the same
   texts go, and lang stays as it is.
2. exact_dedup: of equal texts the one with the largest doc_id stays.
3. jaccard_dedup: of documents that links of at least 80 in 100 five-word shingles connect, the one with the
   least doc_id stays; documents without shingles stay.
4. mix_sources: SHARE_PERCENT of all tokens are taken, by the weights of domains, languages and
   sources, each document once at most. What a source lacks its siblings give. The document at the end of
   a leaf's budget stays whole: take_tokens is not applied to texts.
5. pack: sequences of at most 4096 tokens, with the pieces' token ids (the mark 2 ends each document).

Cases: null texts, and those without a letter, go in stage 1. Of rows that repeat id and text one stays after stage 2; of rows that
share an id but not a text each is a document, and stages 3 and 4 decide on ids: stage 3 drops a row only if its own text (by digest) is
linked to a document with a lesser id; stage 4 takes all rows of an id that it takes. A row with a null id is a document like others, which
links with nothing in stage 3. Ties in stage 4 are broken by a hash of the id. Extra columns are carried to stage 4, whatever their
names but those that start with ``_larkspur``; stage 5 returns its own columns. Empty documents give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup as exact
from larkspur.llm import jaccard, langid, mixing, packing
from larkspur.llm.common import text_of
from larkspur.sources.shared import durable, shrink_heaps

#: Share of the remaining tokens that the mix keeps.
SHARE_PERCENT = 90

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def from_small_heaps(stage: Stage) -> Stage:
    """stage, begun after executors have returned what the one before it left free in their heaps."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@from_small_heaps
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    langs, weights = langid.train(docs.select("doc_id", "text", "lang"))
    if weights is None:
        return docs.filter(text_of().rlike(r"\p{L}"))
    kept = tuple(docs.columns)
    labelled = langid.predict(docs, langs, weights, kept, ("_larkspur_lang", "_larkspur_score")).filter("_larkspur_lang <> 'und'")
    return labelled.withColumn("lang", F.col("_larkspur_lang")).select(*kept)


@from_small_heaps
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


@from_small_heaps
def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.jaccard_components(docs, with_digest=True)
    gone = durable(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("_larkspur_gone"), F.col("text_digest").alias("_larkspur_text")).distinct(), "gone")
    return docs.join(gone.hint("merge"), (docs["doc_id"] == gone["_larkspur_gone"]) & (jaccard.text_digest(docs["text"]) == gone["_larkspur_text"]), "left_anti")


@from_small_heaps
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs, mixing.WEIGHTS, SHARE_PERCENT, epochs=1).select(F.col("doc_id").alias("_larkspur_taken")).distinct()
    return docs.join(taken.hint("merge"), docs["doc_id"].eqNullSafe(taken["_larkspur_taken"]), "left_semi")


@from_small_heaps
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_dedup", jaccard_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: A trained network and a tokenizer are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
