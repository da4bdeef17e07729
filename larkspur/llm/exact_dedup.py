"""Exact dedup: a tree merge of sorted digest runs.

Rows are narrowed to a digest, and each input partition belongs to one of RUNS runs. A run is kept as arrays,
sorted by digest and cut into buckets of the digest's range, so that no array holds more than about BUCKET entries however
large the corpus; each entry is (digest, identifier that stays, count, guards). Runs meet in binomial rounds: in round k run
r + 2^k goes to run r, for r a multiple of 2^(k+1), and the sorted arrays of a bucket are merged. Sorting arrays that are
made of sorted pieces is a merge (the JVM's sort finds the pieces); after that, equal digests are neighbours and
become one entry. So a text with a billion copies enters a round as one entry a run and no task ever holds its copies.
A second, independent hash of text and length travels along and is compared at every
level: a digest that two texts share fails the job instead of merging them.

Cases: null text counts as empty; empty texts are copies of each other; rows that
repeat both id and text are copies of one document and all carry the same result
(``deduplicate`` returns one of them); a null id stays only if its group has no other;
long texts are hashed whole; an empty table gives an empty result; extra columns are carried by ``deduplicate``, whatever their names but
those that start with ``_larkspur``, and ignored by ``classify``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, durable
from .common import let, table, text_of

#: Runs (a power of two), and entries of a bucket, about.
RUNS, BUCKET = 64, 1024
#: A group of more than 1/HEAVY of all rows is joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 2000


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """One narrow row for each document: _id, _digest (SHA-256), _guard, _run."""
    t = text_of() if text is None else text
    return docs.select(
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("_digest"),
        F.xxhash64(t, F.length(t)).alias("_guard"),
        F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("_run"),
    )


def merged(run: Column, keep: str) -> Column:
    """A sorted array in which each digest is there twice at most -> once; entries whose guards differ fail the job."""
    pick = {"max": F.greatest, "min": F.least}[keep]

    def fold(a: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            y = F.get(a, i + 1)
            twin = F.coalesce(y["d"] == x["d"], F.lit(False))
            low, high = F.least(x["low"], F.when(twin, y["low"])), F.greatest(x["high"], F.when(twin, y["high"]))
            size = F.when(low == high, x["n"] + F.when(twin, y["n"]).otherwise(F.lit(0).cast("long"))).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
            return F.struct(x["d"].alias("d"), pick(x["k"], F.when(twin, y["k"])).alias("k"), size.alias("n"), low.alias("low"), high.alias("high"))

        heads = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1)["d"] != x["d"]), entry(x, i))), lambda e: e.isNotNull())
        return heads

    return let(F.sort_array(run), fold)


def tree_merge(rows: DataFrame, keep: str = "max", runs: int = RUNS, bucket: int = BUCKET, total: int | None = None) -> DataFrame:
    """(_digest, _keep, _size) for each distinct digest of rows (_id, _digest, _guard, _run)."""
    pick = {"max": F.max, "min": F.min}[keep]
    total = rows.count() if total is None else total
    bits = max(4, (total // bucket).bit_length())
    # a run's own copies become one entry before anything moves
    entries = rows.groupBy("_run", "_digest").agg(pick("_id").alias("k"), F.count("*").alias("n"), F.min("_guard").alias("low"), F.max("_guard").alias("high"))
    part = F.shiftrightunsigned(F.conv(F.hex(F.substring("_digest", 1, 4)), 16, 10).cast("long"), 32 - min(bits, 32))
    entry = F.struct(F.col("_digest").alias("d"), "k", "n", "low", "high")
    level = entries.groupBy("_run", part.alias("_bucket")).agg(merged(F.collect_list(entry), keep).alias("_entries"))
    while runs > 1:
        runs //= 2  # the upper one of two neighbours goes to the lower one
        level = level.groupBy(F.shiftright("_run", 1).alias("_run"), "_bucket").agg(merged(F.flatten(F.collect_list("_entries")), keep).alias("_entries"))
    return level.select(F.explode("_entries").alias("_e")).select(F.col("_e.d").alias("_digest"), F.col("_e.k").alias("_keep"), F.col("_e.n").alias("_size"))


def classify(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, keep: str = "max") -> DataFrame:
    """For each row: id_col, keep_id, group_size, kept, text_sha256."""
    rows = durable(digest_rows(docs, id_col, text), "digests")
    total = rows.count()
    groups = durable(tree_merge(rows, keep, total=total).filter("_size > 1"), "groups")
    heavy = groups.filter(F.col("_size") * HEAVY > total)
    light = groups.filter(F.col("_size") * HEAVY <= total)
    rows = rows.select("_id", "_digest")
    hot = rows.join(F.broadcast(heavy), "_digest", "left")
    rest = hot.filter("_size is null").select("_id", "_digest").join(light.hint("merge"), "_digest", "left")
    both = hot.filter("_size is not null").unionByName(rest)
    keep_id = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return both.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, keep: str = "max") -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group of equal texts."""
    spark = docs.sparkSession
    rows = durable(digest_rows(docs, id_col, text), "digests")
    stay = durable(tree_merge(rows, keep), "stay")
    keeps = stay.select(F.col("_digest").alias("_larkspur_digest"), F.col("_keep").alias("_larkspur_keep"))
    again = rows.groupBy("_id").count().filter("count > 1").select("_id")
    again = durable(again.join(stay.hint("merge"), F.col("_id").eqNullSafe(F.col("_keep")), "left_semi").select(F.col("_id").alias("_larkspur_id")), "again")
    discard(spark, rows)
    mine = docs[id_col]
    if again.isEmpty():
        return docs.join(keeps.hint("merge"), mine.eqNullSafe(F.col("_larkspur_keep")), "left_semi")  # one way at every size
    # an id that several rows bear: one row of each text stays
    single = keeps.join(again, F.col("_larkspur_keep").eqNullSafe(F.col("_larkspur_id")), "left_anti")
    once = docs.join(single.hint("merge"), mine.eqNullSafe(F.col("_larkspur_keep")), "left_semi")
    t = text_of() if text is None else text
    several = docs.withColumn("_larkspur_own", F.unhex(F.sha2(t.cast("binary"), 256)))
    several = several.join(again, mine.eqNullSafe(F.col("_larkspur_id")), "left_semi").dropDuplicates([id_col, "_larkspur_own"])
    several = several.join(keeps, (several["_larkspur_own"] == keeps["_larkspur_digest"]) & several[id_col].eqNullSafe(keeps["_larkspur_keep"]), "left_semi")
    return once.unionByName(several.select(*docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
