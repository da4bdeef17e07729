"""Document fingerprints: one-permutation MinHash in SQL functions.

Each word is hashed once, and each five-word shingle by its words' hashes. The top bits of the hash choose one of BINS
bins, the least hash of a bin is its sketch, and an empty bin copies the sketch of a
bin that is found by hashing (own bin, attempt) until a filled one is met (optimal
densification). A fingerprint stores the low BITS bits of each bin's sketch, hashed
with the bin's number so that copies of one sketch don't agree or differ all at once; two unlike bins
agree by chance with probability 2^-BITS, which ``likeness`` corrects for.

The next document is found inside ranges of ids. Their number follows the bytes of the input, an id that many
rows bear (null too) gets several ranges by a hash of the text, and only texts move, once; hashes and
sketches are worked out behind that, and an edited text takes over the hashes of the shingles that it keeps.

Cases: words are runs without ASCII white space, in their own case; fewer than five
words are one shingle; null and white-space texts have no shingle, their fingerprint
is the empty string, like only to itself. Repeated rows and equal texts have equal
fingerprints. "Next" follows ascending id, nulls first, equal ids by a hash of the text; the last
row's next is the first row. Long texts are hashed whole; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import ODD, mix
from .common import WORD, let, table, text_of, words_of

BINS, BITS, SHINGLE = 256, 8, 5
#: The first attempts look up their bin in a table, which is made by hashing; TRIES more hash on the way, in goes; after them the next filled bin in a circle.
TABLED, TRIES = 8, (32, 512)
#: Id ranges that rows are dealt out to for finding the next row: one for RANGE_BYTES of text; beyond MOST of them they grow, and sort with spills.
RANGE_BYTES, LEAST, MOST = 64 << 20, 64, 1 << 16


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def shingles_from(hashes: Column, first: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of size word hashes that begin at first or later; there are size of them at least."""
    return F.transform(F.sequence(first, F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of size words; of the whole sequence where there are fewer."""

    def of(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, F.array(F.xxhash64(w))).otherwise(shingles_from(w, F.lit(0), size))

    return let(word_hashes(words_of(text)), of)


def edited_hashes(own: Column, kept: Column, edited: Column, size: int = SHINGLE) -> Column:
    """shingle_hashes of edited, a text whose beginning, kept, it shares with the text of own.

    All words of kept but its last are words of both; shingles of those are taken from own.
    """
    taken = F.greatest(F.regexp_count(kept, F.lit(WORD)) - size, F.lit(0))

    def of(x: Column) -> Column:
        later = let(word_hashes(F.slice(x["words"], x["taken"] + 1, F.size(x["words"]))), lambda w: shingles_from(w, F.lit(0), size))
        return F.when(F.size(x["words"]) < size, shingle_hashes(edited, size)).otherwise(F.concat(F.slice(own, 1, x["taken"]), later))

    return let(F.struct(words_of(edited).alias("words"), taken.alias("taken")), of)


def sketch(hashes: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """array<int> of bins low-order values; empty if there are no hashes."""
    width = bins.bit_length() - 1
    bin_of = lambda x: F.shiftright(x, 64 - width) + bins // 2  # noqa: E731  ascending with the signed hash
    low = lambda x, b: F.xxhash64(x, b).bitwiseAND((1 << bits) - 1).cast("int")

    def minima(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))

    def dense(m: Column) -> Column:
        gap = lambda n: F.array_repeat(F.lit(None).cast("long"), n.cast("int"))
        after = lambda i: F.coalesce(bin_of(F.get(m, i + 1)), F.lit(bins).cast("long"))
        filled = F.transform(m, lambda x, i: F.concat(F.array(x), gap(after(i) - bin_of(x) - 1)))
        return F.concat(gap(bin_of(m[0])), F.flatten(filled))

    def densify(d: Column) -> Column:
        def probe(b: Column, first: int, last: int) -> Column:
            seen = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda t: F.get(d, F.pmod(F.xxhash64(b, t), F.lit(bins)).cast("int")))
            return F.get(F.filter(seen, lambda v: v.isNotNull()), F.lit(0))

        def round_about(b: Column) -> Column:
            return F.get(F.array_compact(F.concat(F.slice(d, b + 1, F.lit(bins)), d)), F.lit(0))

        goes = list(zip((TABLED + 1, *(t + 1 for t in TRIES)), TRIES))
        return F.transform(d, lambda v, b: F.coalesce(v, *[F.get(d, F.get(table, b)) for table in tables], *[probe(b, *go) for go in goes], round_about(b)))

    attempts = mix(np.arange(bins * TABLED, dtype=np.uint64).reshape(TABLED, bins) + ODD[0]) % np.uint64(bins)
    tables = [F.split(F.lit(",".join(map(str, row))), ",").cast("array<int>") for row in attempts.tolist()]
    none = F.array().cast("array<int>")
    return let(hashes, lambda h: F.when(F.size(h) == 0, none).otherwise(F.transform(let(let(let(F.sort_array(h), minima), dense), densify), low)))


def pack(values: Column) -> Column:
    """The sketch as lower-case hex, BITS = 8 bits a bin."""
    return F.array_join(F.transform(values, lambda v: F.substring(F.lower(F.hex(v + 256)), 2, 2)), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard likeness of two sketches, 0 to 1, without the agreement that low-order bits have by chance."""
    chance = 2.0**-bits
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    j = F.greatest(F.lit(0.0), (same / F.size(a) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(j)


def ranged(rows: DataFrame, id_col: str, hash_col: str, text: str) -> DataFrame:
    """rows with _range: ranges ascend with (id_col, nulls first, hash_col)."""
    total, nulls, size = rows.agg(F.count("*"), F.count_if(F.col(id_col).isNull()), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    ranges = min(MOST, max(LEAST, size // RANGE_BYTES))
    marks = rows.agg(F.percentile_approx(id_col, [i / ranges for i in range(ranges)], 20 * ranges)).first()[0]
    of_null = -(-nulls * ranges // max(total, 1))
    # a bound that is there several times is an id with that many ranges' rows
    bounds = sorted(Counter(marks or [0]).items())
    starts = [of_null]
    for _, times in bounds:
        starts.append(starts[-1] + times)
    width = int(len(bounds) ** 0.5) + 1
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  one literal
    values, firsts, tops = longs([b for b, _ in bounds]), longs(starts), longs([b for b, _ in bounds[::width]])
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(id_col)))
    # by one of every width bounds, then among those behind it
    place = let(F.greatest(upto(tops) - 1, F.lit(0)) * width, lambda k: k + F.greatest(upto(F.slice(values, k + 1, F.lit(width))) - 1, F.lit(0)))
    slice_of = lambda n: F.least(F.floor((F.col(hash_col) / 2.0**64 + 0.5) * n), n - 1)
    known = let(place, lambda k: F.when(F.get(values, k) == F.col(id_col), F.get(firsts, k) + slice_of(F.get(firsts, k + 1) - F.get(firsts, k))).when(F.get(values, k) < F.col(id_col), F.get(firsts, k + 1) - 1).otherwise(F.get(firsts, k)))
    own = F.when(F.col(id_col).isNull(), slice_of(F.lit(max(of_null, 1)))).otherwise(known)
    return rows.withColumn("_range", own.cast("int"))


def with_marks(rows: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """rows (with _range) and a copy of each range's first row, as a _mark, in the range before it: each range finds all its followers by itself."""
    firsts = rows.groupBy("_range").agg(F.min(F.struct(F.col(id_col).isNotNull().alias("a"), F.col(id_col).alias("b"), F.col(hash_col).alias("c"))).alias("f")).orderBy("_range").collect()  # one for each range
    before = {r["_range"]: firsts[k - 1]["_range"] for k, r in enumerate(firsts)}
    spark = rows.sparkSession
    to = spark.createDataFrame([(r["_range"], r["f"]["b"], r["f"]["c"], before[r["_range"]]) for r in firsts], "_own int, _b long, _c long, _to int")
    same = (F.col("_range") == F.col("_own")) & F.col(id_col).eqNullSafe(F.col("_b")) & (F.col(hash_col) == F.col("_c"))
    marks = rows.join(F.broadcast(to), same).dropDuplicates(["_own"]).withColumn("_range", F.col("_to")).select(*rows.columns)
    return rows.withColumn("_mark", F.lit(False)).unionByName(marks.withColumn("_mark", F.lit(True)))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    rows = with_marks(ranged(rows, "_id", "_hash", "_text"), "_id", "_hash")
    order = Window.partitionBy("_range").orderBy("_mark", F.col("_id").asc_nulls_first(), "_hash")
    keys = ["_range", "_mark", "_id", "_hash"]
    rows = rows.withColumn("_next", F.lead("_text").over(order))
    n = F.char_length("_text")
    cut = F.floor(n / 4).cast("int")
    kept = F.substring(F.col("_text"), F.lit(1), n - cut)
    rows = rows.select(*keys, "_text", n.cast("long").alias("n_chars"), kept.alias("_kept"), F.concat(kept, F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut)).alias("_edited"))
    both = let(shingle_hashes(F.col("_text")), lambda h: F.struct(sketch(h).alias("own"), F.when(~F.col("_mark"), sketch(edited_hashes(h, F.col("_kept"), F.col("_edited")))).alias("edited")))
    rows = rows.select(*keys, "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), both.alias("_s"))
    rows = rows.withColumn("_next", F.lead("_s.own").over(order)).filter(~F.col("_mark"))
    return rows.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        pack(F.col("_s.own")).alias("fingerprint"),
        pack(F.col("_s.edited")).alias("edited_fingerprint"),
        likeness(F.col("_s.own"), F.col("_s.edited")).alias("near_edited"),
        likeness(F.col("_s.own"), F.col("_next")).alias("near_next"),
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
