"""The shard store, and the operators that use it over many shards, long texts and shared ids."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from larkspur.llm import hashstore, jaccard, kneser_ney, repeats
from larkspur.llm.bytesops import CHUNK, SPACE, words
from pyspark.sql import functions as F

from . import brute


def texts(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_arrays_come_back_and_missing_shards_raise(tmp_path):
    uri = f"file:{tmp_path}/s"
    key = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 1000, np.uint64))
    for k in range(4):
        hashstore.write(uri, str(k), key=key if k == 0 else key[:0], n=np.arange(1000) if k == 0 else np.arange(0))
    store = hashstore.Shards(uri, 2, ("n",))
    there, n = store.look_up(np.append(key[::-1], np.uint64(3 << 62)))
    assert there.tolist() == [True] * 1000 + [False] and n.tolist() == [*range(999, -1, -1), 0]
    os.remove(f"{tmp_path}/s/2")
    assert not store.look_up(np.array([1], np.uint64))[0][0]
    with pytest.raises(FileNotFoundError):
        store.look_up(np.array([2 << 62], np.uint64))


def test_paths_without_a_store_are_refused(tmp_path):
    with pytest.raises(ValueError, match="URI"):
        hashstore.read(str(tmp_path), "0")


def test_open_shards_are_bounded(tmp_path):
    uri = f"file:{tmp_path}/many"
    for k in range(3 * hashstore.OPEN):
        hashstore.write(uri, str(k), key=np.array([k], np.uint64))
    before = len(os.listdir("/proc/self/fd"))
    for k in range(3 * hashstore.OPEN):
        assert hashstore.read(uri, str(k))["key"][0] == k
    assert len(hashstore._open) <= hashstore.OPEN and len(os.listdir("/proc/self/fd")) <= before + hashstore.OPEN


def test_keys_that_repeat_are_told_apart_by_their_check(tmp_path):
    uri = f"file:{tmp_path}/c"
    hashstore.write(uri, "0", key=np.array([5, 5, 5, 9], np.uint64), check=np.array([1, 2, 3, 1], np.uint64), v=np.array([10, 20, 30, 40]))
    hashstore.write(uri, "1", key=np.empty(0, np.uint64), check=np.empty(0, np.uint64), v=np.empty(0, np.int64))
    there, v = hashstore.Shards(uri, 1, ("v",), checked=True).look_up(np.array([5, 5, 5, 5, 9, 9, 1], np.uint64), np.array([3, 1, 2, 4, 1, 2, 1], np.uint64))
    assert there.tolist() == [True, True, True, False, True, False, False] and v.tolist() == [30, 10, 20, 0, 40, 0, 0]


def test_long_texts_are_hashed_in_sections():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 3 * CHUNK, dtype=np.uint8)
    data[rng.integers(0, len(data), len(data) // 6)] = 32
    data[CHUNK - 5000 : CHUNK + 5000] = 97  # a word over a border
    h, starts = words(data, np.array([0, len(data)]))
    raw = data.tobytes().split()
    assert starts.tolist() == [0, len(raw)] and len(set(zip(raw, h.tolist()))) == len(set(raw)) == len(set(h.tolist()))
    assert SPACE[32]


@pytest.mark.parametrize("fan", [1, 3])
def test_kneser_ney_over_many_shards(spark, sf, fan):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = kneser_ney.count(docs, spark, shard=500, fan=fan)
    assert model.bits >= 3 and model.bits > fan
    want = brute.kneser_ney(texts(docs), lambda d: False)
    for r in kneser_ney.score(docs, model).collect():
        n, known, _, _, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known) and r.score == pytest.approx(score, rel=1e-9)


def test_a_lost_shard_fails_the_scoring(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = kneser_ney.count(docs, spark)
    os.remove(f"{hashstore.local_path(model.uri)}/pairs/5")
    with pytest.raises(Exception, match="No such file"):
        kneser_ney.score(docs, model).collect()


@pytest.mark.parametrize(("fan", "hot"), [(1, 4096), (2, 2)])
def test_repeats_over_many_shards(distinct_docs, fan, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(distinct_docs, hot_limit=hot, shard=300, fan=fan).collect()}
    assert got == brute.repeats(texts(distinct_docs))


def test_repeats_across_the_sections_of_a_long_text(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2 * repeats.PARSED + 700_000))
    cut = repeats.PARSED
    copy = text[cut - 3000 : cut + 3000]
    long = text[: 2 * cut - 3000] + copy + text[2 * cut + 3000 :]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame([(2, long), (5, "x" + copy + "y")], "doc_id long, text string"), with_kept=True).collect()}
    assert got[2].spans == [2 * cut - 3000, 2 * cut + 3000] and got[5].spans == [1, 6001]
    assert got[2].n_bytes == len(long) and len(got[2].kept) == len(long) - 6000


@pytest.mark.parametrize("fan", [1, 3])
def test_jaccard_over_many_shards(distinct_docs, fan):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(distinct_docs, shard=400, fan=fan).collect()}
    assert got == brute.jaccard_components(texts(distinct_docs))


def test_one_id_with_two_texts_loses_no_link(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a + " q"), (5, b + " q"), (9, a), (9, b), (None, a)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("1", 37, "1"), ("5", 37, "5"), ("9", 36, "1"), ("9", 36, "5"), ("None", 36, "None")]


def test_two_bundles_of_sets_in_one_list(spark):
    """Many sets that share rare shingles in several components, in and beyond a part's size, with one bridge between two bundles."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    rows = {}
    for k in range(260):
        own = [f"o{k % 4}_{i}" for i in range(14)]
        w = common[:16] + own
        w[rng.randrange(len(w))] = f"x{k}"
        rows[k] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.jaccard_components(rows)


@pytest.mark.parametrize("limit", [1, None])
def test_open_pairs_are_all_that_may_link(limit):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(8, 30)).astype(np.uint64)) for _ in range(160)]
    sets = sorted(sets, key=len)
    n = np.array([len(s) for s in sets])
    bitmap = np.frombuffer(b"".join(jaccard.parity(np.concatenate(sets), np.append(0, np.cumsum(n)))), np.uint64).reshape(len(sets), -1)
    zero, none = np.zeros(len(n), np.int64), np.full(len(n), -1)
    i, j, sure, _, cut = jaccard.open_pairs(n, zero, np.arange(len(n)), none, zero, zero, zero + 1, bitmap, 80, limit)
    want = {(a, b) for a in range(len(n)) for b in range(a + 1, len(n)) if 100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (n[a] + n[b] - o)}
    assert want <= set(zip(i.tolist(), j.tolist())) and not sure.any() and not cut
    two = np.arange(len(n)) % 2
    i, j, _, _, cut = jaccard.open_pairs(n, zero, two, none, zero, zero, zero + 1, bitmap, 10, limit)
    assert (len(i) == 1 and cut) if limit == 1 else (len(i) > 1000 and not cut)
