"""Operators that estimate or learn: against exact values, and on held-out rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from larkspur.llm import fingerprint, langid, toxicity
from pyspark.sql import functions as F

from . import brute


split = re.compile(r"[^\x20\x09-\x0D]+").findall


def test_fingerprints(spark, distinct_docs):
    rows = sorted((r.doc_id, r.text or "") for r in distinct_docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(distinct_docs).collect()}
    errors = []
    for k, (d, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = (set(zip(*[split(x)[i:] for i in range(5)])) or {tuple(split(x))} - {()} for x in (text, other))
            exact = len(a & b) / len(a | b) if a or b else 1.0
            errors.append(abs(near - exact))
    assert np.mean(errors) < 0.03 and max(errors) < 0.2
    by_text = {}
    for d, text in rows:
        assert by_text.setdefault(text, got[d].fingerprint) == got[d].fingerprint


def test_sketch_is_minimal_hash_of_each_bin(spark):
    hashes = [int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 700)]
    row = spark.createDataFrame([(hashes,)], "h array<long>").select(fingerprint.sketch(F.col("h")).alias("s")).first()
    least = {}
    for h in sorted(hashes):
        least.setdefault((h >> 56) + 128, h)
    want = spark.createDataFrame(list(least.items()), "b int, h long").select("b", F.xxhash64("h", "b").alias("x")).collect()
    assert len(row.s) == 256 and len(want) > 200 and all(row.s[r.b] == r.x & 255 for r in want)


@pytest.mark.parametrize("ids", [[5, 1, 9, 3, 7, None], [None] * 40 + [2] * 30 + list(range(20)), [4], list(range(300))])
def test_next_row_over_ranges(spark, ids):
    """The chain of next rows visits all rows by (id, hash), whatever ranges they are in."""
    df = spark.createDataFrame([(i, f"t{i}-{k % 25}") for k, i in enumerate(ids)], "id long, t string").withColumn("h", F.xxhash64("t")).repartition(3)
    rows = fingerprint.with_marks(fingerprint.ranged(df, "id", "h", "t"), "id", "h").collect()
    assert sum(not r._mark for r in rows) == len(ids) and sum(r._mark for r in rows) == len({r._range for r in rows if not r._mark})
    key = lambda r: (r.id is not None, r.id or 0, r.h)
    plain = sorted((r for r in rows if not r._mark), key=key)
    assert [r._range for r in plain] == sorted(r._range for r in plain)
    for a, b in zip(plain, [*plain[1:], plain[0]]):
        own = sorted((r for r in rows if r._range == a._range), key=lambda r: (r._mark, *key(r)))
        at = max(k for k, r in enumerate(own) if not r._mark and key(r) == key(a))
        if key(b) != key(a):
            assert key(own[at + 1]) == key(b)
    if ids.count(None) == 40:
        assert len({r._range for r in plain if r.id is None}) > 5 and len({r._range for r in plain if r.id == 2}) > 5


def test_edited_hashes_equal_hashing_anew(spark):
    texts = ["", "a", "a b c d", "a b c d e", "  a b  c d e f g ", "one two three four five six seven eight nine ten", "x" * 50, "a b c d e f g h"]
    rows = [(t, t[: len(t) - c], t[: len(t) - c] + o) for t in texts for c in range(len(t) // 4 + 1) for o in ("", "z", " z y", "z y x w v u")]
    h = lambda c: F.array_sort(F.array_distinct(c))
    df = spark.createDataFrame(rows, "t string, kept string, edited string")
    got = df.select("t", "kept", "edited", h(fingerprint.edited_hashes(fingerprint.shingle_hashes(F.col("t")), F.col("kept"), F.col("edited"))).alias("a"), h(fingerprint.shingle_hashes(F.col("edited"))).alias("b"))
    assert got.filter("a <> b").collect() == []


def test_toxicity_on_held_out_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = np.array("the of and river stone light water green slow house".split())
    rows, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, rng.integers(5, 60)))
        bad = int(i % 5 == 0)
        if bad:
            text.insert(int(rng.integers(0, len(text))), rng.choice(["idiot", "scum", "pathetic"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, bad))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op3_toxicity(spark, str(tmp_path)).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if brute.crc_bucket(i, 5) == 0}
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_toxicity_features_are_the_texts_ngrams():
    import pyarrow as pa

    texts = ["Abc  abc", "", "ab", "é\nx"]
    for _, _, row, feature in toxicity.features(pa.array(texts)):
        for k, t in enumerate(texts):
            raw = bytes(32 if c in b" \t\n\r\v\f" else c for c in t.encode().lower())
            grams = {raw[i : i + n] for n in toxicity.ORDERS for i in range(len(raw) - n + 1)}
            assert (row == k).sum() == len(grams)


def test_gradient_through_time():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in langid.hold_padding(langid.start_weights(3)).items()}
    codes = rng.integers(60, 70, (9, 5))
    codes[6:, 2] = langid.PAD
    label = np.array([0, 1, 2, 0, 1])
    _, g = langid.gradient(w, codes, label)
    for k, i in (("embed", (0, 0, 62, 3)), ("embed", (1, 2, 65, 2)), ("embed", (1, 1, 65, 2)), ("recur", (0, 0, 2, 5)), ("recur", (1, 1, 3, 1)), ("recur", (1, 2, 3, 1)), ("out", (1, 2, 1)), ("bias", (1,))):
        held = w[k][i]
        w[k][i] = held + 1e-5
        up = langid.gradient(w, codes, label)[0]
        w[k][i] = held - 1e-5
        down = langid.gradient(w, codes, label)[0]
        w[k][i] = held
        assert (up - down) / 2e-5 == pytest.approx(g[k][i], rel=1e-3, abs=1e-7)


def test_segments_add_up_to_the_whole_text():
    """Against the plain network: whole texts up to a segment exactly, longer ones as their layers run in."""
    rng = np.random.default_rng(1)
    w = langid.hold_padding(langid.start_weights(3))
    sizes = [0, 1, 70, langid.SEGMENT, langid.SEGMENT + 1, 3 * langid.SEGMENT + 17]
    data = rng.integers(97, 123, sum(sizes), dtype=np.uint8)
    offsets = np.append(0, np.cumsum(sizes))
    total = np.zeros((len(sizes), 3))
    langid.add_up(w, data, offsets, np.array([True] * 5 + [True]), total)
    for k, n in enumerate(sizes):
        if n:
            whole = langid.probabilities(w, data[offsets[k] : offsets[k + 1]].astype(np.int32)[:, None]).sum((1, 2))
            assert total[k] == pytest.approx(whole, rel=1e-3 if n > langid.SEGMENT else 1e-5)
    assert total.sum(1) == pytest.approx(np.array(sizes), rel=1e-4)


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, f"text {i} {'ab'[i % 2]}", "ab"[i % 2]) for i in range(400)], "doc_id long, text string, lang string")
    few = [toxicity.least_hashed(rows.repartition(n), 30, "doc_id", "text") for n in (1, 7)]
    ids = [sorted(r.doc_id for r in x.collect()) for x in few]
    assert ids[0] == ids[1] and len(ids[0]) == 30
    (_, a), (_, b) = (langid.train(rows.repartition(n), 20) for n in (1, 7))
    assert all((a[k] == b[k]).all() for k in a)


def test_logistic_fit_reaches_the_least_loss():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5))
    y = (x @ [1.0, -2, 0, 0.5, 0] + rng.normal(size=200) > 0.3).astype(float)
    doc, feature = np.repeat(np.arange(200), 5), np.tile(np.arange(5), 200)
    w, b = toxicity.fit_logistic(doc, feature, x.ravel(), y, 5, steps=200, ridge=1e-2)
    gap = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ gap / 200 + 1e-2 * w).max() < 1e-3 and abs(gap.mean()) < 1e-3


def test_language_id_on_held_out_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    parts = {"aa": ["th", "ing", "ou", "er"], "bb": ["ção", "ña", "os", "rr"], "cc": ["sch", "ß", "ü", "ein"]}
    rows = []
    for i in range(600):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(3, 40)))), lang))
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in langid.op7_language_id(spark, str(tmp_path)).collect()}
    held = [(out[i].lang_pred, lang) for i, _, lang in rows[:600] if out[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1000, 1001, 1002))
    assert all(out[i].held_out == (brute.crc_bucket(i, 4) == 2) for i in out)
