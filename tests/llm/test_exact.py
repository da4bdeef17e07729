"""Operators whose results SQL or a plain program gives exactly."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from larkspur.llm import chat, components, exact_dedup, jaccard, kneser_ney, mixing, packing, registry, repeats, wordbpe
from larkspur.llm.wordbpe import WordIds
from pyspark.sql import functions as F

from . import brute


def texts(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert key(got.select(*names).collect()) == key(want[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty_sf, name):
    rows = registry.queries()[name](spark, empty_sf).collect()
    assert [r.conv_id for r in rows] == ([-7] if name.startswith("op9") else [])


@pytest.fixture(scope="module")
def odd_sf(spark, docs, sf, tmp_path_factory):
    """Null and repeated ids, extra columns with clashing names in all tables."""
    path = str(tmp_path_factory.mktemp("odd"))
    clash = {n: F.lit("x") for n in ("id", "_id", "_range", "shard", "n", "length", "epoch", "domain", "ids", "kept", "_digest", "_larger")}
    docs.withColumns(clash).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").withColumns({"text": F.lit("x"), "label": F.lit(7), "score": F.lit(0.5)}).write.parquet(f"{path}/labels.parquet")
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = turns.unionByName(turns.filter("conv_id in (3, 50)").withColumn("conv_id", F.lit(None).cast("long")))
    turns.withColumns({"ids": F.lit("x"), "loss": F.lit(1), "token_start": F.lit("y"), "content": F.lit(None).cast("string")}).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", [n for n in sorted(registry.queries()) if not n.startswith(("op4", "op9"))])
def test_every_row_gets_a_result(spark, docs, odd_sf, name):
    out = registry.queries()[name](spark, odd_sf)
    want = sorted(str(r[0]) for r in docs.select("doc_id").collect())
    got = out.filter("start = 0") if name.startswith("op1_") else out
    assert sorted(str(r.doc_id) for r in got.select("doc_id").collect()) == want


@pytest.mark.parametrize("name", ["op4_mix_sources", "op9_chat_format"])
def test_null_ids_and_clashing_columns(spark, odd_sf, name):
    """Against the query's SQL; a null id is an id like others."""
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd_sf}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, odd_sf)
    names = sorted(got.columns)
    if name == "op4_mix_sources":  # documents with one id tie; what is taken of each leaf doesn't depend on them
        sums = "SELECT domain, lang, source, epoch, CAST(sum(take_tokens) AS BIGINT) AS t FROM ({}) GROUP BY ALL"
        want = con.sql(sums.format(registry.oracle_sql()[name])).fetchall()
        got = got.groupBy("domain", "lang", "source", "epoch").agg(F.sum("take_tokens").alias("t"))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    else:
        want = con.sql(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["op1_pack_documents", "op3_toxicity", "op7_language_id", "op10_document_fingerprints"])
def test_very_long_texts(spark, tmp_path, name):
    """Texts beyond every section's size, in one word and in many."""
    rows = [(1, "word " * 700_000, "en"), (2, "x" * 2_500_000, "fr"), (3, "a short text of some words", "en"), (4, None, None)]
    rows = rows if name.startswith(("op3", "op7")) else [(i, t and t[:40_000], lang) for i, t, lang in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in registry.queries()[name](spark, str(tmp_path)).collect()} == {1, 2, 3, 4}


def test_deduplicate_keeps_one_of_each_text(docs):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.text or "" for r in rows) == sorted({r.text or "" for r in docs.collect()})
    least = exact_dedup.classify(docs.filter("doc_id < 100"), keep="min").filter("kept").collect()
    assert {r.keep_id for r in least} == {r.doc_id for r in least}


def test_one_digest_for_two_texts_fails(spark):
    rows = spark.createDataFrame([(1, b"d", 1, 0), (2, b"d", 2, 1)], "_id long, _digest binary, _guard long, _run int")
    with pytest.raises(Exception, match="share a SHA-256"):
        exact_dedup.tree_merge(rows).collect()


@pytest.mark.parametrize("keep", ["max", "min"])
def test_sorted_runs_are_merged_in_binomial_rounds(spark, keep):
    """Many small buckets and runs; and one array with each digest once at every level."""
    rows = [(i, f"{i * i % 97:02}" * 3, i % 97 * 0 + i * i % 97, i * 5 % 64) for i in range(900)] + [(None, "zz", 7, 3), (5, "zz", 7, 9)]
    df = spark.createDataFrame(rows, "_id long, _digest string, _guard long, _run int").withColumn("_digest", F.unhex(F.sha2("_digest", 256)))
    got = {bytes(r._digest): (r._keep, r._size) for r in exact_dedup.tree_merge(df, keep, bucket=4).collect()}
    want: dict = {}
    for i, text, *_ in rows:
        want.setdefault(hashlib.sha256(text.encode()).digest(), []).append(i)
    pick = {"max": max, "min": min}[keep]
    assert got == {d: (pick(x for x in ids if x is not None), len(ids)) for d, ids in want.items()}
    run = [(b"a", 1, 1, 0, 0), (b"b", 2, 1, 1, 1), (b"a", 3, 4, 0, 0), (b"c", None, 1, 2, 2)]
    one = spark.createDataFrame([(run,)], "r array<struct<d: binary, k: long, n: long, low: long, high: long>>").select(exact_dedup.merged(F.col("r"), keep).alias("m")).first().m
    assert [(bytes(e.d), e.k, e.n) for e in one] == [(b"a", pick(1, 3), 5), (b"b", 2, 1), (b"c", None, 1)]


def test_word_ids_equal_the_tokenizer():
    words = WordIds(packing.tokenizer_path())
    for t in ["", "Hello WORLD, it's 3.5!", "ΑΣ İstanbul Σ", "a\x1cb \x85 c\u2003d", "don't 'LL I'm é̀ ½ 漢字 \U0001f600", "x <|endoftext|> y", "line\nbreak\ttab\r\n"]:
        assert words.encode(t).tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_word_ids_tokenize_each_word_once():
    """However many words of its block are new between two uses of a word."""

    class Counted:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, word):
            self.calls += 1
            return self.model.tokenize(word)

    words = WordIds(packing.tokenizer_path())
    words.model = counted = Counted(words.model)
    n, letters = 170_000, "abcdefghijklmnopqrstuvwxyz"
    some = ["".join(letters[i // 26**k % 26] for k in range(4)) for i in range(n)]
    ids = words.encode(" ".join([*some, *some]))
    assert counted.calls == n and ids[: len(ids) // 2].tolist() == ids[len(ids) // 2 :].tolist()
    assert ids[:3000].tolist() == words.tokenizer.encode(" ".join(some[:3000]), add_special_tokens=False).ids[:3000]


def test_word_ids_of_blocks_and_sections(monkeypatch):
    """Texts beside each other, and one that is longer than a block, have the tokenizer's ids."""
    words = WordIds(packing.tokenizer_path())
    some = ["", "a, b; don't\n\n", "<|endoftext|>x", "ΑΣ  é̀, ½漢字.", " \t", "a, B; 3.5!", "1\x1c2\xa0\x0b3"]
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert [x.tolist() for x in words.encode_block(some)] == want == [x.tolist() for x in words.encode_block(some)]
    assert words.encode_block([]) == []
    monkeypatch.setattr(wordbpe, "BLOCK", 5)
    assert [words.encode(t).tolist() for t in some] == want
    text = "\n".join(some[1::2]) * 9
    assert words.encode(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [64, 4096])
def test_packing(spark, docs, length):
    out = packing.pack_documents(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), length=length, with_ids=True).toPandas()
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= length
    assert sorted(out["sequence_id"].unique()) == list(range(out["sequence_id"].nunique()))
    words = WordIds(packing.tokenizer_path())
    for doc, text in texts(docs).items():
        ids = [*words.encode(text or "").tolist(), 2]
        part = out[out["doc_id"] == doc].sort_values("start")
        assert doc is None or [i for x in part["ids"] for i in x] == ids
        assert doc is None or all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in part.itertuples())
    if length == 64:
        assert out["length"].sum() / (out["sequence_id"].nunique() * length) > 0.97


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {4096: 3, 1: 10}, {2000: 7, 3: 5000, 700: 11}, {i: 4097 - i for i in range(1, 4097, 7)}])
def test_pack_plan_places_every_piece_once(histogram):
    plan = packing.plan_packs(histogram)
    seen = set()
    for size, n in histogram.items():
        seq, off = plan.place(np.full(n, size), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist()):
            assert o + size <= 4096 and (s, o) not in seen
            seen.add((s, o))
    assert plan.sequences == len({s for s, _ in seen})


def test_kneser_ney(spark, sf):
    got = {r.doc_id: r for r in kneser_ney.op5_lm_scoring(spark, sf).collect()}
    docs = texts(spark.read.parquet(f"{sf}/documents.parquet"))
    want = brute.kneser_ney(docs, lambda d: brute.crc_bucket(d, 5) == 1)
    for d, (n, known, total, base, score) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.held_out == (brute.crc_bucket(d, 5) == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats(distinct_docs, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(distinct_docs, hot_limit=hot).collect()}
    assert got == brute.repeats(texts(distinct_docs))


def test_repeats_in_periodic_and_joined_texts(spark):
    a, b = "abcdefghij" * 11, "".join(chr(97 + i * i % 23) for i in range(140))
    rows = {3: a, 1: b + a, 2: "x" * 250, 7: b[10:120] + "y" + b[:105], 5: "xy" * 90, 9: "x" * 99}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(df, with_kept=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(rows)
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.spans) == 2 * r.n_spans


def test_suffix_order():
    text = np.frombuffer(b"banana" * 40, np.uint8)
    starts = np.arange(0, 140)
    order, runs = repeats.suffix_order(text, starts)
    strings = [text[s : s + 100].tobytes() for s in starts[order]]
    assert strings == sorted(strings) and len(runs) == len(set(strings))


def test_jaccard(distinct_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(distinct_docs).collect()}
    assert got == brute.jaccard_components(texts(distinct_docs))


def test_jaccard_with_chains_of_near_copies(spark):
    """Sets that drift apart: no pivot is near all of them, so links have to come from pairs inside lists."""
    words = [f"w{i}" for i in range(200)]
    rows = {}
    for i in range(60):
        w = list(words)
        for k in range(i):
            w[3 * k] = f"v{k}"
        rows[100 - i] = " ".join(w)
    rows |= {200 + i: " ".join(words[:150] + [f"z{i}_{k}" for k in range(i)]) for i in range(0, 60, 3)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute.jaccard_components(rows)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (10, 3), *((i, i + 1) for i in range(20, 50))]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 8: 8, 9: 8} | dict.fromkeys(range(20, 51), 20)


@pytest.mark.parametrize("text", ["", "\\", "###", "\\###", "\\\\###</turn>", "####", "</turn></turn>\\", "plain"])
def test_escape_round_trip(text):
    written = chat.escape(text)
    assert chat.unescape(written) == text
    bare = written.replace("\\\\", "")
    assert all(bare[: i].endswith("\\") for c in chat.CONTROL for i in [bare.find(c)] if i >= 0)


def test_chat_tokens_carry_the_template(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi ###"), (1, 1, "assistant", "yes </turn>")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows).orderBy("token_start").collect()
    codec = chat.Codec(chat.tokenizer_path())
    ids = [i for r in out for i in r.ids]
    assert codec.decode(ids) == "### User: hi \\###</turn>\n### Assistant: yes \\</turn></turn>\n"
    assert out[0].loss_start is None and codec.decode(ids[out[1].loss_start : out[1].loss_end]) == "yes \\</turn>"


def test_mixing_gives_shortages_to_siblings_first(spark):
    rows = [(i, "w " * 10, "en", f"src{s}") for i, s in enumerate([0] * 50 + [4] * 5 + [1] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"domain": {"web": 1, "books": 1}, "lang": {}, "source": {}}
    taken = mixing.mix(docs, weights, 50)
    got = {r.source: r.n for r in taken.groupBy("source").agg(F.sum("take_tokens").alias("n")).collect()}
    # half of 1550 is 775: 387 for each domain; src4 has 50 only, its sibling src0 takes the rest of the domain's share
    assert got == {"src0": 337, "src4": 50, "src1": 387}
    whole = mixing.mix(docs, {"domain": {}, "lang": {}, "source": {"src1": 0}}, 80, epochs=3)
    assert whole.filter("source = 'src1'").count() == 0 and whole.agg(F.max("epoch")).first()[0] == 2
