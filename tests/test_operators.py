"""Operators on hand-made rows."""

from __future__ import annotations

import pytest
from larkspur import streaming
from larkspur.functions import embedding, text
from larkspur.operators import aggregates, evaluate, filters, graph, lifecycle, maintenance, recall, requests
from larkspur.operators.filters import RecallFilters, Scope
from larkspur.operators.scoring import Engine, Query
from larkspur.sources.records import DDL, conform, episode, from_json, read_corpus, to_json, violations
from larkspur.sources.store import Conflict, Invalid, NotFound, Store, numbered
from pyspark.sql import functions as F

NOW = 10 * 86_400_000
SCOPE = Scope("t", "n", "a", source="chat")


def records(spark, rows: list[dict], episodes: dict[str, dict] | None = None):
    """Record rows; episodes: id -> episode fields."""
    base = {"tenant_id": "t", "namespace": "n", "actor_id": "a", "source": "chat", "trust_level": "Derived", "kind": "Fact", "quality_state": "Active", "created_at_unix_ms": NOW, "updated_at_unix_ms": NOW, "importance_score": 0.5, "historical_state": "Current"}
    names = [x.split()[0] for x in DDL.split(", ") if x.split()[0] in {*base, "id", "content", "summary", "expires_at_unix_ms", "conversation_id", "session_id", "labels"}]
    kinds = {"created_at_unix_ms": "long", "updated_at_unix_ms": "long", "expires_at_unix_ms": "long", "importance_score": "double", "labels": "array<string>"}
    data = [tuple(({"content": f"text {r['id']}"} | base | r).get(k) for k in names) for r in rows]
    df = conform(spark.createDataFrame(data, ", ".join(f"{k} {kinds.get(k, 'string')}" for k in names)))
    for rid, fields in (episodes or {}).items():
        given = {k: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v) for k, v in fields.items()}
        df = df.withColumn("episode", F.when(F.col("id") == rid, episode(**given)).otherwise(F.col("episode")))
    return df


def ids(df, *order):
    return [r.id for r in (df.orderBy(*order) if order else df).collect()]


def test_terms_match_as_substrings_and_repeats_count(spark):
    r = records(spark, [{"id": "x", "content": "Reconnection storm", "importance_score": 0.0, "source": "other", "updated_at_unix_ms": 0}])
    row = recall.recall(r, Query("connect STORM storm", SCOPE, NOW)).first()
    assert (row.lexical, row.matched_terms) == (3.0, ["connect", "storm", "storm"])
    # 3 terms, no freshness, policy 0; provenance of Derived, Active, Current
    assert row.total == pytest.approx(3 + 0.03 + 0.06)


def test_score_by_hand(spark):
    r = records(spark, [{"id": "x", "content": "b", "labels": ["Beta", "c"], "updated_at_unix_ms": NOW - 84 * 3_600_000, "trust_level": "Pinned"}], {"x": {"episode_id": "e", "goal": "b", "previous_record_id": "w"}})
    row = recall.recall(r, Query("b what changed", SCOPE, NOW)).first()
    assert (row.metadata_score, row.temporal) == (1.0, pytest.approx(0.5))
    assert row.episodic == pytest.approx(0.2 + 0.25)
    assert row.total == pytest.approx(1 + 0.4 + 0.1 + 0.35 * 0.45 + 0.5 + 0.12 + 0.14 + 0.03 + 0.06)


def test_orders_and_ties(spark):
    r = records(spark, [{"id": k, "content": "q", "updated_at_unix_ms": NOW - d} for k, d in (("b", 0), ("a", 0), ("c", 5))])
    q = lambda **x: Query("q", SCOPE, NOW, **x)
    assert ids(recall.recall(r, q()), "rank") == ["a", "b", "c"]
    assert ids(recall.recall(r, q(temporal_order="ChronologicalAsc")), "rank") == ["c", "a", "b"]
    assert ids(recall.recall(r, q(max_items=1)), "rank") == ["a"]
    assert ids(recall.recall(r, Query(" ", SCOPE, NOW)), "rank") == ["a", "b", "c"]


def test_budget_skips_what_does_not_fit(spark):
    sizes = {"a": 9, "b": 5, "c": 2, "d": 1}
    r = records(spark, [{"id": k, "content": " ".join(["q"] * n), "importance_score": 1 - i / 10} for i, (k, n) in enumerate(sizes.items())])
    assert ids(recall.recall(r, Query("q", SCOPE, NOW, token_budget=10)), "rank") == ["a", "d"]
    assert ids(recall.recall(r, Query("q", SCOPE, NOW, token_budget=1)), "rank") == ["a"]


def test_expansion_follows_own_links_only_and_hops_add_up(spark):
    r = records(spark, [{"id": k, "content": "seed" if k == "s" else "x"} for k in "sabcd"], {"a": {"episode_id": "e1", "previous_record_id": "s"}, "b": {"episode_id": "e2", "causal_record_ids": ["a"], "related_record_ids": ["a"]}, "c": {"episode_id": "e3"}, "s": {"episode_id": "e4", "next_record_id": "d"}})
    found = lambda hops: {x.id: (round(x.graph, 2), x.relation_reasons) for x in graph.expand(r, r.filter("id = 's'"), hops).collect()}
    assert found(0) == {}
    assert found(1) == {"a": (0.35, ["graph_relation=chronology", "graph_hop=1"])}
    assert found(2) == {"a": found(1)["a"], "b": (0.28, ["graph_relation=causal", "graph_relation=related", "graph_hop=2"])}
    assert set(found(3)) == {"a", "b"}
    fast = recall.candidates(r, Query("seed", SCOPE, NOW), Engine())
    slow = recall.candidates(r, Query("seed", SCOPE, NOW), Engine(planning="ContinuityAware"))
    assert ids(fast) == ["s"] and sorted(ids(slow)) == ["a", "s"]


def test_scope_never_leaks(spark):
    r = records(spark, [{"id": "mine"}, {"id": "tenant", "tenant_id": "u"}, {"id": "space", "namespace": "m"}, {"id": "actor", "actor_id": "b"}])
    assert ids(recall.recall(r, Query("text", SCOPE, NOW))) == ["mine"]


def test_anchor_errors(spark):
    r = records(spark, [{"id": "a"}, {"id": "b", "updated_at_unix_ms": NOW + 1}])
    with pytest.raises(ValueError, match="not in scope"):
        filters.filtered(r, SCOPE, RecallFilters(after_record_id="zz"), NOW)
    with pytest.raises(ValueError, match="not earlier"):
        filters.filtered(r, SCOPE, RecallFilters(after_record_id="b", before_record_id="a"), NOW)


@pytest.mark.parametrize(
    ("change", "rule"),
    [({"id": " "}, "id"), ({"actor_id": "\n"}, "actor_id"), ({"content": ""}, "content"), ({"importance_score": 1.1}, "importance_score"), ({}, None)],
)
def test_validation(spark, change, rule):
    got = records(spark, [{"id": "x"} | change]).select(violations().alias("v")).first().v
    assert got == ([rule] if rule else [])


@pytest.mark.parametrize(
    ("fields", "rule"),
    [
        ({"schema_version": 2}, "episode.schema_version"), ({"episode_id": " "}, "episode.episode_id"), ({"previous_record_id": "x"}, "episode.previous_record_id"), ({"causal_record_ids": ["x"]}, "episode.causal_record_ids"),
        ({"started_at_unix_ms": 5, "ended_at_unix_ms": 4}, "episode.ended_before_started"), ({"recurrence_interval_ms": 3}, "episode.interval_without_key"), ({"actor_ids": ["z"]}, "episode.actor_ids"), ({"actor_ids": ["a"]}, None),
    ],
)
def test_episode_validation(spark, fields, rule):
    got = records(spark, [{"id": "x"}], {"x": {"episode_id": "e"} | fields}).select(violations().alias("v")).first().v
    assert got == ([rule] if rule else [])


def fnv(token: bytes, seed: int) -> int:
    h = seed
    for b in token:
        h = ((h ^ b) * ((1 << 40) + 435)) & ((1 << 64) - 1)
    return h


def test_hash_embedding(spark):
    words = ["naïve", "storm", "x1", "storm"]
    want = [0.0] * 64
    for w in words:
        a, b, s = (fnv(w.encode(), seed) for seed in embedding.SEEDS)
        sign = 1.0 if s % 2 == 0 else -1.0
        want[a % 64] += sign
        want[b % 64] += sign / 2
    norm = sum(x * x for x in want) ** 0.5
    row = spark.createDataFrame([("(NAïve) storm, x1 -- Storm!",), ("...",)], "t string").select(embedding.hash_embedding(F.col("t")).alias("v")).collect()
    assert row[0].v == pytest.approx([x / norm for x in want]) and set(row[1].v) == {0.0}


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(embedding.cosine("a", "b")).collect()] == [0.7071, 0, 0, 0]


def test_lifecycle(spark):
    r = records(spark, [{"id": "x"}])
    a = lifecycle.archive(r, NOW).first()
    assert (a.changed, a.quality_state, a.historical_state) == (True, "Archived", "Historical")
    again = lifecycle.archive(lifecycle.archive(r, NOW).drop("changed"), NOW + 1).first()
    assert not again.changed and again.updated_at_unix_ms == NOW
    with pytest.raises(ValueError, match="recover"):
        lifecycle.recover(r, NOW, "Draft")


def test_compaction(spark):
    r = records(spark, [{"id": k, "content": c, "updated_at_unix_ms": NOW - i} for i, (k, c) in enumerate([("a", "Same "), ("b", "same"), ("c", "same"), ("d", "other")])])
    out = {x.id: x for x in maintenance.compact(r, "t", NOW + 9, summarize_after=3).collect()}
    assert [out[k].quality_state for k in "abcd"] == ["Active", "Archived", "Archived", "Active"] and out["b"].historical_state == "Superseded"
    summary = next(x for k, x in out.items() if k.startswith("compacted-summary-"))
    assert [m.record_id for m in summary.lineage] == ["a", "b", "c"] and out["b"].lineage[-1].record_id == summary.id
    assert summary.content.startswith("Compacted 3 related records") and summary.labels == ["compacted"]


def test_retention_cap_spares_the_newest_and_pinned(spark):
    r = records(spark, [{"id": f"r{i}", "updated_at_unix_ms": NOW - i} for i in range(5)] + [{"id": "p", "trust_level": "Pinned", "updated_at_unix_ms": 0}, {"id": "gone", "expires_at_unix_ms": NOW}])
    plan = {x.id: x.action for x in maintenance.retention_plan(r, maintenance.Retention(max_records_per_namespace=3), NOW).collect()}
    assert plan == {"r4": "archive_over_cap", "r3": "archive_over_cap", "gone": "delete"}


def test_retention_goes_by_creation_and_sets_updated_at(spark):
    day = 86_400_000
    r = records(spark, [{"id": "old", "created_at_unix_ms": 0, "updated_at_unix_ms": NOW - 1}, {"id": "new", "created_at_unix_ms": NOW - 1, "updated_at_unix_ms": 0}, {"id": "pin", "created_at_unix_ms": 0, "trust_level": "Pinned"}, {"id": "hidden", "created_at_unix_ms": 0, "quality_state": "Suppressed"}])
    off = maintenance.Retention(archive_after_days=5, max_records_per_namespace=0)
    assert {x.id: x.action for x in maintenance.retention_plan(r, off, NOW).collect()} == {"old": "archive"}
    after = {x.id: (x.quality_state, x.historical_state, x.updated_at_unix_ms) for x in maintenance.apply_retention(r, off, NOW + day).collect()}
    assert after["old"] == ("Archived", "Historical", NOW + day) and after["new"] == ("Active", "Current", 0)
    both = maintenance.Retention(archive_after_days=5, max_records_per_namespace=1)
    assert {x.id: x.action for x in maintenance.retention_plan(r, both, NOW).collect()} == {"old": "archive"}


def test_retention_cap_on_a_large_namespace(spark):
    r = records(spark, [{"id": f"r{i:03}", "updated_at_unix_ms": NOW - i % 50, "importance_score": (i % 3) / 3} for i in range(300)] + [{"id": "o", "namespace": "m"}])
    got = {x.id for x in maintenance.retention_plan(r, maintenance.Retention(max_records_per_namespace=120), NOW).collect()}
    order = sorted(range(300), key=lambda i: (NOW - i % 50, (i % 3) / 3, f"r{i:03}"))
    assert got == {f"r{i:03}" for i in order[:180]}


def test_compaction_counts(spark):
    r = records(spark, [{"id": k, "content": c, "importance_score": 0.1, "updated_at_unix_ms": 0} for k, c in (("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "y"), ("f", "z"))])
    wet = aggregates.compaction_counts(r, "t", NOW, summarize_after=3, cold_after_days=1).first()
    assert tuple(wet) == (3, 6, 3, 1, 6)  # three superseded, and a, d and f are cold
    dry = aggregates.compaction_counts(r, "t", NOW, summarize_after=3, cold_after_days=1, dry_run=True).first()
    assert tuple(dry) == (3, 9, 3, 1, 3)


def test_planner_metrics_and_loads(spark):
    r = records(spark, [{"id": k, "content": "seed" if k == "s" else "x"} for k in "sabcd"], {"a": {"episode_id": "e1", "previous_record_id": "s"}, "b": {"episode_id": "e2", "causal_record_ids": ["a"]}})
    found = recall.candidates(r, Query("seed", SCOPE, NOW), Engine(planning="ContinuityAware", max_hops=3))
    assert tuple(aggregates.planner_metrics(found).first()) == (1, 2, 2)
    traces = spark.createDataFrame([("t", 5, None), ("t", 8, "Ok"), ("t", None, None), ("u", None, None)], "tenant_id string, queue_wait_ms long, status string")
    assert {x.tenant_id: tuple(x)[1:] for x in aggregates.tenant_load(traces).collect()} == {"t": (1, 1, 6, 8), "u": (0, 1, 0, 0)}


def test_latency_summary(spark):
    t = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 9, 3, 3, 3)] + [("b", None), ("c", 2.0)], "k string, v double")
    got = {x.k: tuple(x)[1:] for x in aggregates.latency_summary(t, "v", "k", seconds=2).collect()}
    assert got == {"a": (7, pytest.approx(25 / 7), 3.0, 9.0, 9.0, 3.5), "b": (0, None, None, None, None, 0.0), "c": (1, 2.0, 2.0, 2.0, 2.0, 0.5)}
    assert aggregates.latency_summary(t, "v").first().p50 == 3.0


def test_graph_reports_truncation(spark):
    r = records(spark, [{"id": k} for k in "abc"] + [{"id": "d", "quality_state": "Suppressed"}])
    assert [tuple(graph.truncated(r, n).first()) for n in (2, 3, None)] == [(4, 2, True), (4, 3, False), (4, 3, False)]


def test_a_scorer_of_ones_own(spark):
    r = records(spark, [{"id": k, "content": k * n} for n, k in enumerate("abc", 1)])
    engine = Engine(custom=lambda q: {"found": F.length("content") > 1, "total": F.length("content").cast("double"), "lexical": F.lit(2.0)})
    rows = recall.recall(r, Query("anything", SCOPE, NOW), engine).orderBy("rank").collect()
    assert [(x.id, x.lexical) for x in rows] == [("c", 2.0), ("b", 2.0)] and rows[0].total == pytest.approx(3 + 0.12 + 0.03 + 0.06)


def test_batches_have_one_result_whatever_their_blocks(spark, monkeypatch):
    r = records(spark, [{"id": "r1", "content": "alpha beta", "importance_score": None}, {"id": "r2", "content": "alpha", "importance_score": 0.5}, {"id": "r3", "content": None}])
    q = spark.createDataFrame([(f"q{i}", t, "t", "n") for i, t in enumerate(["alpha beta", "beta", None, "", "alpha alpha", "gamma"])], "query_id string, query_text string, tenant_id string, namespace string")
    rows = lambda: sorted((x.query_id, x.id, x.total, x.rank) for x in recall.recall_batch(r, q, 2).collect())
    whole = rows()
    assert whole == [("q0", "r1", 2.0, 1), ("q0", "r2", 1.5, 2), ("q1", "r1", 1.0, 1), ("q4", "r1", 2.0, 2), ("q4", "r2", 2.5, 1)]
    monkeypatch.setattr(recall, "BLOCK", 2)
    assert rows() == whole


def test_white_space_is_the_same_on_both_sides(spark):
    t = "a\x1cb \x85c\u2003d\u3000e\tf"
    both = spark.createDataFrame([(t,)], "t string").select(text.tokens(F.col("t")).alias("x")).first().x
    assert both == text.query_terms(t) == ["a\x1cb", "c", "d", "e", "f"]
    assert Query(" \u2003", SCOPE, NOW).blank and not Query("\x1c", SCOPE, NOW).blank


def test_synthesis_guards(spark):
    with pytest.raises(ValueError, match="synthesis"):
        maintenance.synthesis_groups(records(spark, [{"id": "x"}]), "t", 3, 2)


def test_metrics(spark):
    ranking = spark.createDataFrame([("c1", "a", 1), ("c1", "b", 2), ("c2", "x", 1), ("c2", "y", 4)], "case_id string, record_id string, rank int")
    relevant = spark.createDataFrame([("c1", "b"), ("c1", "z"), ("c2", "y")], "case_id string, record_id string")
    cases = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "case_id string")
    row = evaluate.ranking_metrics(ranking, relevant, cases, 3).first()
    assert (row.hit_at_k, row.recall_at_k, row.mrr, row.cases) == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(0.5 / 3, abs=1e-6), pytest.approx(0.25), 3)


def test_text(spark):
    row = spark.createDataFrame([("\n a b  C ", "x" * 200)], "t string, s string").select(text.approximate_tokens(F.col("t"), F.lit(None)), text.snippet(F.col("s")), text.trimmed(F.col("t")), text.ascii_lower(F.lit("ÀB"))).first()
    assert (row[0], row[1], row[2], row[3]) == (3, "x" * 160 + "...", "a b  C", "Àb")


def keyed(df):
    return df.withColumn("idempotency_key", F.concat(F.lit("k"), "id"))


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    batch = keyed(records(spark, [{"id": "a", "updated_at_unix_ms": 100}, {"id": "b", "updated_at_unix_ms": 100}]))
    assert {r.id: r.deduplicated for r in s.upsert(batch, NOW).collect()} == {"a": False, "b": False}
    assert {r.deduplicated for r in s.upsert(batch, NOW).collect()} == {True}
    with pytest.raises(Conflict):
        s.upsert(batch.filter("id = 'a'").withColumn("id", F.lit("z")), NOW)
    with pytest.raises(Invalid):
        s.upsert(batch.withColumn("content", F.lit(" ")), NOW)
    s.upsert(batch.filter("id = 'a'").withColumns({"content": F.lit("v2"), "updated_at_unix_ms": F.lit(200), "idempotency_key": F.lit("k2")}), NOW)
    assert [s.as_of(t).filter("id = 'a'").first().content for t in (150, 250)] == ["text a", "v2"]
    assert ids(s.recall_as_of(Query("text", SCOPE, NOW), 150), "rank") == ["a", "b"] and ids(s.recall_as_of(Query("v2", SCOPE, NOW), 250)) == ["a"] and ids(s.recall(Query("v2", SCOPE, NOW))) == ["a"]
    assert s.delete("b", "t", "n", "why", NOW, hard=True)["hard"] and not s.delete("b", "t", "n", "why", NOW)["deleted"]
    assert sorted(ids(s.as_of(NOW))) == ["a"] and sorted(ids(s.as_of(150))) == ["a", "b"]
    with pytest.raises(Invalid, match="not in this scope"):
        s.archive("a", "t", "other", "why", NOW)
    with pytest.raises(NotFound):
        s.archive("zz", "t", "n", "why", NOW)
    events = s.changefeed().orderBy("sequence").collect()
    assert [(e.sequence, e.kind, e.summary, e.record and e.record.content) for e in events] == [(1, "Upserted", "record inserted", "text a"), (2, "Upserted", "record inserted", "text b"), (3, "Upserted", "record replaced", "v2"), (4, "Deleted", "record hard deleted", None)]
    page, more = lifecycle.changefeed_page(s.changefeed(), 1, limit=2)
    assert [e.sequence for e in page.collect()] == [2, 3] and more.first().truncated
    s.export(str(tmp_path / "p"))
    t = Store(spark, str(tmp_path / "t"))
    assert t.import_package(str(tmp_path / "p"), "Validate")["valid"] and t.head() == 0
    assert t.import_package(str(tmp_path / "p"))["applied"] and ids(t.records()) == ["a"]
    assert tuple(s.snapshot().first())[:2] == ("n", 1) and s.snapshot().first().storage_bytes == s.storage_bytes()

    # tailing the feed in small batches equals one read
    query = streaming.tail_changefeed(spark, f"{s.path}/changefeed", s.changefeed().schema, 1, max_files=1).writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.sequence for r in spark.table("feed").collect()) == [2, 3, 4]


def test_store_time_travel_sees_retention_replacing_and_clearing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), maintenance.Retention(archive_after_days=5, max_records_per_namespace=0))
    day = 86_400_000
    s.upsert(keyed(records(spark, [{"id": "gone", "expires_at_unix_ms": NOW + 5, "updated_at_unix_ms": 10}, {"id": "old", "created_at_unix_ms": NOW, "updated_at_unix_ms": 10}, {"id": "far", "namespace": "m", "updated_at_unix_ms": 10}])), NOW)
    assert sorted(ids(s.as_of(20))) == ["far", "gone", "old"]
    s.upsert(keyed(records(spark, [{"id": "x", "created_at_unix_ms": NOW + 6 * day, "updated_at_unix_ms": NOW + 6 * day}])), NOW + 6 * day)
    now = {r.id: r.quality_state for r in s.records().collect()}
    assert now == {"old": "Archived", "x": "Active", "far": "Active"}  # far's namespace is not the batch's
    assert {r.id: r.quality_state for r in s.as_of(NOW + 6 * day).collect()} == now and {r.id: r.quality_state for r in s.as_of(NOW + 1).collect()} == {"gone": "Active", "old": "Active", "far": "Active"}
    assert s.mapping().filter("record_id = 'gone'").isEmpty() and s.mapping().count() == 3
    kinds = sorted((e.kind, e.record_id) for e in s.changefeed().collect())
    assert ("RetentionDeleted", "gone") in kinds and ("RetentionArchived", "old") in kinds and len(kinds) == 6
    assert ids(s.get("far", "t", "m")) == ["far"] and ids(s.get("far", "t", "n")) == []

    other = Store(spark, str(tmp_path / "o"))
    other.upsert(keyed(records(spark, [{"id": "new"}, {"id": "old"}])), NOW)
    assert other.ship(s, str(tmp_path / "ship"), now_ms=NOW + 7 * day)["applied"]
    assert sorted(ids(s.records())) == sorted(ids(s.as_of(NOW + 7 * day))) == ["new", "old"] and sorted(ids(s.as_of(NOW + 6 * day))) == ["far", "old", "x"]
    assert s.clear("why", NOW + 8 * day) == 2 and ids(s.records()) == ids(s.as_of(NOW + 8 * day)) == [] and s.mapping().isEmpty()


def test_versions_of_one_millisecond(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for v in ("one", "two", "three"):
        s.upsert(records(spark, [{"id": "a", "content": v, "updated_at_unix_ms": 100}]).withColumn("idempotency_key", F.lit(v)), NOW)
    assert [r.content for r in s.as_of(100).collect()] == ["three"]
    v = spark.createDataFrame([("a", 5, ("x",)), ("a", 5, None), ("b", 5, ("y",)), ("b", 5, ("z",))], "record_id string, observed_at_ms long, record struct<content: string>")
    assert {r.content for r in lifecycle.as_of(v, 5).collect()} <= {"y", "z"} and [r.record_id for r in lifecycle.tombstones(v).collect()] == ["a"]
    assert lifecycle.as_of(v.repartition(5), 5).collect() == lifecycle.as_of(v.coalesce(1), 5).collect()


def test_a_writer_that_loses_leaves_nothing_to_read(spark, tmp_path):
    s, late = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    s.upsert(keyed(records(spark, [{"id": "a"}])), NOW)
    head = late.manifest()
    s.upsert(keyed(records(spark, [{"id": "b"}])), NOW)
    late.manifest = lambda: head  # it has prepared the same number
    with pytest.raises(Exception, match="(?i)exist"):
        late.upsert(keyed(records(spark, [{"id": "c"}])), NOW)
    assert sorted(ids(s.records())) == ["a", "b"] and sorted(e.record_id for e in s.changefeed().collect()) == ["a", "b"] and sorted(ids(s.as_of(NOW))) == ["a", "b"]
    s.upsert(keyed(records(spark, [{"id": "d"}])), NOW)
    assert [e.sequence for e in s.changefeed().orderBy("sequence").collect()] == [1, 2, 3]


def test_commits_write_only_what_they_touch(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.upsert(keyed(records(spark, [{"id": "a"}, {"id": "b", "namespace": "m/ö"}])), NOW)
    before = s.manifest()["records"]
    s.archive("b", "t", "m/ö", "why", NOW + 1)
    after = s.manifest()["records"]
    assert len(after) == 2 and sum(after[k] != before[k] for k in after) == 1
    assert {r.id: r.quality_state for r in s.records().collect()} == {"a": "Active", "b": "Archived"}
    moved = keyed(records(spark, [{"id": "a", "namespace": "m/ö"}])).withColumn("idempotency_key", F.lit("again"))
    s.upsert(moved, NOW + 2)
    assert {r.id: r.namespace for r in s.records().collect()} == {"a": "m/ö", "b": "m/ö"} and len(s.manifest()["records"]) == 1


def test_schedule(spark, tmp_path):
    s, slept = Store(spark, str(tmp_path / "s")), []
    s.upsert(keyed(records(spark, [{"id": "a"}])), NOW)
    reports = s.run_schedule("why", 60, runs=2, sleep=slept.append, clock=lambda: NOW / 1000, tenant_id="t")
    assert slept == [60] and [r["integrity_after"]["healthy"] for r in reports] == [True, True]
    assert "error" in s.run_schedule("", runs=1, sleep=slept.append, dry_run=False, tenant_id=5)[0]


def test_numbering_by_ranges(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).cast("string").alias("id")).repartition(6)
    got = numbered(rows, ["id"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r._n)] == sorted(str(i) for i in range(500)) and {r._n for r in got} == set(range(1, 501))


def test_streaming_windows_equal_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 97).alias("ts"), (F.col("id") % 3).alias("k"))
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    query = streaming.tumbling_counts(stream, "ts", "10 minutes", "k").writeStream.outputMode("complete").format("memory").queryName("w").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, streaming.tumbling_counts(rows, "ts", "10 minutes", "k").collect()))


def test_json_round_trip_and_corpus(spark, tmp_path):
    r = records(spark, [{"id": "x", "labels": ["l"]}], {"x": {"episode_id": "e", "causal_record_ids": ["y"]}})
    back = r.select(from_json(to_json()).alias("r")).select("r.*")
    assert back.first() == r.first()
    (tmp_path / "c.json").write_text('{"records": [{"id": "x", "content": "storm runbook", "unknown": 1}, {"id": "y", "content": "other"}], "cases": [{"name": "c", "query_text": "storm", "relevant_record_ids": ["x"], "max_items": 5}]}')
    rows, cases = read_corpus(spark, str(tmp_path / "c.json"))
    rows = rows.withColumns({k: F.lit(v) for k, v in (("tenant_id", "t"), ("namespace", "n"), ("actor_id", "a"), ("quality_state", "Active"), ("source", "s"), ("updated_at_unix_ms", 0), ("importance_score", 0.1))})
    judged = [(c.name, Query(c.query_text, SCOPE, NOW, max_items=c.max_items), c.relevant_record_ids) for c in cases.collect()]
    row = evaluate.run_cases(rows, judged, 3).first()
    assert (row.hit_at_k, row.mrr, row.ndcg_at_k) == (1.0, 1.0, 1.0)


def test_limits_and_traces(spark):
    limits = requests.Limits()
    with pytest.raises(ValueError, match="max_items"):
        limits.check(Query("q", SCOPE, NOW, max_items=65))
    assert records(spark, [{"id": "x", "content": "y" * 40000}]).select(limits.violations()).first()[0] == ["content"]
    traces = spark.createDataFrame([("a", None, "recall", "Ok", "t", "n", 5, 1.0), ("b", None, "recall", "Error", "t", "n", 6, 1.0)], requests.TRACES)
    assert [r.trace_id for r in requests.list_traces(traces, tenant_id="t", before_ms=5).collect()] == ["a"]


def test_maintenance_run(spark, tmp_path):
    s = Store(spark, str(tmp_path / "m"))
    s.upsert(records(spark, [{"id": "a", "content": "same"}, {"id": "b", "content": "same"}]).withColumn("idempotency_key", F.col("id")), NOW)
    dry = s.run_maintenance("why", NOW + 1, tenant_id="t")
    assert dry["compaction"]["superseded_records"] == 1 and dry["integrity_before"] == dry["integrity_after"]
    done = s.run_maintenance("why", NOW + 1, tenant_id="t", dry_run=False)
    assert not done["integrity_before"]["healthy"] and done["integrity_after"]["healthy"] and s.storage_bytes() > 0
