"""Registered queries: every operator family over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import streaming
from ..functions import embedding, text
from ..operators import aggregates, evaluate, filters, graph, lifecycle, maintenance, recall, scoring
from ..operators.filters import RecallFilters, Scope
from ..operators.requests import Limits, list_traces
from ..operators.scoring import Engine, Query
from ..sources.records import BASE_MS, HOUR_MS, SCHEMA, chat_records, document_records, event_records, violations
from ..sources.store import import_plan
from .oracle import ORACLE

NOW_MS = BASE_MS + 60 * HOUR_MS
SCOPE = Scope("acme", "chat", "u3", source="user")
TEXT = "the answer user que"


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def joined(c: str | Column, sep: str = ",") -> Column:
    return F.array_join(c, sep)


def _top(**q):
    engine = Engine(**{k: q.pop(k) for k in list(q) if k in ("scorer", "scoring")})
    query = Query(q.pop("text", TEXT), SCOPE, NOW_MS, **q)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return recall.recall(chat_records(spark, sf_dir), query, engine).select("id", "rank", *r6("total"))

    return run


def _parts(engine: Engine, names: list[str], words: str = TEXT):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = recall.candidates(chat_records(spark, sf_dir), Query(words, SCOPE, NOW_MS), engine).filter("planner_stage = 'CandidateGeneration'")
        return found.select("id", *[F.round(F.col("metadata_score" if n == "metadata" else n).cast("double"), 6).alias(n) for n in names])

    return run


def _ids(f: RecallFilters, scope: Scope | None = SCOPE):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = chat_records(spark, sf_dir)
        if scope is None:
            return records.filter(filters.not_expired(NOW_MS) & filters.passes(f)).select("id")
        return filters.filtered(records, scope, f, NOW_MS).select("id")

    return run


def _modes(modes: dict[str, RecallFilters]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = chat_records(spark, sf_dir).filter(filters.not_expired(NOW_MS))
        tags = F.array_compact(F.array(*[F.when(filters.passes(f), m) for m, f in modes.items()]))
        return records.select("id", F.explode(tags).alias("mode"))

    return run


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(p).alias("profile"), F.round(scoring.provenance("user", "CurrentOnly", p, "FastPath"), 6).alias("delta")) for p in scoring.POLICIES])
    return chat_records(spark, sf_dir).select("id", F.explode(each).alias("x")).select("id", "x.profile", "x.delta")


def _provenance_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a query for history, under continuity-aware planning."""
    each = F.array(*[F.struct(F.lit(p).alias("profile"), F.round(scoring.provenance("user", "HistoricalOnly", p, "ContinuityAware"), 6).alias("delta")) for p in scoring.POLICIES])
    return chat_records(spark, sf_dir).select("id", F.explode(each).alias("x")).select("id", "x.profile", "x.delta")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text, whole, as a query."""
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return queries.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text"), F.lit("acme").alias("tenant_id"), F.lit("en").alias("namespace"))


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall_batch(document_records(spark, sf_dir), _benchmark(spark, sf_dir), 5).select("query_id", "id", *r6("total"), "rank")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as cases: documents that hold the text are relevant. The texts are a stated query set, broadcast in blocks of a checked size."""
    queries, docs = _benchmark(spark, sf_dir), document_records(spark, sf_dir)
    blocks = -(-queries.count() // QUERY_BLOCK)
    block = lambda b: F.broadcast(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "query_text"))
    hits = [docs.select(F.col("id").alias("record_id"), "content").join(block(b), F.contains("content", "query_text")).select("query_id", "record_id") for b in range(blocks)]
    relevant = reduce(DataFrame.unionByName, hits, spark.createDataFrame([], "query_id string, record_id string"))
    return evaluate.run_batch(docs, queries, relevant, 3)


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    unresolved = Query("the user", SCOPE, NOW_MS, max_items=5, filters=RecallFilters(continuity_states=("Open", "Abandoned"), min_importance=0.2))
    other = Query("la der", Scope("acme", "chat", "u5", source="assistant"), NOW_MS, max_items=4, temporal_order="ChronologicalDesc")
    rows = recall.recall_many(chat_records(spark, sf_dir), [("unresolved", unresolved), ("other", other)], Engine(scoring="LexicalFirst"))
    return rows.select("query_id", "id", "rank", *r6("total"))


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall(chat_records(spark, sf_dir), Query(TEXT, SCOPE, NOW_MS, max_items=8, token_budget=400)).select("id", "rank")


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = recall.trace(chat_records(spark, sf_dir), Query(TEXT, SCOPE, NOW_MS, max_items=5))
    return t.select("record_id", "selected", "selection_rank", joined("filter_reasons").alias("filter_reasons"), "decision_reason", joined("matched_terms").alias("matched_terms"), joined("selected_channels").alias("selected_channels"))


def _graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inspected_edges(graph.inspected_nodes(chat_records(spark, sf_dir))).withColumn("details", joined("details", ";"))


def _scoped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.inspected_nodes(chat_records(spark, sf_dir), tenant_id="acme", namespace="chat", actor_id="u3", session_id="s1", archived=True)
    return graph.inspected_edges(nodes).withColumn("details", joined("details", ";"))


def _graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inspected_nodes(chat_records(spark, sf_dir), max_nodes=50).select("id", "kind", text.per_mille(F.col("importance_score")).alias("importance_per_mille"))


def _expand(hops: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = chat_records(spark, sf_dir).filter("historical_state = 'Current'")
        seeds = kept.filter(F.col("conversation_id").isin("c3", "c13") & (F.col("episode.salience.reuse_count") == 0))
        return graph.expand(kept, seeds, hops).select("id", *r6("graph"), "hop", joined("relation_reasons").alias("relation_reasons"))

    return run


def _chat_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_records(spark, sf_dir).unionByName(document_records(spark, sf_dir))


def _shared_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one actor's, so that copies from several sources are duplicates."""
    return document_records(spark, sf_dir).withColumn("actor_id", F.lit("shared"))


def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat_records(spark, sf_dir).withColumn("idempotency_key", F.concat(F.lit("k-"), "id"))
    turn = F.regexp_extract("id", r"-(\d+)$", 1).cast("int")
    key = F.when(turn % 3 == 0, F.concat(F.lit("old-"), "id")).otherwise(aggregates.idempotency_key())
    return aggregates.integrity_summary(records, records.select(key.alias("scoped_key"), F.col("id").alias("record_id")))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.compaction_plan(_shared_docs(spark, sf_dir), "acme").select("id", "first_id", "members", "superseded")


def _compaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.compaction_counts(_shared_docs(spark, sf_dir), "acme", NOW_MS, summarize_after=3, cold_after_days=1)


def _rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maintenance.rollups(_shared_docs(spark, sf_dir), "acme", NOW_MS, summarize_after=3)
    facts = [joined("labels").alias("labels"), "kind", "quality_state", F.col("metadata")["representative_record_id"].alias("representative"), F.col("metadata")["compaction_cluster_size"].alias("cluster_size")]
    return rows.select("id", F.size("lineage").cast("long").alias("members"), *r6("importance_score"), joined(F.col("lineage.record_id")).alias("lineage"), "content", "summary", *facts)


def _synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maintenance.synthesis_proposals(chat_records(spark, sf_dir), "acme", "review", NOW_MS, 2, 3, max_proposals=200)
    return rows.select("id", joined("source_record_ids").alias("source_record_ids"), "confidence", *r6("importance_score"), "content", joined("labels").alias("labels"), "quality_state", "trust_level", F.col("metadata")["synthesis_source_count"].alias("source_count"))


def _synthesis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat_records(spark, sf_dir)
    scanned = records.agg(F.count("*").alias("scanned"), F.count_if(filters.synthesizable("acme")).alias("eligible"))
    taken = maintenance.synthesis_groups(records, "acme", 2, 3).agg(F.count_if(F.col("place") == 1).alias("proposed"), F.count("*").alias("lineage_links"))
    return scanned.join(F.broadcast(taken))  # one row each


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_records(spark, sf_dir)
    n = F.substring("id", 5, 20).cast("long")
    record = lambda **new: F.struct(*[new.get(c, F.col(c)).alias(c) for c in SCHEMA])
    later = (F.col("updated_at_unix_ms") + HOUR_MS).alias("observed_at_ms")
    first = docs.select(F.col("id").alias("record_id"), F.col("updated_at_unix_ms").alias("observed_at_ms"), record().alias("record"))
    second = docs.filter(n % 7 == 0).select(F.col("id").alias("record_id"), later, record(content=F.concat(F.lit("v2 "), n), quality_state=F.lit("Active")).alias("record"))
    gone = docs.filter(n % 11 == 0).select(F.col("id").alias("record_id"), (F.col("updated_at_unix_ms") + 2 * HOUR_MS).alias("observed_at_ms"), F.lit(None).cast(second.schema["record"].dataType).alias("record"))
    return first.unionByName(second).unionByName(gone)


#: Some hours in, when some records have their second version and some are gone.
AS_OF_MS = BASE_MS + 5 * HOUR_MS


def _as_of_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query("the v2 of", Scope("acme", "en", "src1", source="src1"), NOW_MS, max_items=20)
    return recall.recall(lifecycle.as_of(_versions(spark, sf_dir), AS_OF_MS), q).select("id", "rank", *r6("lexical", "total"))


def _page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    feed = e.select((F.col("event_id") + 1).alias("sequence"), F.lit("Upserted").alias("kind"), F.concat(F.lit("evt-"), "event_id").alias("record_id"), F.lit("acme").alias("tenant_id"), F.lit("events").alias("namespace"))
    return lifecycle.changefeed_page(feed, 50, "acme")


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_records(spark, sf_dir)
    return import_plan(docs, docs.filter(F.substring("id", 5, 20).cast("long") % 3 == 0)).select("id")


#: Queries of one block, whose texts or vectors are broadcast.
QUERY_BLOCK = 20_000


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th vector against all, in blocks of queries that are broadcast; norms are worked out once a vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(total(F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))))
    rows = rows.select("vec_id", "embedding", "label", norm.alias("norm"))
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("qn"), F.col("label").alias("query_label"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dot = total(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")))
    pairs = [rows.join(F.broadcast(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)), F.col("query_id") != F.col("vec_id")) for b in range(blocks)]
    return reduce(DataFrame.unionByName, pairs).select("query_id", "vec_id", "query_label", "label", F.round(dot / (F.col("norm") * F.col("qn")), 6).alias("similarity"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """A query's first k; what a task sends is k rows a query (a limited rank is worked out before the exchange)."""
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_nearest(spark, sf_dir), 10).select("query_id", "vec_id", "similarity", "rank")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's own label is relevant. The whole ranking counts in MRR only by the rank of its first hit, which is a count of the pairs before it."""
    pairs = _nearest(spark, sf_dir)
    same = F.col("label") == F.col("query_label")
    place = F.struct((-F.col("similarity")).alias("s"), F.col("vec_id").alias("v"))
    hit = pairs.filter(same).groupBy("query_id").agg(F.min(place).alias("hit"), F.count("*").alias("relevant"))
    first = pairs.join(hit, "query_id").groupBy("query_id", "hit").agg((F.count_if(place < F.col("hit")) + 1).alias("rank")).select(F.col("query_id").alias("case_id"), F.col("hit.v").alias("record_id"), "rank")
    top = _best(pairs, 10).select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("record_id"), "rank")
    ranking = top.unionByName(first.filter("rank > 10").select("case_id", "record_id", F.col("rank").cast("int").alias("rank")))
    relevant = pairs.filter(same).select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("record_id"))
    return evaluate.ranking_metrics(ranking, relevant, pairs.select(F.col("query_id").alias("case_id")).distinct(), 10)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").cast("string").alias("case_id")).agg(F.collect_set("role").alias("ranked"))
    roles = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    said = F.when(F.array_contains("ranked", "assistant"), roles("scorer=Profile", "planning_profile=FastPath")).otherwise(roles())
    rows = evaluate.case_results(c.withColumns({"expected": roles("user"), "optional": roles("assistant"), "disallowed": roles("system"), "required_notes": roles("scorer="), "notes": said}))
    return rows.select("case_id", "passed", *[joined(F.array_sort(x)).alias(x) for x in ("missing_expected", "found_disallowed", "missing_notes", "relevant")])


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.approximate_tokens(t, F.lit(None)).alias("approximate_tokens"), F.octet_length(t).cast("long").alias("bytes"), text.snippet(t).alias("snippet"), text.ascii_lower(text.trimmed(t)).alias("lowered"))


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by every rule that they break: with their own columns, some of which have an actor, an importance or a namespace planted by their id."""
    kind = F.substring("id", 5, 20).cast("long") % 5
    planted = {"actor_id": F.when(kind == 1, " ").otherwise(F.col("actor_id")), "importance_score": F.when(kind == 2, 1.5).otherwise(F.col("importance_score")), "namespace": F.when(kind == 4, "").otherwise(F.col("namespace"))}
    broken = document_records(spark, sf_dir).withColumns(planted).select(F.explode(violations()).alias("rule"))
    return broken.groupBy("rule").agg(F.count("*").alias("n"))


def _over_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = _chat_docs(spark, sf_dir).select("id", F.explode(Limits(labels=1, content_bytes=8 * 1024).violations()).alias("rule"))
    return over.groupBy("rule").agg(F.count("*").alias("n"))


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chat records with keys, and a mapping of which every third entry is out of date, every seventh malformed and every fifth missing."""
    records = chat_records(spark, sf_dir).withColumn("idempotency_key", F.concat(F.lit("k-"), "id"))
    turn, conv = F.regexp_extract("id", r"-(\d+)$", 1).cast("int"), F.regexp_extract("id", r"-(\d+)-", 1).cast("long")
    key = F.when(conv % 7 == 0, F.lit("no parts")).when(turn % 3 == 0, F.concat(aggregates.idempotency_key(), F.lit("-old"))).otherwise(aggregates.idempotency_key())
    return records, records.filter(conv % 5 != 0).select(key.alias("scoped_key"), F.col("id").alias("record_id"))


def _parsed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = aggregates.parse_idempotency(_keyed(spark, sf_dir)[1])
    return parts.select("record_id", "well_formed", "tenant_id", "namespace", "actor_id", "conversation_id", "session_id", "key")


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, mapping = _keyed(spark, sf_dir)
    return maintenance.repair_mappings(mapping, records, "why").select("record_id", F.replace("scoped_key", F.lit("\u001f"), F.lit("|")).alias("scoped_key"))


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = maintenance.Retention(ttl_days=4, archive_after_days=3, max_records_per_namespace=0)
    return maintenance.apply_retention(chat_records(spark, sf_dir), policy, NOW_MS).select("id", "quality_state", "historical_state", "updated_at_unix_ms")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query("what led to the answer", SCOPE, NOW_MS, filters=RecallFilters(unresolved_only=True))
    return aggregates.planner_metrics(recall.candidates(chat_records(spark, sf_dir), q, Engine(max_hops=2)))


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    traces = e.select(F.concat(F.lit("u"), F.col("user_id") % 7).alias("tenant_id"), F.when(F.col("event_id") % 9 != 0, F.floor("value").cast("long")).alias("queue_wait_ms"), F.when(F.col("event_id") % 4 != 0, "Ok").alias("status"))
    return aggregates.tenant_load(traces)


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.latency_summary(_events(spark, sf_dir), "value", "event_type", seconds=3600)
    return rows.select("event_type", "samples", *r6("mean"), "p50", "p95", "max", *r6("throughput_per_sec"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.concat(F.lit("t"), "event_id").alias("trace_id"), F.lit(None).cast("string").alias("correlation_id"), F.lit("recall").alias("operation"), F.when(F.col("event_type") == "error", "Error").otherwise("Ok").alias("status"), F.lit("acme").alias("tenant_id"), F.lit("events").alias("namespace"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_at_unix_ms"), F.col("value").alias("duration_ms"))
    return list_traces(rows, "acme", operation="recall", status="Error", before_ms=BASE_MS + 200 * HOUR_MS, limit=50).select("trace_id", "started_at_unix_ms")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


def _minute(c: str, form: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(c, form).alias(c)


def _embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(embedding.hash_embedding(F.col("text"))).alias("k", "v"))
    return rows.select("item_id", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


def _embedded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text against the one before it."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", embedding.hash_embedding(F.col("text"), 16).alias("v"))
    before = rows.select((F.col("item_id") + 1).alias("item_id"), F.col("v").alias("w"))
    return rows.join(before, "item_id").select("item_id", F.round(embedding.cosine("v", "w"), 6).alias("likeness"))


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(embedder=embedding.hash_embedding, provider_note="deterministic_local")
    return recall.candidates(chat_records(spark, sf_dir), Query(TEXT, SCOPE, NOW_MS), engine).filter("lexical > 0").select("id", *r6("semantic", "total"))


def _continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query("what led to the answer", SCOPE, NOW_MS, max_items=20, filters=RecallFilters(unresolved_only=True))
    return recall.recall(chat_records(spark, sf_dir), q, Engine(max_hops=2)).select("id", "rank", "planner_stage", joined("candidate_sources").alias("candidate_sources"), joined("relation_reasons").alias("relation_reasons"), *r6("graph", "total"))


def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = recall.explain(chat_records(spark, sf_dir), Query(TEXT, SCOPE, NOW_MS, token_budget=400))
    return row.select("total_candidates_examined", joined("selected_channels").alias("selected_channels"), joined("policy_notes").alias("policy_notes"))


def _retention(policy: maintenance.Retention, source):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return maintenance.retention_plan(source(spark, sf_dir), policy, NOW_MS).select("id", "action")

    return run


QUERIES = {
    "recall_relevance": _top(), "recall_lexical_first": _top(scoring="LexicalFirst"), "recall_importance_first": _top(scoring="ImportanceFirst"), "recall_curated": _top(scorer="Curated"),
    "recall_empty_recent": _top(text=" "), "recall_chrono_asc": _top(temporal_order="ChronologicalAsc"), "recall_chrono_desc": _top(temporal_order="ChronologicalDesc"),
    "score_breakdown": _parts(Engine(), ["lexical", "temporal", "metadata", "episodic", "salience", "policy", "total"]),
    "score_curated_breakdown": _parts(Engine(scorer="Curated"), ["lexical", "temporal", "metadata", "episodic", "salience", "curation", "policy", "total"]),
    "score_temporal_context": _parts(Engine(), ["temporal", "total"], "the timeline recurring handoff"),
    "score_duration_context": _parts(Engine(), ["temporal", "episodic", "total"], "how long after the session what happened next what changed"), "score_provenance_asked": _provenance_asked,
    "score_salience": lambda s, d: chat_records(s, d).select("id", F.round(scoring.salience(), 6).alias("salience")),
    "score_provenance_5_profiles": _provenance, "recall_batched_benchmark": _batched, "recall_many_filters": _many, "judged_benchmark": _judged, "recall_token_budget": _budget, "recall_trace": _trace, "recall_explanation": _explain, "recall_semantic": _semantic, "recall_continuity_expansion": _continuity,
    "filter_scope": _ids(RecallFilters(), Scope("acme", "chat", "u3", conversation_id="c3")),
    "filter_time_range": _ids(RecallFilters(updated_from_ms=BASE_MS + 10 * HOUR_MS, updated_to_ms=BASE_MS + 50 * HOUR_MS, min_importance=0.4)),
    "filter_labels_all": _ids(RecallFilters(required_labels=("chat", "user"))), "filter_trust_kind": _ids(RecallFilters(trust_levels=("Verified", "Observed"), kinds=("Episodic", "Fact"), source="user")),
    "filter_unresolved": _ids(RecallFilters(unresolved_only=True)), "filter_lineage": _ids(RecallFilters(lineage_record_id="conv-23-0")), "filter_relative_anchor": _ids(RecallFilters(after_record_id="conv-3-0", before_record_id="conv-13-0")),
    "filter_boundary_recurrence": _ids(RecallFilters(boundary_labels=("handoff",), recurrence_key="weekly"), Scope("acme", "chat", "u5")), "filter_conflict": _ids(RecallFilters(conflict_states=("PotentialConflict", "UnderReview", "Resolved")), None),
    "filter_conflict_resolution": _ids(RecallFilters(conflict_resolutions=("Accepted",)), None), "filter_unresolved_conflicts": _ids(RecallFilters(unresolved_conflicts_only=True), None),
    "filter_historical_modes": _modes({"HistoricalOnly": RecallFilters(historical_mode="HistoricalOnly"), "IncludeHistorical": RecallFilters(historical_mode="IncludeHistorical")}),
    "filter_quality_visibility": _modes({"archived": RecallFilters(include_archived=True), "drafts": RecallFilters(states=("Draft",))}), "filter_episode": _ids(RecallFilters(episode_id="c23", continuity_states=("Open", "Abandoned"))),
    "graph_edges": _graph_edges, "graph_edges_scoped": _scoped_edges, "graph_nodes_capped": _graph_nodes, "graph_truncated": lambda s, d: graph.truncated(chat_records(s, d), 50, tenant_id="acme", conversation_id="c3", archived=True), "expand_one_hop": _expand(1), "expand_two_hops": _expand(2),
    "namespace_stats": lambda s, d: aggregates.namespace_stats(_chat_docs(s, d)), "maintenance_stats": lambda s, d: aggregates.maintenance_stats(chat_records(s, d), NOW_MS),
    "duplicate_groups": lambda s, d: aggregates.duplicate_groups(_shared_docs(s, d)).select("namespace", "members", "first_id"), "integrity_summary": _integrity,
    "compaction_plan": _plan, "compaction_counts": _compaction_counts, "compaction_rollups": _rollups, "cold_tier_candidates": lambda s, d: chat_records(s, d).filter(filters.cold(NOW_MS, 1)).select("id"),
    "retention_plan": _retention(maintenance.Retention(ttl_days=2, archive_after_days=1, max_records_per_namespace=0), chat_records), "retention_cap": _retention(maintenance.Retention(max_records_per_namespace=100), lambda s, d: _chat_docs(s, d).filter(filters.not_expired(NOW_MS))),
    "synthesis_proposals": _synthesis, "synthesis_counts": _synthesis_counts, "export_manifest": lambda s, d: aggregates.export_manifest(document_records(s, d)), "snapshot_manifest": lambda s, d: aggregates.snapshot_manifest(_chat_docs(s, d), 12),
    "import_merge_plan": _merge,
    "changefeed_page": lambda s, d: _page(s, d)[0].select("sequence", "record_id"), "changefeed_truncated": lambda s, d: _page(s, d)[1],
    "as_of_snapshot": lambda s, d: lifecycle.as_of(_versions(s, d), AS_OF_MS).select("id", "content", "quality_state"), "version_tombstones": lambda s, d: lifecycle.tombstones(_versions(s, d)), "as_of_recall": _as_of_recall,
    "cosine_topk": _cosine, "ir_metrics": _metrics, "case_assertions": _cases, "hash_embedding": _embed, "hash_embedding_likeness": _embedded_pairs,
    "latency_summary": _latency, "tenant_load": _load, "planner_metrics": _planned, "traces_listed": _traces,
    "event_chains": lambda s, d: event_records(s, d).select("id", F.col("episode.continuity_state").alias("ep_state"), F.col("episode.previous_record_id").alias("prev"), F.col("episode.next_record_id").alias("next"), *r6("importance_score")),
    "events_unresolved": lambda s, d: event_records(s, d).filter(filters.passes(RecallFilters(unresolved_only=True, min_importance=0.1))).select("id"),
    "text_functions": _text, "validation_failures": _validation, "limit_violations": _over_limits, "idempotency_parsed": _parsed_keys, "idempotency_repaired": _repaired, "retention_applied": _retained,
    "lifecycle_suppress": lambda s, d: lifecycle.suppress(chat_records(s, d), NOW_MS).select("id", "quality_state", "historical_state", "updated_at_unix_ms", "changed"),
    "lifecycle_recover": lambda s, d: lifecycle.recover(chat_records(s, d), NOW_MS, "Verified", "Historical").select("id", "quality_state", "historical_state", "updated_at_unix_ms", "changed"),
    "lifecycle_archive": lambda s, d: lifecycle.archive(chat_records(s, d), NOW_MS).select("id", F.lit("Archived").alias("quality_state"), "historical_state", "changed"),
    "tumbling_counts": lambda s, d: streaming.tumbling_counts(_events(s, d), "ts", "1 hour", "event_type").withColumn("window_start", _minute("window_start")),
    "sliding_counts": lambda s, d: streaming.sliding_counts(_events(s, d), "ts", "2 hours", "1 hour", "event_type").withColumn("window_start", _minute("window_start")),
    "sessionized_events": lambda s, d: streaming.sessions(_events(s, d), "ts", "30 minutes", "user_id").withColumn("session_start", _minute("session_start", "yyyy-MM-dd HH:mm:ss")),
    "stream_dedup": lambda s, d: streaming.first_of_each(_events(s, d), "ts", "1 hour", "user_id", "event_type").agg(F.count("*").alias("n")),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
