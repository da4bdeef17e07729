"""Scores of a record for a query, as column expressions in one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import embedding, text
from ..functions.embedding import Embedder
from ..sources.records import UNRESOLVED
from .filters import DAY_MS, RecallFilters, Scope, sure

# Weights (lexical, semantic, policy) of the scoring profiles, by scorer.
WEIGHTS = {
    "Profile": {"Balanced": (1.0, 0.45, 1.0), "LexicalFirst": (1.25, 0.25, 0.35), "ImportanceFirst": (0.75, 0.35, 1.5)},
    "Curated": {"Balanced": (1.0, 0.5, 1.0), "LexicalFirst": (1.15, 0.3, 0.65), "ImportanceFirst": (0.75, 0.4, 1.7)},
}
METADATA_WEIGHT = {"Profile": 0.4, "Curated": 0.45}
FRESH_DAYS = {"Profile": 7, "Curated": 30}
TRUST_CURATION = {"Pinned": 0.45, "Verified": 0.25, "Observed": 0.10, "Derived": 0.05, "Untrusted": -0.10}
QUALITY_CURATION = {"Verified": 0.20, "Active": 0.0, "Draft": -0.05, "Archived": -0.15, "Suppressed": -0.40, "Deleted": -0.50}

# Provenance weights of the policy profiles.
POLICIES = ("General", "Support", "Research", "Assistant", "AutonomousAgent")
PROVENANCE = {
    "source": (0.12, 0.16, 0.04, 0.10, 0.14),
    "trust.Pinned": (0.14, 0.20, 0.10, 0.13, 0.18),
    "trust.Verified": (0.09, 0.13, 0.07, 0.10, 0.12),
    "trust.Observed": (0.03, 0.01, 0.04, 0.03, 0.02),
    "trust.Derived": (0.0, -0.03, 0.03, 0.01, 0.0),
    "trust.Untrusted": (-0.08, -0.14, -0.04, -0.07, -0.10),
    "state.Verified": (0.08, 0.12, 0.05, 0.09, 0.10),
    "state.Active": (0.03, 0.05, 0.02, 0.04, 0.05),
    "state.Draft": (-0.03, -0.06, -0.01, -0.03, -0.04),
    "state.Archived.FastPath": (-0.08, -0.12, -0.02, -0.06, -0.08),
    "state.Archived.ContinuityAware": (-0.02, -0.05, 0.01, -0.01, -0.02),
    "state.Suppressed": (-0.20, -0.28, -0.12, -0.18, -0.24),
    "state.Deleted": (-0.30, -0.40, -0.18, -0.28, -0.36),
    "history.Current": (0.06, 0.09, 0.03, 0.07, 0.08),
    "history.Historical.asked": (0.04, 0.01, 0.08, 0.04, 0.03),
    "history.Historical": (-0.05, -0.09, -0.01, -0.03, -0.06),
    "history.Superseded.asked": (-0.02, -0.05, 0.02, -0.01, -0.03),
    "history.Superseded": (-0.12, -0.16, -0.04, -0.10, -0.14),
}

#: metadata_score, as a record has a metadata map of its own.
PARTS = ("lexical", "semantic", "graph", "temporal", "metadata_score", "episodic", "salience", "curation", "policy", "total")


@dataclass(frozen=True)
class Query:
    text: str
    scope: Scope
    now_ms: int
    max_items: int = 10
    token_budget: int | None = None
    filters: RecallFilters = field(default_factory=RecallFilters)
    temporal_order: str = "Relevance"

    @property
    def blank(self) -> bool:
        return not self.terms

    @property
    def terms(self) -> list[str]:
        return text.query_terms(self.text)


#: A user's own scorer: a query -> columns by name. found says whether the record is a candidate, total is its score; any of PARTS may be there too.
Scorer = Callable[["Query"], dict[str, Column]]


@dataclass(frozen=True)
class Engine:
    """How to score and plan. An embedder maps a text column to a vector column; none disables semantic scores. custom takes the place of the scorers."""

    scorer: str = "Profile"
    scoring: str = "Balanced"
    policy: str = "General"
    planning: str = "FastPath"
    max_hops: int = 1
    embedder: Embedder | None = None
    provider_note: str | None = None
    custom: Scorer | None = None

    def planning_for(self, q: Query) -> str:
        asked = q.filters.episode_id is not None or q.filters.unresolved_only or text.has_intent(q.text, text.CONTINUITY)
        return "ContinuityAware" if self.planning == "ContinuityAware" or asked else "FastPath"


def chosen(c: Column, values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(c == k, float(v)).otherwise(out)
    return out


def clamped(c: Column) -> Column:
    return F.coalesce(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def metadata(terms: list[str], scorer: str) -> Column:
    labels = F.size(F.filter("labels", lambda x: text.any_term(text.ascii_lower(x), terms)))
    source = text.ascii_lower(F.col("source"))
    by_source = text.count_terms(source, terms) * 0.5 if scorer == "Curated" else F.when(text.any_term(source, terms), 0.5).otherwise(0.0)
    return labels + by_source


def context_bonus(q: Query) -> Column:
    """What a query's words about sequence, duration, recurrence and boundaries are worth to an episode."""
    e, out = F.col("episode"), F.lit(0.0)
    if text.has_intent(q.text, text.SEQUENCE):
        linked = e["previous_record_id"].isNotNull() | e["next_record_id"].isNotNull() | (F.size(e["causal_record_ids"]) > 0)
        out = out + F.when(sure(linked), 0.2).otherwise(0.0)
    if text.has_intent(q.text, text.DURATION):
        start, end, last = e["started_at_unix_ms"], e["ended_at_unix_ms"], e["last_active_unix_ms"]
        span = F.when(end >= start, end - start).when(end.isNull() & (last >= start), last - start)
        out = out + F.when(span.isNotNull(), 0.15 + F.least(span / 3_600_000.0, F.lit(24.0)) / 24 * 0.2).otherwise(0.0)
    if text.has_intent(q.text, text.RECURRENCE):
        every = e["recurrence_interval_ms"]
        out = out + F.when(e["recurrence_key"].isNotNull(), 0.2).otherwise(0.0) + F.when(every.isNotNull(), 0.1 + F.least(every / float(DAY_MS), F.lit(30.0)) / 30 * 0.1).otherwise(0.0)
    if text.has_intent(q.text, text.BOUNDARY):
        out = out + F.when(e["boundary_label"].isNotNull(), 0.18).otherwise(0.0) + F.when(F.col("session_id").isNotNull() | F.col("conversation_id").isNotNull(), 0.08).otherwise(0.0)
    return F.when(e.isNull(), 0.0).otherwise(out)


def temporal(q: Query, scorer: str) -> Column:
    window = FRESH_DAYS[scorer] * DAY_MS
    age = F.least(F.greatest(F.lit(q.now_ms) - F.col("updated_at_unix_ms"), F.lit(0)), F.lit(window))
    return 1 - age / float(window) + context_bonus(q)


def episode_haystack() -> Column:
    e = F.col("episode")
    none = lambda c: F.coalesce(c, F.lit(""))
    joined = lambda c: none(F.array_join(c, " "))
    parts = [none(e["summary"]), none(e["goal"]), none(e["outcome"]), joined(e["actor_ids"]), none(e["recurrence_key"]), none(e["boundary_label"]), joined(e["related_record_ids"]), joined(e["linked_artifact_uris"])]
    return text.ascii_lower(F.concat_ws(" ", *parts))


def episodic(q: Query, terms: list[str]) -> Column:
    e, out, low = F.col("episode"), F.lit(0.0), text.ascii_lower_text(q.text)
    if q.filters.episode_id is not None:
        out = out + F.when(e["episode_id"] == q.filters.episode_id, 1.0).otherwise(0.0)
    if q.filters.unresolved_only:
        out = out + F.when(e["continuity_state"].isin(*UNRESOLVED), 0.35).otherwise(0.0)
    if terms:
        out = out + text.count_terms(episode_haystack(), terms) * 0.2
    for phrase, there in (("what changed", e["previous_record_id"].isNotNull()), ("what happened next", e["next_record_id"].isNotNull()), ("what led", F.size(e["causal_record_ids"]) > 0)):
        if phrase in low:
            out = out + F.when(there, 0.25).otherwise(0.0)
    return F.when(e.isNull(), 0.0).otherwise(out)


def salience() -> Column:
    s, a = F.col("episode.salience"), F.col("episode.affective")
    out = F.coalesce(F.least(s["reuse_count"], F.lit(10)), F.lit(0)) / 10 * 0.35 + clamped(s["novelty_score"]) * 0.15 + clamped(s["goal_relevance"]) * 0.35 + clamped(s["unresolved_weight"]) * 0.25
    out = out + clamped(a["urgency"]) * 0.1 + clamped(a["tension"]) * 0.05
    return F.when(F.col("episode").isNull(), 0.0).otherwise(out)


def curation() -> Column:
    return chosen(F.col("trust_level"), TRUST_CURATION) + chosen(F.col("quality_state"), QUALITY_CURATION)


def provenance(source: str, historical_mode: str, policy: str, planning: str) -> Column:
    k = POLICIES.index(policy)
    w = {name: v[k] for name, v in PROVENANCE.items()}
    asked = ".asked" if historical_mode == "HistoricalOnly" else ""
    states = {s: w[f"state.{s}"] for s in ("Verified", "Active", "Draft", "Suppressed", "Deleted")} | {"Archived": w[f"state.Archived.{planning}"]}
    history = {"Current": w["history.Current"], "Historical": w[f"history.Historical{asked}"], "Superseded": w[f"history.Superseded{asked}"]}
    trust = {t: w[f"trust.{t}"] for t in TRUST_CURATION}
    return F.when(F.col("source") == source, w["source"]).otherwise(0.0) + chosen(F.col("trust_level"), trust) + chosen(F.col("quality_state"), states) + chosen(F.col("historical_state"), history)


def seeds(records: DataFrame, q: Query, e: Engine) -> DataFrame:
    """The filtered records that the query's text finds, with every part of their score, matched terms and sources."""
    w_lexical, w_semantic, w_policy = WEIGHTS[e.scorer][e.scoring]
    terms, curated = q.terms, e.scorer == "Curated"
    zero, importance = F.lit(0.0), F.col("importance_score")
    if e.custom is not None:
        own = e.custom(q)
        r = records.filter(own["found"]).withColumn("_delta", provenance(q.scope.source, q.filters.historical_mode, e.policy, e.planning_for(q)))
        part = lambda k: own.get(k, zero).cast("double")
        named = {f"_{k}": part("metadata_score" if k == "metadata" else k) for k in ("lexical", "semantic", "temporal", "metadata", "episodic", "salience", "curation", "policy", "total")}
        return overlaid(r.withColumns(named | {"matched_terms": own.get("matched_terms", F.array().cast("array<string>"))}), q)
    r = records.withColumns({"_salience": salience(), "_episodic": episodic(q, terms), "_curation": curation() if curated else zero, "_delta": provenance(q.scope.source, q.filters.historical_mode, e.policy, e.planning_for(q))})
    policy = F.greatest(zero, importance + F.col("_curation")) if curated else importance
    if q.blank:
        base = 1 + F.col("_episodic") * 0.35 + F.col("_salience") * 0.25 + policy * w_policy
        r = r.withColumns({"_lexical": zero, "_semantic": zero, "_metadata": zero, "_temporal": F.lit(1.0), "_policy": policy, "_total": base, "matched_terms": F.array().cast("array<string>")})
    else:
        hay = text.haystack(F.col("content"), F.col("summary"))
        hay = F.concat(hay, F.lit(" "), text.ascii_lower(F.col("source"))) if curated else hay
        r = r.withColumn("_hay", hay).withColumn("matched_terms", text.matched_terms(F.col("_hay"), terms))
        r = r.withColumns({"_lexical": F.size("matched_terms").cast("double"), "_semantic": embedding.semantic(F.col("_hay"), q.text, e.embedder), "_metadata": metadata(terms, e.scorer).cast("double"), "_temporal": temporal(q, e.scorer), "_policy": policy})
        r = r.filter((F.col("_lexical") > 0) | (F.col("_semantic") > 0)).drop("_hay")
        total = F.col("_lexical") * w_lexical + F.col("_semantic") * w_semantic + F.col("_metadata") * METADATA_WEIGHT[e.scorer] + F.col("_temporal") * 0.2 + F.col("_episodic") * 0.35 + F.col("_salience") * 0.25
        r = r.withColumn("_total", total + F.col("_curation") * 0.5 + F.col("_policy") * w_policy if curated else total + F.col("_policy") * w_policy)
    return overlaid(r, q)


def overlaid(r: DataFrame, q: Query) -> DataFrame:
    """A scorer's rows with what provenance adds, and where each was found."""
    zero = F.lit(0.0)
    shifted = F.when(F.col("_delta") != 0, F.greatest(zero, F.col("_policy") + F.col("_delta"))).otherwise(F.col("_policy"))
    sources = [("Lexical", F.size("matched_terms") > 0), ("Semantic", F.col("_semantic") > 0), ("Metadata", F.col("_metadata") > 0), ("Episode", F.col("_episodic") > 0), ("Temporal", F.lit(True) if q.blank else F.col("_temporal") > 0), ("Provenance", F.col("_delta") != 0)]
    parts = {"lexical": "_lexical", "semantic": "_semantic", "temporal": "_temporal", "metadata_score": "_metadata", "episodic": "_episodic", "salience": "_salience", "curation": "_curation"}
    out = r.withColumns({k: F.col(v) for k, v in parts.items()} | {"graph": zero, "policy": shifted, "total": F.col("_total") + F.col("_delta"), "candidate_sources": F.array_compact(F.array(*[F.when(c, n) for n, c in sources]))})
    out = out.withColumns({"planner_stage": F.lit("CandidateGeneration"), "relation_reasons": F.array().cast("array<string>")})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def contextual(expanded: DataFrame, q: Query, e: Engine) -> DataFrame:
    """Scores of records that only the graph found; expanded has graph and relation_reasons."""
    zero = F.lit(0.0)
    delta = provenance(q.scope.source, q.filters.historical_mode, e.policy, e.planning_for(q))
    r = expanded.withColumns({"temporal": temporal(q, e.scorer), "episodic": episodic(q, q.terms), "salience": salience(), "curation": curation() if e.scorer == "Curated" else zero, "_delta": delta})
    r = r.withColumns({"lexical": zero, "semantic": zero, "metadata_score": zero, "policy": F.greatest(zero, F.col("importance_score") + F.col("_delta")), "matched_terms": F.array().cast("array<string>"), "planner_stage": F.lit("GraphExpansion")})
    r = r.withColumn("total", F.col("graph") + F.col("temporal") * 0.15 + F.col("episodic") * 0.35 + F.col("salience") * 0.25 + F.col("curation") * 0.25 + F.col("policy") * 0.5)
    sources = [("Episode", F.col("episodic") > 0), ("Graph", F.lit(True)), ("Temporal", F.col("temporal") > 0), ("Provenance", F.col("_delta") != 0)]
    return r.withColumn("candidate_sources", F.array_compact(F.array(*[F.when(c, n) for n, c in sources]))).drop("_delta")
