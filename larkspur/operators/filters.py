"""Recall filters and the other row predicates, as conjunctions of columns that reach the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import LIVE, UNRESOLVED

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Scope:
    tenant_id: str
    namespace: str
    actor_id: str
    conversation_id: str | None = None
    session_id: str | None = None
    source: str = ""


@dataclass(frozen=True)
class RecallFilters:
    """None and empty tuples apply nothing."""

    min_importance: float | None = None
    source: str | None = None
    updated_from_ms: int | None = None
    updated_to_ms: int | None = None
    after_record_id: str | None = None
    before_record_id: str | None = None
    trust_levels: tuple[str, ...] = ()
    required_labels: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    episode_id: str | None = None
    continuity_states: tuple[str, ...] = ()
    unresolved_only: bool = False
    lineage_record_id: str | None = None
    boundary_labels: tuple[str, ...] = ()
    recurrence_key: str | None = None
    conflict_states: tuple[str, ...] = ()
    conflict_resolutions: tuple[str, ...] = ()
    unresolved_conflicts_only: bool = False
    historical_mode: str = "CurrentOnly"
    states: tuple[str, ...] = ()
    include_archived: bool = False


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def sure(c: Column) -> Column:
    """Null is false."""
    return F.coalesce(c, F.lit(False))


def in_scope(s: Scope) -> Column:
    keys = [F.col(k) == getattr(s, k) for k in ("tenant_id", "namespace", "actor_id")]
    keys += [F.col(k) == getattr(s, k) for k in ("conversation_id", "session_id") if getattr(s, k) is not None]
    return every(keys)


def not_expired(now_ms: int) -> Column:
    return F.col("expires_at_unix_ms").isNull() | (F.col("expires_at_unix_ms") > now_ms)


def temporal_anchor() -> Column:
    return F.coalesce("episode.last_active_unix_ms", "episode.started_at_unix_ms", "updated_at_unix_ms")


def passes(f: RecallFilters, after_anchor: int | None = None, before_anchor: int | None = None) -> Column:
    """All filters but scope and expiry. The anchors are those of f's after and before records."""
    c, out = F.col, []
    if f.min_importance is not None:
        out.append(c("importance_score") >= f.min_importance)
    if f.source is not None:
        out.append(c("source") == f.source)
    if f.updated_from_ms is not None:
        out.append(c("updated_at_unix_ms") >= f.updated_from_ms)
    if f.updated_to_ms is not None:
        out.append(c("updated_at_unix_ms") <= f.updated_to_ms)
    if after_anchor is not None:
        out.append(temporal_anchor() > after_anchor)
    if before_anchor is not None:
        out.append(temporal_anchor() < before_anchor)
    if f.required_labels:
        out.append(every([F.array_contains("labels", x) for x in f.required_labels]))
    if f.lineage_record_id is not None:
        out.append((c("id") == f.lineage_record_id) | sure(F.array_contains(c("lineage.record_id"), f.lineage_record_id)))
    lists = {
        "trust_level": f.trust_levels, "kind": f.kinds, "episode.continuity_state": f.continuity_states, "episode.boundary_label": f.boundary_labels,
        "conflict.state": f.conflict_states, "conflict.resolution": f.conflict_resolutions,
    }
    out += [sure(c(k).isin(*v)) for k, v in lists.items() if v]
    if f.episode_id is not None:
        out.append(sure(c("episode.episode_id") == f.episode_id))
    if f.unresolved_only:
        out.append(sure(c("episode.continuity_state").isin(*UNRESOLVED)))
    if f.recurrence_key is not None:
        out.append(sure(c("episode.recurrence_key") == f.recurrence_key))
    if f.unresolved_conflicts_only:
        out.append(sure(c("conflict.state").isin("PotentialConflict", "UnderReview")))
    if f.historical_mode == "CurrentOnly":
        out.append(c("historical_state") == "Current")
    elif f.historical_mode == "HistoricalOnly":
        out.append(c("historical_state") != "Current")
    if f.states:
        out.append(c("quality_state").isin(*f.states))
    else:
        out.append(~c("quality_state").isin("Deleted", "Suppressed", *(() if f.include_archived else ("Archived",))))
    return every(out)


def anchors(records: DataFrame, s: Scope, f: RecallFilters) -> tuple[int | None, int | None]:
    """The anchors of the after and before records: two rows at most, looked up by id in scope; errors as for a bad request."""
    wanted = [x for x in (f.after_record_id, f.before_record_id) if x is not None]
    if not wanted:
        return None, None
    rows = records.filter(in_scope(s) & F.col("id").isin(*wanted)).select("id", temporal_anchor().alias("t")).limit(2).collect()
    have = {r["id"]: r["t"] for r in rows}
    if missing := [x for x in wanted if x not in have]:
        raise ValueError(f"anchor record not in scope: {missing[0]}")
    after, before = have.get(f.after_record_id), have.get(f.before_record_id)
    if after is not None and before is not None and after >= before:
        raise ValueError("after record is not earlier than before record")
    return after, before


def filtered(records: DataFrame, s: Scope, f: RecallFilters, now_ms: int) -> DataFrame:
    after, before = anchors(records, s, f)
    return records.filter(in_scope(s) & not_expired(now_ms) & passes(f, after, before))


def admin_scope(tenant_id: str | None = None, namespace: str | None = None, **more: str | None) -> Column:
    """Optional equality on scope columns."""
    keys = {"tenant_id": tenant_id, "namespace": namespace, **more}
    return every([F.col(k) == v for k, v in keys.items() if v is not None])


def live() -> Column:
    return F.col("quality_state").isin(*LIVE)


def visible_in_graph(archived: bool = False, suppressed: bool = False, deleted: bool = False) -> Column:
    hidden = [s for s, shown in (("Archived", archived), ("Suppressed", suppressed), ("Deleted", deleted)) if not shown]
    return ~F.col("quality_state").isin(*hidden) if hidden else F.lit(True)


def synthesizable(tenant_id: str, from_ms: int | None = None, to_ms: int | None = None, **scope: str | None) -> Column:
    out = [admin_scope(tenant_id, **scope), live(), F.col("kind") != "Summary"]
    out += [F.col("updated_at_unix_ms") >= from_ms] if from_ms is not None else []
    out += [F.col("updated_at_unix_ms") <= to_ms] if to_ms is not None else []
    return every(out)


def cold(now_ms: int, after_days: int, importance_per_mille: int = 250) -> Column:
    """Live, not pinned, older than after_days and of little importance; nothing for 0 days."""
    if after_days <= 0:
        return F.lit(False)
    age = F.lit(now_ms) - F.col("updated_at_unix_ms")
    return live() & (F.col("trust_level") != "Pinned") & (age > after_days * DAY_MS) & (F.col("importance_score") <= importance_per_mille / 1000)
