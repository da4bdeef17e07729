"""Retention, compaction, cold tiering, synthesis, repair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet, trimmed
from ..sources.records import LINEAGE, conform
from .aggregates import SIGNATURE, missing_mappings, stale_mappings, with_signature
from .filters import DAY_MS, admin_scope, cold, live, synthesizable


@dataclass(frozen=True)
class Retention:
    """0 days turns a rule off."""

    ttl_days: int = 0
    archive_after_days: int = 0
    max_records_per_namespace: int = 5000
    pinned_exempt: bool = True


def age(now_ms: int, since: str) -> Column:
    return F.greatest(F.lit(now_ms) - F.col(since), F.lit(0))


#: Salts in which the newest rows of a namespace are found.
SALTS = 64


def retention_plan(records: DataFrame, policy: Retention, now_ms: int) -> DataFrame:
    """id, tenant_id, namespace and action (delete, archive, archive_over_cap) of records that a rule touches; the cap archives the oldest beyond it.

    Ages count from created_at; the cap goes by (updated_at, importance, id). It needs only the last row that stays of a
    namespace: narrow rows are ranked in salts first, so a task sees SALTS times the cap of them at most.
    """
    spared = (F.col("trust_level") == "Pinned") & F.lit(policy.pinned_exempt)
    gone = F.coalesce(F.col("expires_at_unix_ms") <= now_ms, F.lit(False))
    if policy.ttl_days:
        gone = gone | (age(now_ms, "created_at_unix_ms") > policy.ttl_days * DAY_MS)
    old = age(now_ms, "created_at_unix_ms") > policy.archive_after_days * DAY_MS if policy.archive_after_days else F.lit(False)
    rows = records.select("id", "tenant_id", "namespace", "updated_at_unix_ms", "importance_score", F.when(spared, None).when(gone, "delete").when(live() & old, "archive").alias("action"), (live() & ~spared).alias("counts"))
    acted = rows.filter("action is not null").select("id", "tenant_id", "namespace", "action")
    cap, space = policy.max_records_per_namespace, ["tenant_id", "namespace"]
    if not cap:
        return acted
    place = F.struct("updated_at_unix_ms", "importance_score", "id")
    counted = rows.filter("counts and action is null").select(*space, place.alias("place"))
    newest = lambda *more: F.row_number().over(Window.partitionBy(*space, *more).orderBy(F.desc("place")))
    few = counted.withColumn("_salt", F.pmod(F.xxhash64("place"), F.lit(SALTS))).withColumn("_r", newest("_salt")).filter(F.col("_r") <= cap)
    edge = few.withColumn("_r", newest()).filter(F.col("_r") == cap).select(*space, F.col("place").alias("edge"))
    capped = counted.join(edge, space).filter(F.col("place") < F.col("edge"))
    return acted.unionByName(capped.select("place.id", *space, F.lit("archive_over_cap").alias("action")))


def apply_retention(records: DataFrame, policy: Retention, now_ms: int, plan: DataFrame | None = None) -> DataFrame:
    """The records after retention. Expired ones are dropped; archived ones become Archived and Historical, updated now."""
    plan = (retention_plan(records, policy, now_ms) if plan is None else plan).select("id", "action")
    rows = records.join(plan, "id", "left").filter("action is null or action <> 'delete'")
    touched = F.col("action").isNotNull()
    after = {"quality_state": F.lit("Archived"), "historical_state": F.lit("Historical"), "updated_at_unix_ms": F.lit(now_ms).cast("bigint")}
    return rows.withColumns({k: F.when(touched, v).otherwise(F.col(k)) for k, v in after.items()}).drop("action").select(*records.columns)


def cleaned_mapping(mapping: DataFrame, gone: DataFrame) -> DataFrame:
    """The idempotency mapping without that of records that are gone (id)."""
    return mapping.join(gone.select(F.col("id").alias("record_id")), "record_id", "left_anti").select(*mapping.columns)


def summary_id(*signature: str | Column) -> Column:
    return F.concat(F.lit("compacted-summary-"), F.substring(F.md5(F.concat_ws("\u001f", *signature).cast("binary")), 1, 16))


def clusters(records: DataFrame, tenant_id: str, namespace: str | None = None) -> DataFrame:
    """Live records in groups of equal signature, two at least: id, place, first_id (the one that stays), members, summary_id, importance_score.

    Texts become a digest before anything moves; groups are summed up with map-side partial sums, so no task ranks
    the members of a group. place sorts ascending in a group's order: newest, most important, least id.
    """
    rows = with_signature(records.filter(admin_scope(tenant_id, namespace) & live()))
    place = F.struct((-F.col("updated_at_unix_ms")).alias("a"), (-F.col("importance_score")).alias("b"), "id")
    # both digests are taken from one signature, which is worked out once
    digests = F.transform(F.array(F.struct(*SIGNATURE)), lambda s: F.struct(F.unhex(F.sha2(F.to_json(s).cast("binary"), 256)).alias("sig"), summary_id(*[s[c] for c in SIGNATURE]).alias("summary_id")))[0]
    rows = rows.select("id", "importance_score", place.alias("place"), digests.alias("_d")).select("id", "importance_score", "place", F.col("_d.sig").alias("_sig"), F.col("_d.summary_id").alias("summary_id"))
    several = rows.groupBy("_sig").agg(F.count("*").alias("members"), F.min("place").alias("_first")).filter("members > 1")
    return rows.join(several.select("_sig", "members", F.col("_first.id").alias("first_id")), "_sig").drop("_sig")


def compaction_plan(records: DataFrame, tenant_id: str, namespace: str | None = None) -> DataFrame:
    """id, summary_id, first_id, members and whether the record is superseded."""
    return clusters(records, tenant_id, namespace).select("id", "summary_id", "first_id", "members", (F.col("id") != F.col("first_id")).alias("superseded"))


# What summaries say, and the keys of their metadata.
ROLLUP_CONTENT, ROLLUP_SUMMARY = " related records into a durable summary. Representative memory: ", " related records: "


def rollups(records: DataFrame, tenant_id: str, now_ms: int, namespace: str | None = None, summarize_after: int = 50) -> DataFrame:
    """A Summary record for each group of summarize_after members at least; 0 is off. It names all its members, so the row grows with its group."""
    if not summarize_after:
        return conform(records.limit(0))
    big = clusters(records, tenant_id, namespace).filter(F.col("members") >= summarize_after)
    links = big.groupBy("summary_id").agg(F.max("importance_score").alias("_top"), F.min("first_id").alias("id"), F.max("members").alias("members"), F.array_sort(F.collect_list("place")).alias("_members"))
    rows = records.join(links, "id")
    said = F.when(F.coalesce(trimmed(F.col("summary")), F.lit("")) != "", F.col("summary")).otherwise(F.col("content"))
    labels = F.when(F.array_contains("labels", "compacted"), F.col("labels")).otherwise(F.array_append("labels", F.lit("compacted")))
    return conform(rows.withColumns({
        "content": F.concat(F.lit("Compacted "), "members", F.lit(ROLLUP_CONTENT), said), "_summary_text": F.concat(F.col("members"), F.lit(ROLLUP_SUMMARY), said),
        "metadata": F.create_map(F.lit("compaction_reason"), F.lit("duplicate_cluster_rollup"), F.lit("compaction_cluster_size"), F.col("members").cast("string"), F.lit("representative_record_id"), F.col("id")),
        "labels": labels, "kind": F.lit("Summary"), "source_id": F.lit(None), "quality_state": F.when(F.col("quality_state") == "Verified", "Verified").otherwise("Active"), "created_at_unix_ms": F.lit(now_ms), "updated_at_unix_ms": F.lit(now_ms),
        "expires_at_unix_ms": F.lit(None), "importance_score": F.col("_top"), "historical_state": F.lit("Current"),
        "lineage": F.transform("_members", lambda m: F.struct(m["id"].alias("record_id"), F.lit("ConsolidatedFrom").alias("relation"), F.lit(1.0).alias("confidence"))).cast(LINEAGE), "id": F.col("summary_id"),
    }).withColumn("summary", F.col("_summary_text")))


def compact(records: DataFrame, tenant_id: str, now_ms: int, namespace: str | None = None, summarize_after: int = 50, cold_after_days: int = 0, cold_per_mille: int = 250) -> DataFrame:
    """The records after compaction: losers Archived and Superseded with a link to the summary's id, rollups added, then cold tiering."""
    plan = compaction_plan(records, tenant_id, namespace).filter("superseded").select("id", "summary_id")
    rows = records.join(plan, "id", "left")
    lost = F.col("summary_id").isNotNull()
    link = F.struct(F.col("summary_id").alias("record_id"), F.lit("SupersededBy").alias("relation"), F.lit(1.0).alias("confidence"))
    rows = rows.withColumns({"quality_state": F.when(lost, "Archived").otherwise(F.col("quality_state")), "historical_state": F.when(lost, "Superseded").otherwise(F.col("historical_state")), "lineage": F.when(lost, F.array_append("lineage", link)).otherwise(F.col("lineage")), "updated_at_unix_ms": F.when(lost, F.lit(now_ms)).otherwise(F.col("updated_at_unix_ms"))}).drop("summary_id")
    rows = rows.unionByName(rollups(records, tenant_id, now_ms, namespace, summarize_after))
    chilled = cold(now_ms, cold_after_days, cold_per_mille) & admin_scope(tenant_id, namespace)
    return rows.withColumns({k: F.when(chilled, v).otherwise(F.col(k)) for k, v in (("historical_state", F.lit("Historical")), ("quality_state", F.lit("Archived")), ("updated_at_unix_ms", F.lit(now_ms)))})


GROUP = ("namespace", "actor_id", "_conversation", "_session", "source")


def synthesis_groups(records: DataFrame, tenant_id: str, min_records: int = 2, max_records: int = 10, **scope) -> DataFrame:
    """Eligible records of groups of min_records at least, the first max_records of each, with place and members."""
    if not tenant_id or min_records <= 0 or max_records < min_records:
        raise ValueError("synthesis needs a tenant, min_records > 0 and max_records >= min_records")
    rows = records.filter(synthesizable(tenant_id, **scope)).withColumns({"_conversation": F.coalesce("conversation_id", F.lit("")), "_session": F.coalesce("session_id", F.lit(""))})
    # narrow rows find each group's first ones; whole records join only those
    newest = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("updated_at_unix_ms"), F.desc("importance_score"), "id"))
    narrow = rows.select(*GROUP, "id", "updated_at_unix_ms", "importance_score").withColumn("place", newest).filter(F.col("place") <= max_records)
    sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("members")).filter(F.col("members") >= min_records)
    return rows.join(narrow.join(sizes, list(GROUP)).select("id", "place", "members"), "id")


def synthesis_proposals(records: DataFrame, tenant_id: str, reason: str, now_ms: int, min_records: int = 2, max_records: int = 10, max_proposals: int = 0, **scope) -> DataFrame:
    """Draft Summary records with source_record_ids, confidence and rationale; the most important first, max_proposals (0: all)."""
    rows = synthesis_groups(records, tenant_id, min_records, max_records, **scope)
    said = F.when(F.coalesce(trimmed(F.col("summary")), F.lit("")) != "", F.col("summary")).otherwise(F.col("content"))
    parts = rows.groupBy(*GROUP).agg(F.max("importance_score").alias("_top"), F.array_sort(F.collect_list(F.struct("place", "id", snippet(said).alias("said")))).alias("_m"))
    first = rows.filter("place = 1").join(parts, list(GROUP))
    ids = F.col("_m.id")
    n = F.size("_m")
    confidence = F.round(F.least(F.lit(0.95), 0.55 + F.least(n, F.lit(9)) * 0.05), 6)
    content = F.concat(F.lit("Synthesized "), n, F.lit(" source memories into a reviewable summary: "), F.array_join(F.slice(F.col("_m.said"), 1, 5), "; "))
    labels = F.col("labels")
    for x in ("synthesized", "review-required"):
        labels = F.when(F.array_contains(labels, x), labels).otherwise(F.array_append(labels, F.lit(x)))
    proposal = first.withColumns({
        "source_record_ids": ids, "confidence": confidence, "rationale": F.lit("records share tenant, namespace, actor, conversation, session, and source"), "content": content, "summary": content, "_labels": labels,
        "metadata": F.create_map(F.lit("synthesis_reason"), F.lit(reason), F.lit("synthesis_strategy"), F.lit("deterministic_scope_rollup"), F.lit("synthesis_source_count"), n.cast("string"), F.lit("review_state"), F.lit("proposed")),
        "id": F.concat(F.lit("synthesis-proposal-"), F.substring(F.md5(F.array_join(ids, "\u001f").cast("binary")), 1, 16)), "kind": F.lit("Summary"), "trust_level": F.lit("Derived"), "quality_state": F.lit("Draft"), "importance_score": F.col("_top"),
        "created_at_unix_ms": F.lit(now_ms), "updated_at_unix_ms": F.lit(now_ms), "expires_at_unix_ms": F.lit(None).cast("long"), "historical_state": F.lit("Current"), "source_id": F.lit(None).cast("string"),
        "lineage": F.transform(ids, lambda i: F.struct(i.alias("record_id"), F.lit("DerivedFrom").alias("relation"), confidence.alias("confidence"))).cast(LINEAGE),
    }).withColumn("labels", F.col("_labels"))
    ordered = proposal.drop("_labels", "_m", "_top", "place", "members", "_conversation", "_session").orderBy(F.desc("importance_score"), "id")
    return ordered.limit(max_proposals) if max_proposals else ordered


def repair_mappings(mapping: DataFrame, records: DataFrame, reason: str, remove_stale: bool = True, rebuild_missing: bool = True) -> DataFrame:
    """The idempotency mapping after repair."""
    if not reason.strip() or not (remove_stale or rebuild_missing):
        raise ValueError("a repair needs a reason and an action")
    stale = stale_mappings(mapping, records)
    kept = mapping.join(stale, ["scoped_key", "record_id"], "left_anti") if remove_stale else mapping
    return kept.unionByName(missing_mappings(mapping, records).select(*mapping.columns)) if rebuild_missing else kept
