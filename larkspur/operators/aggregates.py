"""Statistics, integrity, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, trimmed
from .filters import admin_scope, cold, live

# Trimmed texts with ASCII letters in lower case, as the duplicate signature has them.
SIGNATURE = ("tenant_id", "namespace", "actor_id", "kind", "_content", "_summary")


def with_signature(records: DataFrame) -> DataFrame:
    low = lambda c: ascii_lower(trimmed(F.coalesce(F.col(c), F.lit(""))))
    return records.withColumns({"_content": low("content"), "_summary": low("summary")})


def namespace_stats(records: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    state = F.col("quality_state")
    return records.groupBy("tenant_id", "namespace").agg(
        n(live()).alias("active_records"), n(state == "Archived").alias("archived_records"), n(state == "Deleted").alias("deleted_records"), n(state == "Suppressed").alias("suppressed_records"), n(F.col("trust_level") == "Pinned").alias("pinned_records")
    )


def duplicate_groups(records: DataFrame) -> DataFrame:
    """Groups of live records with one signature: members and the least id."""
    rows = with_signature(records.filter(live()))
    return rows.groupBy(*SIGNATURE).agg(F.count("*").alias("members"), F.min("id").alias("first_id")).filter("members > 1")


def maintenance_stats(records: DataFrame, now_ms: int) -> DataFrame:
    """One row: tombstones, expired, historical, superseded, lineage links, duplicate groups and surplus records."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = records.agg(
        n(F.col("quality_state") == "Deleted").alias("tombstoned_records"), n(F.col("expires_at_unix_ms") <= now_ms).alias("expired_records"), n(F.col("historical_state") == "Historical").alias("historical_records"),
        n(F.col("historical_state") == "Superseded").alias("superseded_records"), F.coalesce(F.sum(F.size("lineage")), F.lit(0)).cast("long").alias("lineage_links"),
    )
    groups = duplicate_groups(records).agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("duplicate_records"))
    return counts.join(F.broadcast(groups))  # one row each


def parse_idempotency(keys: DataFrame) -> DataFrame:
    """(scoped_key, record_id) -> parts; a key that is not six parts on U+001F is stale."""
    parts = F.split("scoped_key", "\u001f")
    names = ("tenant_id", "namespace", "actor_id", "conversation_id", "session_id", "key")
    return keys.select("scoped_key", "record_id", (F.size(parts) == 6).alias("well_formed"), *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def idempotency_key() -> Column:
    """The six-part key of a record row that has idempotency_key."""
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("\u001f", "tenant_id", "namespace", "actor_id", none("conversation_id"), none("session_id"), "idempotency_key")


def stale_mappings(mapping: DataFrame, records: DataFrame) -> DataFrame:
    """Mappings whose key is malformed, whose record is gone or bears another key."""
    own = records.filter("idempotency_key is not null").select(F.col("id").alias("record_id"), idempotency_key().alias("scoped_key"))
    return mapping.join(own, ["scoped_key", "record_id"], "left_anti")


def missing_mappings(mapping: DataFrame, records: DataFrame) -> DataFrame:
    own = records.filter("idempotency_key is not null").select(idempotency_key().alias("scoped_key"), F.col("id").alias("record_id"))
    return own.join(mapping, ["scoped_key", "record_id"], "left_anti")


def integrity_summary(records: DataFrame, mapping: DataFrame) -> DataFrame:
    scanned = records.agg(F.count("*").alias("scanned_records"))
    stale = stale_mappings(mapping, records).agg(F.count("*").alias("stale_idempotency_keys"))
    missing = missing_mappings(mapping, records).agg(F.count("*").alias("missing_idempotency_keys"))
    groups = duplicate_groups(records).agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("duplicate_records"))
    row = scanned.join(F.broadcast(stale)).join(F.broadcast(missing)).join(F.broadcast(groups))  # one row each
    return row.withColumn("healthy", (F.col("stale_idempotency_keys") + F.col("missing_idempotency_keys") + F.col("duplicate_groups")) == 0)


def export_manifest(records: DataFrame, include_archived: bool = False) -> DataFrame:
    """Distinct tenant:namespace, count and bytes; only Archived is held back by the flag."""
    rows = exported(records, include_archived)
    size = F.octet_length("content") + F.octet_length(F.coalesce("summary", F.lit("")))
    return rows.agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "tenant_id", "namespace"))), ",").alias("namespaces"), F.count("*").alias("record_count"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("content_bytes"))


def exported(records: DataFrame, include_archived: bool = False) -> DataFrame:
    return records if include_archived else records.filter(F.col("quality_state") != "Archived")


def snapshot_manifest(records: DataFrame, storage_bytes: int = 0) -> DataFrame:
    """Distinct namespaces, count, and the bytes of the store's files, as given."""
    return records.agg(F.array_join(F.array_sort(F.collect_set("namespace")), ",").alias("namespaces"), F.count("*").alias("record_count")).withColumn("storage_bytes", F.lit(storage_bytes).cast("long"))


def compaction_counts(records: DataFrame, tenant_id: str, now_ms: int, namespace: str | None = None, summarize_after: int = 50, cold_after_days: int = 0, cold_per_mille: int = 250, dry_run: bool = False) -> DataFrame:
    """One row: deduplicated, archived and superseded records, summarized clusters and lineage links that a compaction makes.

    Cold records that are superseded as well are counted as archived twice in a dry run, which leaves them live, and superseded records' own
    links are counted only where they are written.
    """
    from .maintenance import clusters

    groups = clusters(records, tenant_id, namespace)
    big = (F.col("members") >= summarize_after) & F.lit(bool(summarize_after))
    row = groups.agg(F.count_if(F.col("id") != F.col("first_id")).alias("superseded_records"), F.count_if(big & (F.col("id") == F.col("first_id"))).alias("summarized_clusters"), F.count_if(big).alias("_links"))
    chilled = records.filter(cold(now_ms, cold_after_days, cold_per_mille) & admin_scope(tenant_id, namespace)).select("id")
    if not dry_run:
        chilled = chilled.join(groups.filter("id <> first_id").select("id"), "id", "left_anti")
    row = row.join(F.broadcast(chilled.agg(F.count("*").alias("_cold"))))  # one row each
    lost = F.col("superseded_records")
    return row.select(lost.alias("deduplicated_records"), (lost + F.col("_cold")).alias("archived_records"), lost, "summarized_clusters", (F.col("_links") + (F.lit(0) if dry_run else lost)).alias("lineage_links_created"))


def latency_summary(traces: DataFrame, value: str, *keys: str, seconds: float | None = None) -> DataFrame:
    """Samples, mean, p50, p95 (nearest rank) and max of a measure, and samples a second if the seconds are given.

    Equal values are counted before they are ranked, and ranks are running sums, which spill: no group is gathered into an array.
    """
    counted = traces.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy("_v")
    ranked = counted.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = traces.groupBy(*keys).agg(F.count(value).alias("samples"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    at = lambda p: F.min(F.when(F.col("_upto") > F.round((F.col("samples") - 1) * p), F.col("_v")))
    ranks = ranked.join(sums.select(*keys, "samples"), list(keys)) if keys else ranked.join(F.broadcast(sums.select("samples")))
    ranks = ranks.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    out = sums.join(ranks, list(keys), "left") if keys else sums.join(F.broadcast(ranks))
    rate = F.lit(None).cast("double") if seconds is None else F.col("samples") / F.lit(float(seconds))
    return out.select(*keys, "samples", "mean", "p50", "p95", "max", rate.alias("throughput_per_sec"))


def planner_metrics(found: DataFrame) -> DataFrame:
    """One row for recall's candidates: how many the text found, how many the graph added, and the last hop that added any."""
    hop = F.regexp_extract(F.array_join("relation_reasons", " "), r"graph_hop=(\d+)", 1)
    return found.agg(
        F.count_if(F.col("planner_stage") == "CandidateGeneration").alias("seeded_candidates"), F.count_if(F.col("planner_stage") == "GraphExpansion").alias("expanded_candidates"),
        F.coalesce(F.max(F.when(hop != "", hop.try_cast("int"))), F.lit(0)).alias("hops_applied"),
    )


def tenant_load(traces: DataFrame) -> DataFrame:
    """By tenant: requests under way, and the mean (whole ms) and greatest wait of those that have begun; traces (tenant_id, queue_wait_ms, status; null status: under way)."""
    begun = F.col("queue_wait_ms").isNotNull()
    return traces.groupBy("tenant_id").agg(
        F.count_if(begun & F.col("status").isNull()).alias("inflight"), F.count_if(~begun).alias("queued"),
        F.coalesce(F.floor(F.avg("queue_wait_ms")), F.lit(0)).cast("long").alias("average_queue_wait_ms"), F.coalesce(F.max("queue_wait_ms"), F.lit(0)).cast("long").alias("max_queue_wait_ms"),
    )
