"""State changes of records, as new columns; writing them is the store's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive(records: DataFrame, now_ms: int) -> DataFrame:
    """Archived; Current becomes Historical. With changed: whether the row was not so already."""
    now = F.col("historical_state") == "Current"
    changed = (F.col("quality_state") != "Archived") | now
    return _set(records, changed, now_ms, quality_state=F.lit("Archived"), historical_state=F.when(now, "Historical").otherwise(F.col("historical_state")))


def suppress(records: DataFrame, now_ms: int) -> DataFrame:
    return _set(records, F.col("quality_state") != "Suppressed", now_ms, quality_state=F.lit("Suppressed"))


def soft_delete(records: DataFrame, now_ms: int) -> DataFrame:
    return _set(records, F.lit(True), now_ms, quality_state=F.lit("Deleted"))


def recover(records: DataFrame, now_ms: int, state: str = "Active", historical_state: str = "Current") -> DataFrame:
    if state not in ("Active", "Verified") or historical_state == "Superseded":
        raise ValueError("records recover to Active or Verified, and never to Superseded")
    changed = (F.col("quality_state") != state) | (F.col("historical_state") != historical_state)
    return _set(records, changed, now_ms, quality_state=F.lit(state), historical_state=F.lit(historical_state))


def _set(records: DataFrame, changed, now_ms: int, **columns) -> DataFrame:
    rows = records.withColumn("changed", changed)
    new = {k: F.when(F.col("changed"), v).otherwise(F.col(k)) for k, v in columns.items()}
    return rows.withColumns(new | {"updated_at_unix_ms": F.when(F.col("changed"), F.lit(now_ms)).otherwise(F.col("updated_at_unix_ms"))})


def as_of(versions: DataFrame, at_ms: int) -> DataFrame:
    """Each record's latest version up to at_ms; a tombstone (null record) means it is not there.

    Of versions of one millisecond the one with the highest version_no counts; without that column, a tombstone does, then the greatest hash.
    """
    if "version_no" in versions.columns:
        order = F.struct("observed_at_ms", "version_no")
    else:
        order = F.struct(F.col("observed_at_ms"), F.col("record").isNull().alias("gone"), F.xxhash64(F.to_json("record")).alias("hash"))
    latest = versions.filter(F.col("observed_at_ms") <= at_ms).groupBy("record_id").agg(F.max_by("record", order).alias("record"))
    return latest.filter("record is not null").select("record.*")


def tombstones(versions: DataFrame) -> DataFrame:
    """record_id of the records whose last version says that they are gone."""
    last = versions.groupBy("record_id").agg(F.max_by(F.col("record").isNull(), F.struct(F.col("observed_at_ms"), F.col("record").isNull().alias("gone"))).alias("gone"))
    return last.filter("gone").select("record_id")


def changefeed_page(feed: DataFrame, after_sequence: int = 0, tenant_id: str | None = None, namespace: str | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(events after a sequence number, whether more are left)."""
    limit = max(1, limit)
    rows = feed.filter(F.col("sequence") > after_sequence)
    for k, v in (("tenant_id", tenant_id), ("namespace", namespace)):
        rows = rows.filter(F.col(k) == v) if v is not None else rows
    more = rows.orderBy("sequence").limit(limit + 1)
    return more.orderBy("sequence").limit(limit), more.agg((F.count("*") > limit).alias("truncated"))
