"""A store of records on Parquet: snapshots with a manifest, versions, change events, idempotency.

Records and the idempotency mapping lie in folders by tenant and namespace. A commit writes only
the folders that it touches, under a name of its own, and then a manifest, ``commits/commit-<n>``, which says where
each folder's current files are; readers follow the highest manifest. One writer at a time: two that prepare
the same number clash on the manifest's name, and the second one fails. Versions and events of a commit wait in ``pending`` and
move to their place behind the manifest, so those of a writer that loses are never read.

All row work is DataFrame joins (a merge is an anti join and a union). Every commit writes a version and an event for every row that
it changed, also those of compaction, retention and import, with a tombstone for rows that went: time travel sees them all.
"""

from __future__ import annotations

import json
import time
import uuid
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..operators.aggregates import compaction_counts, exported, idempotency_key, integrity_summary, missing_mappings, parse_idempotency, snapshot_manifest, stale_mappings
from ..operators.filters import admin_scope
from ..operators.maintenance import Retention, apply_retention, cleaned_mapping, compact, compaction_plan, repair_mappings, retention_plan, synthesis_proposals
from ..operators.recall import recall
from ..operators.scoring import Engine, Query
from .records import DDL, SCHEMA, conform, violations
from .shared import discard, durable, file_system

MAX_BATCH = 256
_STRUCT = "struct<" + ", ".join(f"{k}: {v}" for k, v in SCHEMA.items()) + ">"
STORED = f"{DDL}, idempotency_key string"
MAPPING = "scoped_key string, record_id string, tenant_id string, namespace string"
VERSIONS = f"record_id string, observed_at_ms bigint, step int, record {_STRUCT}"
EVENTS = f"sequence bigint, event_id string, kind string, record_id string, tenant_id string, namespace string, occurred_at_ms bigint, summary string, record {_STRUCT}"
PACKAGE_VERSION = 1
# What events say of each kind.
SAID = {"Inserted": "record inserted", "Replaced": "record replaced", "Archived": "record archived", "Suppressed": "record suppressed", "Recovered": "record recovered", "Deleted": "record tombstoned", "HardDeleted": "record hard deleted", "Synthesized": "synthesis proposal persisted"}


class Invalid(ValueError):
    """A request breaks a rule."""


class Conflict(ValueError):
    """An idempotency key belongs to another record."""


class NotFound(Invalid):
    """There is no such record."""


class Backend(ABC):
    """What a store has to offer; recall, time travel and statistics follow from it. Any class with these is one."""

    @abstractmethod
    def records(self) -> DataFrame: ...

    @abstractmethod
    def versions(self) -> DataFrame: ...

    @abstractmethod
    def upsert(self, batch: DataFrame, now_ms: int | None = None) -> DataFrame: ...

    def recall(self, q: Query, e: Engine = Engine()) -> DataFrame:
        return recall(self.records(), q, e)

    def as_of(self, at_ms: int) -> DataFrame:
        return lifecycle.as_of(self.versions(), at_ms)

    def recall_as_of(self, q: Query, at_ms: int, e: Engine = Engine()) -> DataFrame:
        """The query, its filters and its clock, over the records as they were."""
        return recall(self.as_of(at_ms), q, e)


class Store(Backend):
    def __init__(self, spark: SparkSession, path: str, retention: Retention = Retention(), require_key: bool = True, require_labels: bool = False, max_batch: int = MAX_BATCH) -> None:
        self.spark, self.path, self.retention = spark, path.rstrip("/"), retention
        self.require_key, self.require_labels, self.max_batch = require_key, require_labels, max_batch

    # -- snapshots

    def _names(self, folder: str) -> list[str]:
        fs, where = file_system(self.spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def head(self) -> int:
        """The number of the last commit; 0 for a new store."""
        return max((int(x[7:]) for x in self._names("commits") if x.startswith("commit-")), default=0)

    def manifest(self) -> dict:
        """commits: the folders' names so far; records and mapping: partition -> the commit that wrote it last."""
        n = self.head()
        if not n:
            return {"commit": 0, "commits": [], "records": {}, "mapping": {}}
        fs, where = file_system(self.spark, f"{self.path}/commits/commit-{n}")
        jvm, stream = self.spark._jvm, fs.open(where)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _partition(self, tenant_id: str, namespace: str) -> str:
        to_path = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return f"{to_path('tenant_id', tenant_id)}/{to_path('namespace', namespace)}"

    def _table(self, name: str, ddl: str, parts: list[str] | None = None) -> DataFrame:
        held = self.manifest()[name]
        paths = [f"{self.path}/{name}/commit={held[p]}/{p}" for p in (sorted(held) if parts is None else parts) if p in held]
        if not paths:
            return self.spark.createDataFrame([], ddl)
        names = [c.name for c in self.spark.createDataFrame([], ddl).schema]
        return self.spark.read.schema(f"{ddl}, commit string").option("basePath", f"{self.path}/{name}").parquet(*paths).select(*names)

    def stored(self, parts: list[str] | None = None) -> DataFrame:
        """Records with idempotency_key; of some partitions only if asked for."""
        return self._table("records", STORED, parts)

    def records(self) -> DataFrame:
        return self.stored().drop("idempotency_key")

    def get(self, record_id: str, tenant_id: str, namespace: str) -> DataFrame:
        """The record of that id: reads its namespace's files only."""
        return self.stored([self._partition(tenant_id, namespace)]).filter(F.col("id") == record_id).drop("idempotency_key")

    def mapping(self) -> DataFrame:
        return self._table("mapping", MAPPING).select("scoped_key", "record_id")

    def _log(self, name: str, ddl: str) -> DataFrame:
        commits = self._publish()
        have = set(self._names(name))
        paths = [f"{self.path}/{name}/commit={c}" for c in commits if f"commit={c}" in have]
        empty = self.spark.createDataFrame([], f"{ddl}, commit string")
        return self.spark.read.schema(f"{ddl}, commit string").option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else empty

    def _publish(self) -> list[str]:
        """Move what committed writers have left pending to its place; gives the commits."""
        commits, waiting = self.manifest()["commits"], set(self._names("pending"))
        for c in (c for c in commits if c in waiting):
            for name in self._names(f"pending/{c}"):
                fs, source = file_system(self.spark, f"{self.path}/pending/{c}/{name}")
                _, to = file_system(self.spark, f"{self.path}/{name}/commit={c}")
                fs.mkdirs(to.getParent())
                fs.rename(source, to)
            discard(self.spark, f"{self.path}/pending/{c}")
        return commits

    def versions(self) -> DataFrame:
        """record_id, observed_at_ms, record (null: gone) and version_no, which tells versions of one millisecond apart: the later one counts."""
        rows = self._log("versions", VERSIONS)
        return rows.select("record_id", "observed_at_ms", "record", (F.split("commit", "-")[0].cast("bigint") * 4 + F.col("step")).alias("version_no"))

    def changefeed(self) -> DataFrame:
        return self._log("changefeed", EVENTS).drop("commit")

    def _commit(self, kind: str, now_ms: int, rows: DataFrame | None, maps: DataFrame | None, spaces: list[tuple[str, str]] | None, changes: DataFrame) -> int:
        """rows and maps replace those of spaces (None: of all); None leaves them.

        changes: SCHEMA's columns of the rows that this commit changed, with _kind and _summary of the event, _seen (its time), _gone and _step.
        """
        old = self.manifest()
        new = old["commit"] + 1
        tag = f"{new}-{uuid.uuid4().hex[:12]}"
        touched = None if spaces is None else {self._partition(*s) for s in spaces}
        state = {"commit": new, "kind": kind, "at_ms": now_ms, "commits": [*old["commits"], tag]}
        for name, table in (("records", rows), ("mapping", maps)):
            state[name] = dict(old[name])
            if table is None:
                continue
            state[name] = {} if touched is None else {k: v for k, v in old[name].items() if k not in touched}
            table.write.partitionBy("tenant_id", "namespace").parquet(f"{self.path}/{name}/commit={tag}")
            for tenant in self._names(f"{name}/commit={tag}"):
                state[name] |= {f"{tenant}/{n}": tag for n in self._names(f"{name}/commit={tag}/{tenant}") if "=" in tenant}
        changes = durable(changes, "changes")
        if not changes.isEmpty():
            record = F.when(~F.col("_gone"), F.struct(*SCHEMA))
            pending = f"{self.path}/pending/{tag}"
            changes.select(F.col("id").alias("record_id"), F.col("_seen").cast("bigint").alias("observed_at_ms"), F.col("_step").alias("step"), record.alias("record")).write.parquet(f"{pending}/versions")
            base = self.changefeed().agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
            events = numbered(changes, ["_step", "id"]).select(
                (F.col("_n") + base).cast("bigint").alias("sequence"), F.concat(F.lit("change:spark:"), F.col("_n") + base).alias("event_id"), F.col("_kind").alias("kind"), F.col("id").alias("record_id"), "tenant_id", "namespace", F.col("_seen").cast("bigint").alias("occurred_at_ms"), F.col("_summary").alias("summary"), record.alias("record")
            )
            events.write.parquet(f"{pending}/changefeed")
        fs, where = file_system(self.spark, f"{self.path}/commits/commit-{new}")
        out = fs.create(where, False)  # fails if another writer has made it
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._publish()
        discard(self.spark, changes)
        return new

    # -- writes

    def upsert(self, batch: DataFrame, now_ms: int | None = None) -> DataFrame:
        """Upsert rows (record columns, idempotency_key, optional position; the last of an id wins). One receipt for each row.

        The whole batch is checked before anything is written. A key that its record
        already has makes the row a duplicate, which writes nothing; a key of another record is a Conflict.
        Retention runs over the namespaces of the batch.
        """
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        if "idempotency_key" not in batch.columns:
            batch = batch.withColumn("idempotency_key", F.lit(None).cast("string"))
        position = F.col("position") if "position" in batch.columns else F.lit(0)
        rows = batch.withColumn("_at", position).select("_at", "idempotency_key", *[F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in SCHEMA.items()])
        rows = _conform_with(rows).persist()
        if rows.count() > self.max_batch:
            raise Invalid(f"more than {self.max_batch} records")
        bad = rows.select("id", violations(self.require_key, self.require_labels).alias("v")).filter("size(v) > 0").limit(1).collect()
        if bad:
            raise Invalid(f"{bad[0]['id']}: {bad[0]['v'][0]}")
        current, mapping = self.stored(), self.mapping()
        keyed = rows.filter("idempotency_key is not null").select(idempotency_key().alias("scoped_key"), F.col("id").alias("record_id"))
        owned = keyed.join(mapping.withColumnRenamed("record_id", "owner"), "scoped_key").join(current.select(F.col("id").alias("owner")), "owner")
        other = owned.filter("owner <> record_id").union(keyed.groupBy("scoped_key").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b")).filter("a <> b").select(F.col("a").alias("owner"), "scoped_key", F.col("b").alias("record_id"))).limit(1).collect()
        if other:
            raise Conflict(f"idempotency key of {other[0]['record_id']} belongs to {other[0]['owner']}")
        same = owned.filter("owner = record_id").select(F.col("record_id").alias("id")).distinct()
        last = rows.join(same, "id", "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_at")))).filter("_n = 1").drop("_n", "_at")
        last = durable(last, "batch")
        receipts = rows.select("id").join(same.withColumn("deduplicated", F.lit(True)), "id", "left").select("id", F.coalesce("deduplicated", F.lit(False)).alias("deduplicated"))
        receipts = self.spark.createDataFrame(receipts.collect(), receipts.schema)  # max_batch rows at most
        if not last.isEmpty():
            ids = F.broadcast(last.select("id"))  # max_batch rows at most
            before = current.join(ids, "id", "left_semi").select("id", "tenant_id", "namespace").collect()
            own = {(r[0], r[1]) for r in last.select("tenant_id", "namespace").distinct().collect()}
            spaces = sorted(own | {(r[1], r[2]) for r in before})
            parts = [self._partition(*s) for s in spaces]
            merged = durable(self.stored(parts).join(ids, "id", "left_anti").unionByName(last), "merged")
            inside = merged.filter(_in(sorted(own)))
            plan = durable(retention_plan(inside, self.retention, now_ms), "plan")
            kept = apply_retention(inside, self.retention, now_ms, plan).unionByName(merged.filter(~_in(sorted(own))))
            known = F.col("id").isin([r[0] for r in before])
            upserted = _changes(last, "Upserted", F.when(known, SAID["Replaced"]).otherwise(SAID["Inserted"]), F.col("updated_at_unix_ms"))
            acted = inside.join(plan.select("id", "action"), "id")
            archived = _changes(apply_retention(inside, self.retention, now_ms, plan).join(plan.select("id"), "id", "left_semi"), "RetentionArchived", F.lit("record archived by retention"), F.lit(now_ms), step=1)
            dropped = _changes(acted.filter("action = 'delete'"), "RetentionDeleted", F.lit("record deleted by retention"), F.lit(now_ms), step=1, gone=True)
            maps = self._table("mapping", MAPPING, parts).join(F.broadcast(last.select(F.col("id").alias("record_id"))), "record_id", "left_anti").unionByName(_mapping_of(last))
            maps = cleaned_mapping(maps, plan.filter("action = 'delete'"))
            self._commit("Upserted", now_ms, kept, maps, spaces, upserted.unionByName(archived).unionByName(dropped))
            discard(self.spark, merged, plan)
        discard(self.spark, last)
        rows.unpersist()
        return receipts

    def _target(self, record_id: str, tenant_id: str, namespace: str, reason: str, need: bool = True) -> DataFrame:
        if not all(x and x.strip() for x in (record_id, tenant_id, namespace, reason)):
            raise Invalid("record, tenant, namespace and reason are needed")
        row = self.stored([self._partition(tenant_id, namespace)]).filter(F.col("id") == record_id)
        if row.isEmpty():
            if not self.stored().filter(F.col("id") == record_id).isEmpty():
                raise Invalid(f"record {record_id} is not in this scope")
            if need:
                raise NotFound(f"no record {record_id}")
        return row

    def _replace(self, kind: str, record_id: str, tenant_id: str, namespace: str, new: DataFrame | None, changes: DataFrame, now_ms: int) -> None:
        """Commit one record's new row, or its removal: its namespace's files only."""
        part = [self._partition(tenant_id, namespace)]
        kept = self.stored(part).filter(F.col("id") != record_id)
        maps = None if new is not None else self._table("mapping", MAPPING, part).filter(F.col("record_id") != record_id)
        self._commit(kind, now_ms, kept if new is None else kept.unionByName(new.select(*kept.columns)), maps, [(tenant_id, namespace)], changes)

    def _change(self, kind: str, step, record_id: str, tenant_id: str, namespace: str, reason: str, now_ms: int, dry_run: bool) -> dict:
        row = step(self._target(record_id, tenant_id, namespace, reason))
        after = row.first()
        if after["changed"] and not dry_run:
            self._replace(kind, record_id, tenant_id, namespace, row.drop("changed"), _changes(row, kind, F.lit(SAID[kind]), F.lit(now_ms)), now_ms)
        return {"record_id": record_id, "changed": after["changed"], "quality_state": after["quality_state"], "historical_state": after["historical_state"], "dry_run": dry_run}

    def archive(self, record_id: str, tenant_id: str, namespace: str, reason: str, now_ms: int, dry_run: bool = False) -> dict:
        return self._change("Archived", lambda r: lifecycle.archive(r, now_ms), record_id, tenant_id, namespace, reason, now_ms, dry_run)

    def suppress(self, record_id: str, tenant_id: str, namespace: str, reason: str, now_ms: int, dry_run: bool = False) -> dict:
        return self._change("Suppressed", lambda r: lifecycle.suppress(r, now_ms), record_id, tenant_id, namespace, reason, now_ms, dry_run)

    def recover(self, record_id: str, tenant_id: str, namespace: str, reason: str, now_ms: int, state: str = "Active", historical_state: str = "Current", dry_run: bool = False) -> dict:
        return self._change("Recovered", lambda r: lifecycle.recover(r, now_ms, state, historical_state), record_id, tenant_id, namespace, reason, now_ms, dry_run)

    def delete(self, record_id: str, tenant_id: str, namespace: str, reason: str, now_ms: int, hard: bool = False, dry_run: bool = False) -> dict:
        """A missing record is no error. Hard deletion removes row and mapping and leaves a tombstone version."""
        row = self._target(record_id, tenant_id, namespace, reason, need=False)
        found = not row.isEmpty()
        if found and not dry_run:
            new = None if hard else lifecycle.soft_delete(row, now_ms).drop("changed")
            changes = _changes(row if hard else new, "Deleted", F.lit(SAID["HardDeleted" if hard else "Deleted"]), F.lit(now_ms), gone=hard)
            self._replace("Deleted", record_id, tenant_id, namespace, new, changes, now_ms)
        return {"record_id": record_id, "deleted": found, "hard": found and hard, "dry_run": dry_run}

    def clear(self, reason: str, now_ms: int) -> int:
        """Remove every record and mapping, with a tombstone each; returns how many there were."""
        if not reason.strip():
            raise Invalid("a reason is needed")
        rows = self.stored()
        n = rows.count()
        self._commit("Cleared", now_ms, rows.limit(0), self._table("mapping", MAPPING).limit(0), None, _changes(rows, "Deleted", F.lit(SAID["HardDeleted"]), F.lit(now_ms), gone=True))
        return n

    def compact(self, tenant_id: str, now_ms: int, dry_run: bool = False, **options) -> dict:
        """Commit compact()'s result, unless dry_run; returns its counts."""
        before = self.stored()
        counts = compaction_counts(before, tenant_id, now_ms, dry_run=dry_run, **options).first().asDict()
        if dry_run:
            return counts
        after = compact(before.drop("idempotency_key"), tenant_id, now_ms, **options).join(before.select("id", "idempotency_key"), "id", "left")
        changed = durable(after.filter(F.col("updated_at_unix_ms") == now_ms), "changed")
        spaces = [(r[0], r[1]) for r in changed.select("tenant_id", "namespace").distinct().collect()]
        if spaces:
            self._commit("Compacted", now_ms, after.filter(_in(spaces)).select(*before.columns), None, spaces, _changes(changed, "Compacted", F.lit("record compacted"), F.lit(now_ms)))
        discard(self.spark, changed)
        return counts

    def synthesize(self, tenant_id: str, reason: str, now_ms: int, dry_run: bool = True, **options) -> DataFrame:
        """The proposals; written as records unless dry_run."""
        proposals = synthesis_proposals(self.records(), tenant_id, reason, now_ms, **options)
        if not dry_run:
            proposals = durable(proposals, "proposals")
            spaces = [(r[0], r[1]) for r in proposals.select("tenant_id", "namespace").distinct().collect()]
            if spaces:
                inside = self.stored([self._partition(*s) for s in spaces])
                new = proposals.select(*SCHEMA, F.lit(None).cast("string").alias("idempotency_key"))
                rows = inside.join(new.select("id"), "id", "left_anti").unionByName(new)
                self._commit("Synthesized", now_ms, rows, None, spaces, _changes(new, "Upserted", F.lit(SAID["Synthesized"]), F.lit(now_ms)))
        return proposals

    def repair(self, reason: str, now_ms: int, **options) -> None:
        mapping = repair_mappings(self.mapping(), self.stored(), reason, **options)
        of_key = parse_idempotency(mapping).select("scoped_key", "record_id", F.coalesce("tenant_id", F.lit("-")).alias("tenant_id"), F.coalesce("namespace", F.lit("-")).alias("namespace"))
        self._commit("Repaired", now_ms, None, of_key, None, _changes(self.stored().limit(0), "Repaired", F.lit(""), F.lit(now_ms)))

    def integrity(self, tenant_id: str | None = None, namespace: str | None = None) -> DataFrame:
        rows = self.stored().filter(admin_scope(tenant_id, namespace))
        mapping = self.mapping()
        if tenant_id is not None or namespace is not None:
            parts = parse_idempotency(mapping).filter(admin_scope(tenant_id, namespace))
            mapping = mapping.join(parts.select("scoped_key", "record_id"), ["scoped_key", "record_id"], "left_semi")
        return integrity_summary(rows, mapping)

    def snapshot(self) -> DataFrame:
        """One row: namespaces, record_count, storage_bytes."""
        return snapshot_manifest(self.records(), self.storage_bytes())

    def run_maintenance(self, reason: str, now_ms: int, tenant_id: str | None = None, namespace: str | None = None, dry_run: bool = True, check: bool = True, repair: bool = True, compaction: bool = True, synthesis: bool = False) -> dict:
        """Integrity, repair, compaction and synthesis (the last two for one tenant), integrity again."""
        report: dict = {"dry_run": dry_run, "integrity_before": self.integrity(tenant_id, namespace).first().asDict() if check else None, "repair": None, "compaction": None, "synthesis": None}
        if repair:
            stale, missing = stale_mappings(self.mapping(), self.stored()).count(), missing_mappings(self.mapping(), self.stored()).count()
            report["repair"] = {"removed": stale, "rebuilt": missing}
            if not dry_run and stale + missing:
                self.repair(reason, now_ms)
        if compaction and tenant_id is not None:
            report["compaction"] = self.compact(tenant_id, now_ms, dry_run=dry_run, namespace=namespace)
        if synthesis and tenant_id is not None:
            report["synthesis"] = {"proposals": self.synthesize(tenant_id, reason, now_ms, dry_run=dry_run).count()}
        report["integrity_after"] = self.integrity(tenant_id, namespace).first().asDict() if check else None
        return report

    def run_schedule(self, reason: str, every_s: float = 3600.0, runs: int | None = None, sleep=time.sleep, clock=time.time, **options) -> list[dict]:
        """Maintenance every so many seconds (a dry run by default), runs times or until interrupted; an error is reported and the next run goes on."""
        reports: list[dict] = []
        while runs is None or len(reports) < runs:
            if reports:
                sleep(every_s)
            try:
                reports.append(self.run_maintenance(reason, int(clock() * 1000), **options))
            except Exception as error:  # noqa: BLE001  one failed run does not end the schedule
                reports.append({"error": str(error)})
            if runs is None:
                del reports[:-1]
        return reports

    def storage_bytes(self) -> int:
        """Bytes of all files, old snapshots included."""
        fs, where = file_system(self.spark, self.path)
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    # -- export, import

    def export(self, path: str, include_archived: bool = False) -> None:
        """One folder: records, and a manifest row with version and count."""
        rows = exported(self.stored(), include_archived)
        rows.write.parquet(f"{path}/records")
        self.spark.range(1).select(F.lit(PACKAGE_VERSION).alias("package_version"), F.lit(rows.count()).alias("record_count")).write.json(f"{path}/manifest")

    def import_package(self, path: str, mode: str = "Merge", now_ms: int = 0, dry_run: bool = False) -> dict:
        """Validate, Merge (records already there stay as they are) or Replace (everything goes first, with tombstones). All or nothing."""
        manifest = self.spark.read.json(f"{path}/manifest").first()
        rows = _conform_with(self.spark.read.parquet(f"{path}/records"))
        total = rows.count()
        bad = rows.filter(F.size(violations(False, self.require_labels)) > 0).count()
        valid = not bad and manifest["package_version"] == PACKAGE_VERSION and manifest["record_count"] == total
        current = self.stored()
        new = durable(rows if mode == "Replace" else import_plan(rows, current), "imported")
        count = new.count()
        applied = valid and mode != "Validate" and not dry_run
        report = {"mode": mode, "records": total, "failed": bad, "valid": valid, "imported": count, "skipped": 0 if mode == "Replace" else total - count, "applied": applied}
        if applied:
            changes = _changes(new, "Imported", F.lit("record imported"), F.lit(now_ms), step=1)
            if mode == "Replace":
                gone = current.join(new.select("id"), "id", "left_anti")
                changes = changes.unionByName(_changes(gone, "Deleted", F.lit("record replaced by import"), F.lit(now_ms), gone=True))
                self._commit("Imported", now_ms, new.select(*current.columns), _mapping_of(new), None, changes)
            else:
                spaces = [(r[0], r[1]) for r in new.select("tenant_id", "namespace").distinct().collect()]
                parts = [self._partition(*s) for s in spaces]
                self._commit("Imported", now_ms, self.stored(parts).unionByName(new.select(*current.columns)), self._table("mapping", MAPPING, parts).unionByName(_mapping_of(new)), spaces, changes)
        discard(self.spark, new)
        return report

    def ship(self, other: Store, path: str, mode: str = "Replace", now_ms: int = 0, include_archived: bool = True) -> dict:
        """Copy this store's records into another one through a package at path, which both can reach."""
        self.export(path, include_archived)
        return other.import_package(path, mode, now_ms)


def import_plan(rows: DataFrame, current: DataFrame) -> DataFrame:
    """The rows of a package that a merge adds: those whose id is not there yet."""
    return rows.join(current.select("id"), "id", "left_anti")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _n from 1 in an order, by ranges: no task sees more than its own range and the ranges' counts."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = durable(ranged, "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_n", inside).join(F.broadcast(counts.select("_p", "_before")), "_p").withColumn("_n", F.col("_n") + F.col("_before")).drop("_p", "_before")


def _changes(rows: DataFrame, kind: str, summary: Column, seen: Column, step: int = 0, gone: bool = False) -> DataFrame:
    return rows.select(*SCHEMA, F.lit(kind).alias("_kind"), summary.alias("_summary"), seen.cast("bigint").alias("_seen"), F.lit(gone).alias("_gone"), F.lit(step).alias("_step"))


def _in(spaces: list[tuple[str, str]]) -> Column:
    return F.struct("tenant_id", "namespace").isin([F.struct(F.lit(t).alias("tenant_id"), F.lit(n).alias("namespace")) for t, n in spaces]) if spaces else F.lit(False)


def _mapping_of(rows: DataFrame) -> DataFrame:
    return rows.filter("idempotency_key is not null").select(idempotency_key().alias("scoped_key"), F.col("id").alias("record_id"), "tenant_id", "namespace")


def _conform_with(rows: DataFrame) -> DataFrame:
    """conform, with idempotency_key and _at carried."""
    extra = [c for c in ("idempotency_key", "_at") if c in rows.columns]
    return conform(rows, extra)
