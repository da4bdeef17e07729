"""The record schema, its enumerations and write-time rules, and records made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Enumerations, in ordinal order.
TRUST_LEVELS = ("Untrusted", "Observed", "Derived", "Verified", "Pinned")
KINDS = ("Episodic", "Summary", "Fact", "Preference", "Task", "Artifact", "Hypothesis")
QUALITY_STATES = ("Draft", "Active", "Verified", "Archived", "Suppressed", "Deleted")
CONTINUITY_STATES = ("Open", "Resolved", "Superseded", "Abandoned")
HISTORICAL_STATES = ("Current", "Historical", "Superseded")
LINEAGE_KINDS = ("DerivedFrom", "ConsolidatedFrom", "Supersedes", "SupersededBy", "ConflictsWith")
CONFLICT_STATES = ("None", "PotentialConflict", "UnderReview", "Resolved", "Dismissed")
CONFLICT_RESOLUTIONS = ("None", "Accepted", "Rejected", "Superseded", "Merged")
AFFECT_PROVENANCE = ("Authored", "Imported", "Derived")
LIVE = ("Draft", "Active", "Verified")
UNRESOLVED = ("Open", "Abandoned")

EPISODE = (
    "struct<schema_version int, episode_id string, summary string, continuity_state string, actor_ids array<string>, goal string, outcome string, "
    "started_at_unix_ms long, ended_at_unix_ms long, last_active_unix_ms long, recurrence_key string, recurrence_interval_ms long, boundary_label string, "
    "previous_record_id string, next_record_id string, causal_record_ids array<string>, related_record_ids array<string>, linked_artifact_uris array<string>, "
    "salience struct<reuse_count int, novelty_score double, goal_relevance double, unresolved_weight double>, "
    "affective struct<tone string, sentiment string, urgency double, confidence double, tension double, provenance string>>"
).replace(" int", ": int").replace(" string", ": string").replace(" long", ": bigint").replace(" double", ": double").replace(" array<", ": array<").replace(" struct<", ": struct<")
LINEAGE = "array<struct<record_id: string, relation: string, confidence: double>>"
CONFLICT = "struct<state: string, conflicting_record_ids: array<string>, drift_score: double, resolution: string, resolved_by: string, resolved_at_unix_ms: bigint, note: string>"

#: Column name -> type, in order.
SCHEMA = {
    "id": "string", "tenant_id": "string", "namespace": "string", "actor_id": "string", "conversation_id": "string", "session_id": "string", "source": "string",
    "labels": "array<string>", "trust_level": "string", "kind": "string", "content": "string", "summary": "string", "source_id": "string", "metadata": "map<string,string>",
    "quality_state": "string", "created_at_unix_ms": "bigint", "updated_at_unix_ms": "bigint", "expires_at_unix_ms": "bigint", "importance_score": "double",
    "artifact": "struct<uri: string, media_type: string, checksum: string>", "episode": EPISODE, "historical_state": "string", "lineage": LINEAGE, "conflict": CONFLICT,
}
DDL = ", ".join(f"{k} {v}" for k, v in SCHEMA.items())

TENANT, BASE_MS, HOUR_MS = "acme", 1_704_067_200_000, 3_600_000


def conform(df: DataFrame, extra: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """df with exactly SCHEMA's columns and extra: missing ones null or their default, unknown ones dropped."""
    have = set(df.columns)
    default = {"labels": F.array().cast("array<string>"), "lineage": F.array().cast(LINEAGE), "trust_level": F.lit("Derived"), "historical_state": F.lit("Current"), "metadata": F.create_map().cast("map<string,string>")}
    cols = []
    for name, kind in SCHEMA.items():
        base = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        cols.append((F.coalesce(base, default[name]) if name in default else base).alias(name))
    return df.select(*cols, *extra)


def read_records(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Records from Parquet or JSON (one a line, or with multiLine documents); unknown fields are ignored, missing ones default."""
    reader = spark.read.schema(DDL) if form == "json" else spark.read
    return conform(reader.format(form).option("multiLine", form == "json").load(path))


FILTERS = "struct<episode_id: string, unresolved_only: boolean, temporal_order: string, historical_mode: string, lineage_record_id: string>"
CASE = f"struct<name: string, scenario: string, query_text: string, relevant_record_ids: array<string>, max_items: int, include_archived: boolean, filters: {FILTERS}>"


def camel(c: Column) -> Column:
    """snake_case -> CamelCase, as enumerations are written here."""
    return F.replace(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records with scenario, cases) of a JSON document that holds both as arrays; enumerations may be in snake_case."""
    fields = ", ".join(f"{k}: {v}" for k, v in SCHEMA.items())
    whole = spark.read.schema(f"records array<struct<{fields}, scenario: string>>, cases array<{CASE}>").option("multiLine", True).json(path)
    rows = whole.select(F.explode("records").alias("r")).select("r.*")
    lower = F.col("kind").rlike("^[a-z]")  # a corpus is written in one way
    rows = rows.withColumns({c: F.when(lower, camel(F.col(c))).otherwise(F.col(c)) for c in ("kind", "trust_level", "quality_state", "historical_state")})
    rows = rows.withColumn("lineage", F.transform("lineage", lambda x: x.withField("relation", F.when(x["relation"].rlike("^[a-z]"), camel(x["relation"])).otherwise(x["relation"]))))
    state = F.col("episode.continuity_state")
    rows = rows.withColumn("episode", F.when(F.col("episode").isNotNull(), F.col("episode").withField("continuity_state", F.when(state.rlike("^[a-z]"), camel(state)).otherwise(F.coalesce(state, F.lit("Open"))))))
    return conform(rows, ["scenario"]), whole.select(F.explode("cases").alias("c")).select("c.*")


def to_json() -> Column:
    """A record row as JSON text; from_json reads it back."""
    return F.to_json(F.struct(*SCHEMA))


def from_json(text: Column) -> Column:
    return F.from_json(text, f"struct<{', '.join(f'{k}: {v}' for k, v in SCHEMA.items())}>")


def episode(**fields: Column) -> Column:
    """An episode struct; fields not given take their defaults."""
    none = {n: F.lit(None) for n in ("summary", "goal", "outcome", "started_at_unix_ms", "ended_at_unix_ms", "last_active_unix_ms", "recurrence_key", "recurrence_interval_ms", "boundary_label", "previous_record_id", "next_record_id", "affective")}
    empty = F.array().cast("array<string>")
    default = {"schema_version": F.lit(1), "episode_id": F.lit(""), "continuity_state": F.lit("Open"), "actor_ids": empty, "causal_record_ids": empty, "related_record_ids": empty, "linked_artifact_uris": empty}
    default["salience"] = F.struct(F.lit(0).alias("reuse_count"), *[F.lit(0.0).alias(n) for n in ("novelty_score", "goal_relevance", "unresolved_weight")])
    given = none | default | fields
    names = [x.split(":")[0].strip() for x in _top_level(EPISODE)]
    return F.struct(*[given[n].alias(n) for n in names]).cast(EPISODE)


def _top_level(struct: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in struct[len("struct<") : -1]:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rid = lambda turn: F.concat(F.lit("conv-"), F.col("conv_id"), F.lit("-"), turn)
    t = t.withColumn("_prev", F.lag("turn").over(turns)).withColumn("_next", F.lead("turn").over(turns)).withColumn("_two", F.lag("turn", 2).over(turns))
    conv, turn = F.col("conv_id"), F.col("turn")
    at = F.lit(BASE_MS) + conv * HOUR_MS + turn * 60_000
    said = F.concat(F.lit("c"), conv)
    one = lambda c: F.array_compact(F.array(c))
    ep = episode(
        episode_id=said, continuity_state=F.get(F.array(*map(F.lit, CONTINUITY_STATES)), (conv % 4).cast("int")), actor_ids=F.array(F.concat(F.lit("u"), conv % 10)), goal=F.concat(F.lit("answer "), F.col("role")),
        started_at_unix_ms=F.lit(BASE_MS) + conv * HOUR_MS, last_active_unix_ms=at, recurrence_key=F.when(conv % 5 == 0, "weekly"), recurrence_interval_ms=F.when(conv % 5 == 0, F.lit(604_800_000)),
        boundary_label=F.when(turn == 0, "handoff"), previous_record_id=rid(F.col("_prev")), next_record_id=rid(F.col("_next")), causal_record_ids=one(rid(F.col("_two"))),
        related_record_ids=one(F.when((turn == 0) & (conv > 0), F.concat(F.lit("conv-"), conv - 1, F.lit("-0")))),
        salience=F.struct(turn.cast("int").alias("reuse_count"), ((conv % 10) / 10).alias("novelty_score"), F.lit(0.5).alias("goal_relevance"), F.lit(0.25).alias("unresolved_weight")),
        affective=F.struct(F.lit("calm").alias("tone"), F.lit("neutral").alias("sentiment"), F.lit(0.2).alias("urgency"), F.lit(1.0).alias("confidence"), F.lit(0.1).alias("tension"), F.lit("Authored").alias("provenance")),
    )
    clash = F.struct(
        F.get(F.array(*map(F.lit, CONFLICT_STATES)), (conv % 5).cast("int")).alias("state"), F.array(rid(turn - 1)).alias("conflicting_record_ids"), F.lit(0.3).alias("drift_score"),
        F.when(conv % 5 >= 3, "Accepted").otherwise("None").alias("resolution"), F.lit(None).alias("resolved_by"), F.lit(None).alias("resolved_at_unix_ms"), F.lit(None).alias("note"),
    )
    return conform(t.select(
        rid(turn).alias("id"), F.lit(TENANT).alias("tenant_id"), F.lit("chat").alias("namespace"), F.concat(F.lit("u"), conv % 10).alias("actor_id"), said.alias("conversation_id"), F.concat(F.lit("s"), conv % 3).alias("session_id"),
        F.col("role").alias("source"), F.array(F.lit("chat"), F.col("role")).alias("labels"),
        F.when(F.col("role") == "system", "Verified").when(F.col("role") == "user", "Observed").otherwise("Derived").alias("trust_level"),
        F.lit("Episodic").alias("kind"), F.coalesce("text", F.lit("")).alias("content"), F.when(turn % 7 == 6, "Draft").when((conv % 17 == 3) & (turn == 1), "Archived").otherwise("Active").alias("quality_state"),
        (at - conv % 5 * 12 * HOUR_MS).alias("created_at_unix_ms"), at.alias("updated_at_unix_ms"), F.when(conv % 13 == 0, at + 10 * HOUR_MS).alias("expires_at_unix_ms"), ((turn % 5) / 5).alias("importance_score"),
        ep.alias("episode"), F.when((conv % 11 == 0) & (turn == 1), "Superseded").when((conv % 7 == 0) & (turn == 2), "Historical").otherwise("Current").alias("historical_state"),
        F.when(turn == 1, F.array(F.struct(rid(F.lit(0)).alias("record_id"), F.lit("DerivedFrom").alias("relation"), F.lit(0.8).alias("confidence")))).otherwise(F.array().cast(LINEAGE)).alias("lineage"),
        F.when(turn == 2, clash).cast(CONFLICT).alias("conflict"),
    ))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    d = d.join(labels, "doc_id", "left")
    at = F.lit(BASE_MS) + F.col("doc_id") * 60_000
    return conform(d.select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"), F.lit(TENANT).alias("tenant_id"), F.coalesce("lang", F.lit("und")).alias("namespace"), F.coalesce("source", F.lit("unknown")).alias("actor_id"),
        F.coalesce("source", F.lit("unknown")).alias("source"), F.array(F.lit("doc"), F.coalesce("lang", F.lit("und"))).alias("labels"),
        F.when(F.col("quality") == 1, "Verified").when(F.col("quality") == 0, "Untrusted").otherwise("Derived").alias("trust_level"), F.lit("Fact").alias("kind"), F.coalesce("text", F.lit("")).alias("content"),
        F.when(F.col("toxic") == 1, "Suppressed").otherwise("Active").alias("quality_state"), at.alias("created_at_unix_ms"), at.alias("updated_at_unix_ms"),
        F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("importance_score"),
    ))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts", "value", "props")
    rid = lambda c: F.concat(F.lit("evt-"), c)
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("_prev", F.lag("event_id").over(by_user)).withColumn("_next", F.lead("event_id").over(by_user))
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    ep = episode(
        episode_id=F.concat(F.lit("u"), "user_id"), continuity_state=F.when(F.col("event_type") == "error", "Open").otherwise("Resolved"), previous_record_id=rid(F.col("_prev")), next_record_id=rid(F.col("_next"))
    )
    return conform(e.select(
        rid(F.col("event_id")).alias("id"), F.lit(TENANT).alias("tenant_id"), F.lit("events").alias("namespace"), F.concat(F.lit("u"), "user_id").alias("actor_id"), F.col("event_type").alias("source"),
        F.array(F.col("event_type")).alias("labels"), F.lit("Observed").alias("trust_level"), F.lit("Episodic").alias("kind"), F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))).alias("content"),
        F.lit("Active").alias("quality_state"), at.alias("created_at_unix_ms"), at.alias("updated_at_unix_ms"), F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 500)), F.lit(0.0)).alias("importance_score"), ep.alias("episode"),
    ))


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sources together; a filter on namespace reaches their scans."""
    return chat_records(spark, sf_dir).unionByName(document_records(spark, sf_dir)).unionByName(event_records(spark, sf_dir))


def violations(now_required_key: bool = False, require_labels: bool = False) -> Column:
    """array<string> of the write-time rules that a record row breaks, in the order they are checked; empty if it is fine."""
    c = F.col
    blank = lambda x: x.isNull() | (trimmed(x) == "")
    blank_if_there = lambda x: x.isNotNull() & (trimmed(x) == "")
    outside = lambda x: x.isNotNull() & ~x.between(0.0, 1.0)
    e, a, k = c("episode"), c("episode.affective"), c("conflict")
    there = e.isNotNull()
    start, end, last = e["started_at_unix_ms"], e["ended_at_unix_ms"], e["last_active_unix_ms"]
    self_in = lambda ids: F.coalesce(F.array_contains(ids, c("id")), F.lit(False))
    rules = {
        "id": blank(c("id")), "tenant_id": blank(c("tenant_id")), "namespace": blank(c("namespace")), "actor_id": blank(c("actor_id")),
        "content": blank(c("content")) & c("artifact").isNull(), "importance_score": c("importance_score").isNull() | outside(c("importance_score")),
        "episode.schema_version": there & (e["schema_version"] != 1), "episode.episode_id": there & blank(e["episode_id"]), "episode.previous_record_id": e["previous_record_id"] == c("id"),
        "episode.next_record_id": e["next_record_id"] == c("id"), "episode.causal_record_ids": self_in(e["causal_record_ids"]), "episode.related_record_ids": self_in(e["related_record_ids"]),
        "episode.ended_before_started": end < start, "episode.last_active_before_started": last < start, "episode.last_active_after_ended": last > end,
        "episode.recurrence_key": blank_if_there(e["recurrence_key"]), "episode.boundary_label": blank_if_there(e["boundary_label"]), "episode.recurrence_interval_ms": e["recurrence_interval_ms"] == 0,
        "episode.interval_without_key": e["recurrence_interval_ms"].isNotNull() & e["recurrence_key"].isNull(), "episode.actor_ids": there & (F.size(e["actor_ids"]) > 0) & ~F.array_contains(e["actor_ids"], c("actor_id")),
        "affective.tone": blank_if_there(a["tone"]), "affective.sentiment": blank_if_there(a["sentiment"]), "affective.urgency": outside(a["urgency"]), "affective.confidence": outside(a["confidence"]),
        "affective.tension": outside(a["tension"]), "affective.derived_confidence": (a["provenance"] == "Derived") & (a["confidence"] >= 1.0), "conflict.drift_score": outside(k["drift_score"]),
        "conflict.blank_id": F.exists(k["conflicting_record_ids"], blank), "conflict.self": self_in(k["conflicting_record_ids"]), "conflict.resolved_by": blank_if_there(k["resolved_by"]), "conflict.note": blank_if_there(k["note"]),
        "conflict.resolution": k["state"].isin("Resolved", "Dismissed") & (k["resolution"] == "None"),
    }
    if now_required_key:
        rules["idempotency_key"] = c("idempotency_key").isNull()
    if require_labels:
        rules["labels"] = F.size(c("labels")) == 0
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))
