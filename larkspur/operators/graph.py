"""The typed record graph: edges, inspection, and expansion from a set of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import per_mille
from ..sources.shared import durable
from .filters import admin_scope, visible_in_graph

# What a relation to the frontier is worth, in the order of reasons.
RELATIONS = {"episode": 0.45, "chronology": 0.35, "causal": 0.32, "related": 0.24, "lineage": 0.28}
PER_RELATION, PER_HOP = 0.04, 0.08


def links(records: DataFrame) -> DataFrame:
    """(id, relation, target) from each record to the records (or the episode) it names; what expansion follows."""
    e = F.col("episode")
    one = lambda kind, x: F.when(x.isNotNull(), F.array(F.struct(F.lit(kind).alias("relation"), x.alias("target"))))
    many = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("relation"), x.alias("target")))
    parts = [
        one("episode", F.when(e["episode_id"] != "", F.concat(F.lit("episode:"), e["episode_id"]))), one("chronology", e["previous_record_id"]), one("chronology", e["next_record_id"]),
        many("causal", e["causal_record_ids"]), many("related", e["related_record_ids"]), many("lineage", F.col("lineage.record_id")),
    ]
    none = F.array().cast("array<struct<relation:string,target:string>>")
    return records.select("id", F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("x")).select("id", "x.relation", "x.target").distinct()


def expand(records: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """Records that the graph reaches from seeds within max_hops, with graph (the bonus) and relation_reasons.

    records are already filtered; a candidate is found through its own links to the
    frontier, and a hop's finds are the next hop's frontier. One join a hop; the
    frontier is never collected. An episode counts as reached when a member of it is.
    """
    edges = links(records)
    members = records.filter("episode.episode_id <> ''").select("id", F.concat(F.lit("episode:"), "episode.episode_id").alias("episode"))
    found = seeds.select("id")
    frontier, out = found, None
    for hop in range(1, max_hops + 1):
        goals = frontier.select(F.col("id").alias("target")).union(members.join(frontier, "id", "left_semi").select("episode")).distinct()
        fresh = edges.join(goals, "target", "left_semi").join(found, "id", "left_anti")
        weight = F.lit(0.0)
        for kind, w in RELATIONS.items():
            weight = F.when(F.col("relation") == kind, w).otherwise(weight)
        scored = fresh.groupBy("id").agg(F.max(weight).alias("best"), F.collect_set("relation").alias("kinds"))
        bonus = F.col("best") + PER_RELATION * (F.size("kinds") - 1) - PER_HOP * (hop - 1)
        order = F.array(*map(F.lit, RELATIONS))
        reasons = F.transform(F.filter(order, lambda k: F.array_contains("kinds", k)), lambda k: F.concat(F.lit("graph_relation="), k))
        step = scored.select("id", F.greatest(F.lit(0.0), bonus).alias("graph"), F.concat(reasons, F.array(F.lit(f"graph_hop={hop}"))).alias("relation_reasons"), F.lit(hop).alias("hop")).filter("graph > 0")
        step = durable(step, "hop")  # the next hop uses it several times
        out = step if out is None else out.unionByName(step)
        frontier = step.select("id")
        found = found.union(frontier)
    empty = records.select("id", F.lit(0.0).alias("graph"), F.array().cast("array<string>").alias("relation_reasons"), F.lit(0).alias("hop")).limit(0)
    return records.join(out if out is not None else empty, "id")


def inspected_nodes(records: DataFrame, max_nodes: int | None = None, tenant_id: str | None = None, namespace: str | None = None, archived: bool = False, suppressed: bool = False, deleted: bool = False, **scope: str | None) -> DataFrame:
    """Records an inspection shows: the first max_nodes by id."""
    shown = records.filter(admin_scope(tenant_id, namespace, **scope) & visible_in_graph(archived, suppressed, deleted))
    return shown.orderBy("id").limit(max_nodes) if max_nodes is not None else shown


def truncated(records: DataFrame, max_nodes: int | None, **scope) -> DataFrame:
    """One row: records that an inspection scans, nodes that it shows, and whether more would be shown without max_nodes."""
    shown = inspected_nodes(records, None, **scope).agg(F.count("*").alias("n"))
    most = F.lit(max_nodes if max_nodes is not None else (1 << 62))
    return records.agg(F.count("*").alias("total_records_scanned")).join(F.broadcast(shown)).select("total_records_scanned", F.least("n", most).cast("long").alias("nodes"), (F.col("n") > most).alias("truncated"))


def inspected_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, kind, details) among nodes; edges to episodes are always there. Repeats of (src, dst, kind) are one edge, the first in place."""
    e, k = F.col("episode"), F.col("conflict")
    none = F.array().cast("array<string>")
    edge = lambda dst, kind, details=none, place=0: F.struct(dst.alias("dst"), F.lit(kind).alias("kind"), details.alias("details"), F.lit(place).alias("place"))
    one = lambda there, x: F.when(there, F.array(x))
    parts = [
        one(e["episode_id"] != "", edge(F.concat(F.lit("episode:"), e["episode_id"]), "EpisodeMembership", F.array(F.concat(F.lit("continuity_state="), e["continuity_state"])))),
        one(e["previous_record_id"].isNotNull(), edge(e["previous_record_id"], "ChronologyPrevious")),
        one(e["next_record_id"].isNotNull(), edge(e["next_record_id"], "ChronologyNext")),
        F.transform(e["causal_record_ids"], lambda x: edge(x, "Causal")),
        F.transform(e["related_record_ids"], lambda x: edge(x, "Related")),
        F.transform("lineage", lambda x, i: F.struct(x["record_id"].alias("dst"), F.lit("Lineage").alias("kind"), F.array(F.concat(F.lit("relation="), x["relation"]), F.concat(F.lit("confidence_per_mille="), per_mille(x["confidence"]))).alias("details"), i.alias("place"))),
        F.transform(k["conflicting_record_ids"], lambda x: edge(x, "Conflict", F.array(F.concat(F.lit("state="), k["state"]), F.concat(F.lit("resolution="), k["resolution"])))),
    ]
    empty = F.array().cast("array<struct<dst:string,kind:string,details:array<string>,place:int>>")
    edges = nodes.select(F.col("id").alias("src"), F.explode(F.concat(*[F.coalesce(p, empty) for p in parts])).alias("x")).select("src", "x.*").filter("src <> dst")
    edges = edges.groupBy("src", "dst", "kind").agg(F.min(F.struct("place", "details")).alias("m")).select("src", "dst", "kind", "m.details")
    ids = nodes.select(F.col("id").alias("dst")).distinct()
    inner = edges.filter("kind <> 'EpisodeMembership'").join(ids, "dst", "left_semi")
    return edges.filter("kind = 'EpisodeMembership'").unionByName(inner)
