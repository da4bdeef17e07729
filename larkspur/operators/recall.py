"""Recall: filter, seed, expand, order, select under a token budget, explain; one query or many at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import graph
from .filters import filtered, temporal_anchor
from .scoring import PARTS, Engine, Query, contextual, seeds


def candidates(records: DataFrame, q: Query, e: Engine) -> DataFrame:
    """Every candidate of the query with its score's parts."""
    kept = filtered(records, q.scope, q.filters, q.now_ms)
    found = seeds(kept, q, e)
    if e.planning_for(q) == "FastPath" or e.max_hops == 0:
        return found
    reached = graph.expand(kept, found, e.max_hops).drop("hop")
    return found.unionByName(contextual(reached, q, e))


def order_key(q: Query) -> Column:
    """A struct that sorts ascending in the query's order; ids break ties."""
    anchor = temporal_anchor()
    parts = [-F.col("total")]
    if q.temporal_order == "ChronologicalAsc":
        parts = [anchor, *parts]
    elif q.temporal_order == "ChronologicalDesc":
        parts = [-anchor, *parts]
    elif q.blank:
        parts = [-anchor, -F.col("importance_score")]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)], F.col("id"))


def within_budget(sized: DataFrame, budget: int, max_items: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ids a greedy walk takes: the first always, then each that fits what is left, at most max_items; with selection_rank.

    sized has order (ascending), id and tokens. Of rows with the same number of tokens only the first
    max_items can ever be taken, and rows over the budget only as the very first, so the
    walk folds over budget x max_items rows at most, however many candidates there are.
    """
    fold = F.expr(
        f"""aggregate(items, named_struct('left', cast({int(budget)} as bigint), 'ids', cast(array() as array<string>)),
            (s, x) -> if(size(s.ids) < {int(max_items)} and (size(s.ids) = 0 or x.tokens <= s.left),
                         named_struct('left', greatest(s.left - x.tokens, 0L), 'ids', array_append(s.ids, x.id)), s), s -> s.ids)"""
    )
    best = sized.groupBy(*keys).agg(F.min_by(F.struct("order", "id", "tokens"), "order").alias("b")).filter(F.col("b.tokens") > budget).select(*keys, "b.*")
    alike = Window.partitionBy(*keys, "tokens").orderBy("order")
    able = sized.filter(F.col("tokens") <= budget).withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= max_items).select(*keys, "order", "id", "tokens")
    walk = able.unionByName(best).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("order", "id", "tokens"))).alias("items"))
    return walk.select(*keys, F.posexplode(fold).alias("at", "id")).select(*keys, "id", (F.col("at") + 1).alias("selection_rank"))


def selected(found: DataFrame, q: Query) -> DataFrame:
    """(id, selection_rank) of what the query returns: no task sees more than its own first rows, or the budget's bounded walk."""
    sized = found.select(order_key(q).alias("order"), "id", text.approximate_tokens(F.col("content"), F.col("summary")).alias("tokens"))
    if q.token_budget is not None:
        return within_budget(sized, q.token_budget, q.max_items)
    return first_rows(sized, q.max_items, "selection_rank")


def first_rows(sized: DataFrame, n: int, name: str) -> DataFrame:
    top = sized.select("order", "id").orderBy("order").limit(n)
    return top.select("id", F.row_number().over(Window.orderBy("order")).alias(name))  # n rows at most


def recall(records: DataFrame, q: Query, e: Engine = Engine()) -> DataFrame:
    """The selected records: all record columns, score parts, rank from 1."""
    found = candidates(records, q, e)
    if q.token_budget is None:  # one pass: the rows themselves are the bounded sort's
        key = order_key(q)
        return found.orderBy(key).limit(q.max_items).withColumn("rank", F.row_number().over(Window.orderBy(key)))
    return found.join(F.broadcast(selected(found, q)), "id").withColumnRenamed("selection_rank", "rank")  # max_items rows


def channels(q: Query) -> Column:
    named = [("conflict", F.col("conflict").isNotNull()), *((k, F.col(k) > 0) for k in ("curation", "episodic"))]
    named += [("lexical", F.lit(not q.blank)), ("metadata", F.col("metadata_score") > 0), ("policy", F.lit(True)), ("salience", F.col("salience") > 0), ("semantic", F.col("semantic") > 0), ("temporal", F.lit(q.blank))]
    return F.array_compact(F.array(*[F.when(c, n) for n, c in named]))


def trace(records: DataFrame, q: Query, e: Engine = Engine()) -> DataFrame:
    """Why each candidate was selected or not."""
    found = candidates(records, q, e)
    taken = F.broadcast(selected(found, q))  # max_items rows
    first = F.broadcast(first_rows(found.select(order_key(q).alias("order"), "id"), q.max_items, "rank"))
    all_rows = found.join(taken, "id", "left").join(first, "id", "left")
    chosen = F.col("selection_rank").isNotNull()
    late = F.when(F.col("rank").isNull(), "max_items_exhausted")
    budget = F.lit("token_budget_exhausted" if q.token_budget is not None else None).cast("string")
    reasons = F.when(chosen, F.array(F.lit("retained"))).otherwise(F.array_compact(F.array(late, budget)))
    return all_rows.select(
        F.col("id").alias("record_id"), "kind", chosen.alias("selected"), "planner_stage", "candidate_sources", "relation_reasons", "selection_rank", "matched_terms", channels(q).alias("selected_channels"), reasons.alias("filter_reasons"),
        F.when(chosen, "selected_by_rank").otherwise("excluded_by_rank_or_budget" if q.token_budget is not None else "excluded_by_rank").alias("decision_reason"), *PARTS,
    )


# Notes of an explanation.
BACKEND_NOTE, BUDGET_NOTE = "initial_spark_backend_scoring", "token_budget_applied"


def explain(records: DataFrame, q: Query, e: Engine = Engine()) -> DataFrame:
    """One row for the whole answer: candidates examined, channels present in any of them, policy notes."""
    found = candidates(records, q, e)
    present = [F.coalesce(F.bool_or(F.col(c) > 0), F.lit(False)).alias(n) for n, c in (("semantic", "semantic"), ("metadata", "metadata_score"), ("episodic", "episodic"), ("salience", "salience"), ("curation", "curation"))]
    present.append(F.coalesce(F.bool_or(F.col("conflict").isNotNull()), F.lit(False)).alias("conflict"))
    row = found.agg(F.count("*").alias("total_candidates_examined"), *present)
    first = ["temporal", "policy"] if q.blank else ["lexical", "policy"]
    more = [F.when(F.col(n), n) for n in ("semantic", "metadata", "episodic", "salience", "curation", "conflict")]
    notes = [BACKEND_NOTE, f"scorer={e.scorer}", f"scoring_profile={e.scoring}", f"planning_profile={e.planning_for(q)}", f"policy_profile={e.policy}"]
    notes += [e.provider_note] if e.provider_note else []
    notes += [BUDGET_NOTE] if q.token_budget is not None else []
    return row.select("total_candidates_examined", F.array_compact(F.array(*map(F.lit, first), *more)).alias("selected_channels"), F.array(*map(F.lit, notes)).alias("policy_notes"))


def recall_many(records: DataFrame, queries: list[tuple[str, Query]], e: Engine = Engine()) -> DataFrame:
    """Recalls with filters, scorers, semantics and expansion of their own, in one job: query_id and recall()'s columns."""
    return reduce(DataFrame.unionByName, [recall(records, q, e).withColumn("query_id", F.lit(name)) for name, q in queries])


#: Queries whose terms one automaton holds; more of them are gone through in blocks.
BLOCK = 10_000


def recall_batch(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Many plain recalls in one job: queries (query_id, query_text, tenant_id, namespace); lexical and importance scores, top k of each.

    Queries go through in blocks of BLOCK, by a hash of their id. A block becomes one automaton of all its terms, which finds every term in one pass
    over a text however many there are; each task keeps its own top k of a query, so what is shuffled is k rows a query and
    task. A null text asks for nothing; a null importance counts as 0; repeated terms count each time.
    """
    spark = records.sparkSession
    terms = queries.filter("query_id is not null").select("query_id", "tenant_id", "namespace", text.tokens(text.ascii_lower(F.coalesce("query_text", F.lit("")))).alias("terms"))
    body = records.select("id", "tenant_id", "namespace", "importance_score", text.haystack(F.coalesce("content", F.lit("")), F.col("summary")).alias("hay"))
    blocks = -(-terms.count() // BLOCK)
    own = F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1)))
    found = [_scored_by_automaton(body, terms.filter(own == b).collect(), k) for b in range(blocks)]
    empty = spark.createDataFrame([], "query_id string, id string, lexical double, importance_score double, total double")
    best = Window.partitionBy("query_id").orderBy(F.desc("total"), "id")
    return reduce(DataFrame.unionByName, found, empty).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _scored_by_automaton(body: DataFrame, queries: list, k: int) -> DataFrame:
    ship = body.sparkSession.sparkContext.broadcast([(q["query_id"], (q["tenant_id"], q["namespace"]), q["terms"]) for q in queries])
    spaces = body.sparkSession.createDataFrame(sorted({(q["tenant_id"], q["namespace"]) for q in queries}), "tenant_id string, namespace string")
    names = ["query_id", "id", "lexical", "importance_score", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        asked = ship.value
        automata: dict[tuple, tuple] = {}
        for space in {s for _, s, _ in asked}:
            uses: dict[str, list[int]] = {}
            for i, (_, own, terms) in enumerate(asked):
                for t in terms if own == space else ():
                    uses.setdefault(t, []).append(i)
            machine = ahocorasick.Automaton()
            for n, t in enumerate(uses):
                machine.add_word(t, n)
            if uses:
                machine.make_automaton()
            automata[space] = machine, [np.array(u) for u in uses.values()]
        best: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, object)]  # query, lexical, importance, id
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for rid, tenant, space, importance, hay in zip(*(c.to_pylist() for c in batch.columns)):
                machine, uses = automata.get((tenant, space), (None, None))
                found = {n for _, n in machine.iter(hay)} if uses and hay else ()
                if not found:
                    continue
                query, count = np.unique(np.concatenate([uses[n] for n in found]), return_counts=True)
                for column, value in zip(rows, (query, count.astype(float), np.full(len(query), importance), np.full(len(query), rid, object))):
                    column.append(value)
            if rows[0]:
                best = [np.concatenate([old, *new]) for old, new in zip(best, rows)]
                order = np.lexsort((best[3].astype(str), -(best[1] + best[2]), best[0]))
                query = best[0][order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                best = [c[order][place < k] for c in best]
        ids = pa.array([asked[i][0] for i in best[0].tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([ids, pa.array(best[3].tolist(), pa.string()), pa.array(best[1]), pa.array(best[2]), pa.array(best[1] + best[2])], names=names)

    inside = body.join(F.broadcast(spaces), ["tenant_id", "namespace"], "left_semi").select("id", "tenant_id", "namespace", F.coalesce("importance_score", F.lit(0.0)).alias("importance_score"), "hay")
    return inside.mapInArrow(run, "query_id string, id string, lexical double, importance_score double, total double")
