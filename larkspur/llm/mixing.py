"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

A token budget goes down the tree by weights. Each node can take the tokens below it,
times the epochs allowed; what a node can't take goes to its siblings by their weights
before an ancestor's siblings see any of it. Allocation is one window pass a level:
with children sorted by capacity for a unit of weight, the ones that fill up come
first. All amounts are whole tokens; a division's remainder (less than one token a
child) stays unspent.

Each leaf then takes the token prefix of its own budget from epoch after epoch, every
epoch being the leaf's documents in an order drawn from md5(seed, epoch, id). Prefix
sums are worked out in slices of that order, so a leaf with a third of all rows is
spread over SLICES tasks.

Cases: null text has no tokens; a document without tokens is never taken; null
language or source count as ''. A repeated row is taken as often as it is there. A
child without a weight in the table gets DEFAULT_WEIGHT, and 0 excludes it. Documents with one id go side by side, and those
with a null id as one more id. A long text is cut at its leaf's budget like any other; extra columns are not read, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import durable
from .common import WORD, table, text_of

LEVELS = ("domain", "lang", "source")
#: Slices of a leaf's order: 16 ** DIGITS.
DIGITS = 3
DEFAULT_WEIGHT = 1
SEED = 17
#: The production mix: domains by the last digit of the source's number, languages next, sources alike.
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "forum": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}, "source": {}}
DOMAINS = ("web", "books", "code", "forum")
#: Share of all tokens that op4 asks for, and how often it may use a document.
SHARE_PERCENT, EPOCHS = 80, 2


def domain_of(source: Column) -> Column:
    """The production rule for a source's domain: its number modulo the domains; 'web' without a number."""
    k = F.pmod(F.coalesce(F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)), F.lit(len(DOMAINS)))
    return F.get(F.array(*[F.lit(x) for x in DOMAINS]), k.cast("int"))


def weight_of(level: str, weights: dict) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, int(w)).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent..., name, cap, weight, budget of the parent) with alloc: budget shared by weight, no child over cap."""
    up = [F.col(x) for x in parent] or [F.lit(0)]
    kids = children.filter("cap > 0 and weight > 0")
    order = Window.partitionBy(*up).orderBy(F.col("cap") / F.col("weight"), name)
    to, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    kids = kids.withColumn("_before", F.coalesce(F.sum("cap").over(to), F.lit(0))).withColumn("_weight_on", F.sum("weight").over(on))
    wide = lambda x: F.col(x).cast("decimal(38,0)")
    kids = kids.withColumn("_full", wide("cap") * wide("_weight_on") <= wide("weight") * (wide("budget") - wide("_before")))
    every = Window.partitionBy(*up)
    kids = kids.withColumn("_used", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(every)).withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(every))
    part = F.floor(F.expr("cast(weight as decimal(18,0)) * cast(budget - _used as decimal(19,0)) div _open")).cast("long")
    return kids.withColumn("alloc", F.when(F.col("_full"), F.col("cap")).otherwise(part)).drop("_before", "_weight_on", "_full", "_used", "_open")


def leaf_budgets(leaves: DataFrame, total: int, weights: dict, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens) of leaves with leaf_budget."""
    nodes = leaves.select(*LEVELS, "tokens", (F.col("tokens") * epochs).alias("cap"))
    budgets = None
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        kids = nodes.groupBy(*parent, level).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weight_of(level, weights))
        kids = kids.withColumn("budget", F.lit(int(total)).cast("long")) if budgets is None else kids.join(budgets, parent)
        kids = share_out(kids, parent, level)
        budgets = kids.select(*parent, level, F.col("alloc").alias("budget"))
    return kids.select(*LEVELS, "tokens", F.col("alloc").alias("leaf_budget"))


def measured(docs: DataFrame, id_col: str, domain=domain_of) -> DataFrame:
    """(_id, domain, lang, source, n_tokens) of each row; tokens are words."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("_source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("n_tokens"))
    return rows.select("_id", domain(F.col("_source")).alias("domain"), "lang", F.col("_source").alias("source"), "n_tokens")


def mix(docs: DataFrame, weights: dict, share_percent: int, epochs: int = 1, seed: int = SEED, id_col: str = "doc_id", domain=domain_of) -> DataFrame:
    """One row for each document and epoch taken: id_col, epoch, domain, lang, source, n_tokens, take_tokens, leaf_budget."""
    rows = durable(measured(docs, id_col, domain), "measured")
    leaves = durable(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, total * share_percent // 100, weights, epochs)
    drawn = rows.filter("n_tokens > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    drawn = drawn.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.col("_id").cast("string")).cast("binary")))
    drawn = drawn.withColumn("_slice", F.substring("_order", 1, DIGITS))
    slot = [*LEVELS, "epoch", "_slice"]
    inside = Window.partitionBy(*slot).orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("_within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    slices = rows.filter("n_tokens > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    slices = slices.withColumn("_slice", F.substring(F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.col("_id").cast("string")).cast("binary")), 1, DIGITS))
    slices = slices.groupBy(*slot).agg(F.sum("n_tokens").alias("_sum"))
    ahead = Window.partitionBy(*LEVELS, "epoch").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).join(budgets, list(LEVELS))
    of_epoch = F.least(F.greatest(F.col("leaf_budget") - F.col("epoch") * F.col("tokens"), F.lit(0)), F.col("tokens"))
    slices = slices.withColumn("_left", of_epoch - F.col("_ahead")).filter("_left > 0").select(*slot, "_left", "leaf_budget")
    taken = drawn.join(slices, slot).filter("_within < _left")
    return taken.select(
        F.col("_id").alias(id_col), F.col("epoch").cast("int").alias("epoch"), *LEVELS, "n_tokens", F.least("n_tokens", F.col("_left") - F.col("_within")).alias("take_tokens"), "leaf_budget"
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, SHARE_PERCENT, EPOCHS)


def _level_sql(depth: int) -> str:
    up = ", ".join(LEVELS[:depth])
    by = f"PARTITION BY {up}" if up else ""
    level = LEVELS[depth]
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    weight = f"CASE {level} {cases} ELSE {DEFAULT_WEIGHT} END" if cases else str(DEFAULT_WEIGHT)
    cols = ", ".join(LEVELS[: depth + 1])
    budget = f"(SELECT (sum(tokens) * {SHARE_PERCENT}) // 100 FROM leaves)" if not depth else "b.alloc"
    join = f"JOIN level{depth - 1} b USING ({up})" if depth else ""
    return f"""
kids{depth} AS (
  SELECT k.*, {weight} AS weight, CAST({budget} AS HUGEINT) AS budget
  FROM (SELECT {cols}, CAST(sum(tokens) AS HUGEINT) * {EPOCHS} AS cap FROM leaves GROUP BY {cols}) k {join}
),
marks{depth} AS (
  SELECT *, cap * sum(weight) OVER ({by} ORDER BY cap / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= weight * (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM kids{depth} WHERE cap > 0 AND weight > 0
),
level{depth} AS (
  SELECT {cols}, CASE WHEN is_full THEN cap ELSE weight * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}))
           // sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) END AS alloc
  FROM marks{depth}
)"""


ORACLE = f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INTEGER), 0) % 4
           WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'forum' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM rows_ GROUP BY ALL),
{",".join(_level_sql(d) for d in range(3))},
drawn AS (
  SELECT r.*, e.epoch, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch
           ORDER BY md5(concat_ws(':', {SEED}, epoch, doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
  FROM rows_ r, (SELECT unnest(range({EPOCHS})) AS epoch) e WHERE n_tokens > 0
)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(least(n_tokens, left_ - start_) AS BIGINT) AS take_tokens, CAST(alloc AS BIGINT) AS leaf_budget
FROM (SELECT d.*, l.alloc, least(greatest(l.alloc - d.epoch * v.tokens, 0), v.tokens) AS left_
      FROM drawn d JOIN level2 l USING (domain, lang, source) JOIN leaves v USING (domain, lang, source))
WHERE start_ < left_
"""
