"""Connected components of a link table, by least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, durable


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the least id that links reach.

    Each round, a node takes the least label of its neighbours and then its label's label, so
    chains halve; labels are written each round, no link leaves the executors. Duplicate
    links and links to oneself are harmless; an empty table gives an empty result.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "theirs").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("next"))
        new = lower.join(jump, "low", "left").select("id", F.least("low", F.coalesce("next", "low")).alias("label"), (F.least("low", F.coalesce("next", "low")) != F.col("label")).alias("moved"))
        new = durable(new, "labels")
        discard(links.sparkSession, last)
        last, labels = new, new.select("id", "label")
        if new.filter("moved").isEmpty():
            discard(links.sparkSession, both)
            return labels.withColumnRenamed("label", "component")
