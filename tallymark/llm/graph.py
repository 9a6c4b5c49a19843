"""Connected components of an undirected graph given as edges, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs to (node, label), label being the smallest node of the component.

    Each round a node takes the smallest among its neighbours' labels and the label of its
    label, so paths shorten by half or so; a round is three joins and an aggregation that
    merges before it moves rows. Labels are written after each round.
    Edges may repeat and may join a node with itself; nodes of any ordered type; NULL
    ends are dropped. No edges, no rows.
    """
    whole = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = whole.select("a", "b").unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(
            F.min("label").alias("near")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        lower = (
            labels.join(near, labels["node"] == near["a"])
            .join(jump, "label", "left")
            .select("node", F.col("label").alias("old"), F.least("label", "near", "next").alias("label"))
        )
        labels = written(lower, "labels")
        if labels.filter(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
