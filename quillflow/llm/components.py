"""Connected components of an edge table by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); label is the least node of its component.

    Each round a node takes the least label among itself and its neighbours, then the label of
    that label; the number of rounds grows with the logarithm of a component's diameter for
    trees and stars. Every round is written to the shared folder. Joins on a hub are plain
    sort-merge joins that adaptive execution may split; minima are combined before the shuffle.
    An empty edge table gives an empty result.
    """
    ab = edges.select("a", "b")
    both = stored(
        ab.union(ab.select("b", "a")).union(ab.select("a", "a")).union(ab.select("b", "b"))
        .toDF("a", "b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    total = _sum(labels)
    while True:
        near = stored(
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label")), "near")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(near.join(jump, "label").select("node", F.col("next").alias("label")), "labels")
        before, total = total, _sum(labels)
        if total == before:  # labels only ever fall, so an equal sum means no change
            return labels


def _sum(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
