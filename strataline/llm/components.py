"""Connected components of an edge table, with joins and partial sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) is connected with.

    Every node takes the least label among itself and its neighbours, and then
    the label of its label, until nothing changes; labels jump, so stars of
    stars and long chains need few rounds. A node with very many edges is
    summed in parts and its join partitions can be split. Each round's labels
    are a written table, so a lost executor repeats one round at most.
    """
    both = settle(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).filter(F.col("a") != F.col("b"))
                  .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")).filter(F.col("a") != F.col("b"))).distinct())
    labels = settle(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        now = settle(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("far"))
        now = settle(now.join(jump, "root", "left").select("node", "old", F.least("root", "far").alias("root")))
        if now.filter(F.col("old") != F.col("root")).limit(1).count() == 0:
            return now.select("node", "root")
        labels = now.select("node", "root")
