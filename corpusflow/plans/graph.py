"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs -> (id, label), label being the smallest id that links reach.

    Nulls in an edge drop it; no edges give an empty table. Each round takes the least label of all
    neighbours (a map-side combined aggregate, so a hub of any degree is safe) and then the label of
    that label, which halves path lengths. Every round is a written table, so lineage stays short.
    """
    work = Scratch(spark, "components")
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = work.save(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = work.save(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels0")
    for k in range(1, max_rounds + 1):
        near = e.join(labels, e.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("hook"))
        up = labels.select(F.col("id").alias("hook"), F.col("label").alias("jump"))
        now = work.save(hooked.join(up, "hook").select("id", "old", F.least("hook", "jump").alias("label")), f"labels{k}")
        # The labels two rounds ago are read no more.
        if k > 1:
            work.drop(f"labels{k - 2}")
        if now.where("old <> label").isEmpty():
            work.drop("edges")
            return now.select("id", "label")
        labels = now.select("id", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
