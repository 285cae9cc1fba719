"""Connected components of links, as a Spark loop: nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators.joins import HEAVY_ROWS, join_sized
from lociq.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every end of the links (a, b): the smallest id it reaches.

    Labels fall to the least label among neighbours and then to the label of
    that label, until none changes. Nodes with very many neighbours, and labels of very many
    nodes, are salted (``join_sized``). An empty table gives an empty table; repeated links and loops are harmless.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("a", "b"))
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component_id"), F.count("*").alias("degree")))
    nodes, most = labels.agg(F.count("*"), F.coalesce(F.max("degree"), F.lit(0))).first()
    while nodes:
        told = join_sized(both, labels.withColumnRenamed("id", "b"), ["b"], "degree", most=most).groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("told"))
        lower = labels.join(told, "id").select("id", F.least("component_id", "told").alias("near"), F.col("component_id").alias("old"), "degree")
        jump = labels.select(F.col("id").alias("near"), F.col("component_id").alias("far"))
        if nodes > HEAVY_ROWS:
            lower = cut_lineage(lower)
            jump = jump.join(lower.groupBy("near").agg(F.count("*").alias("rows")), "near")
            lower = join_sized(lower, jump, ["near"], "rows", most=nodes)
        else:
            lower = lower.join(jump, "near")
        after = cut_lineage(lower.select("id", F.least("near", "far").alias("component_id"), "old", "degree"))
        labels = after.select("id", "component_id", "degree")
        if after.where("component_id <> old").isEmpty():
            break
    return labels.drop("degree")
