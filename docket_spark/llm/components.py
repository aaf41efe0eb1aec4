"""Connected components of a link table, by hooking to the smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket_spark.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (columns a, b) to (node, root), root being the smallest node reachable.

    Every round takes per label the smallest label next to it, follows these pointers to their ends by
    doubling, and relabels the nodes. Half of the labels that still meet another go in each round, so
    rounds, and steps in a round, grow with the logarithm only. The rounds end when no link joins two
    labels. Nothing is gathered: a frequent node is one
    row after partial aggregation, and joins on it have one row on the label side, so that adaptive
    execution can split the other. Each round is written to the checkpoint folder.
    """
    links = cut_lineage(links.where("a <> b").distinct())
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = ends.withColumn("root", F.col("node"))
    between = links.select("a", "b")
    while not between.isEmpty():
        beside = between.union(between.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = (
            beside.groupBy(F.col("a").alias("root"))
            .agg(F.min("b").alias("low"))
            .select("root", F.least("root", "low").alias("next"))
        )
        moved = True
        while moved:
            further = hooked.select(F.col("root").alias("next"), F.col("next").alias("beyond"))
            jumped = cut_lineage(
                hooked.select("root", "next").join(further, "next", "left").select(
                    "root",
                    F.coalesce("beyond", "next").alias("next"),
                    (F.coalesce("beyond", "next") != F.col("next")).alias("moved"),
                )
            )
            moved = not jumped.where("moved").isEmpty()
            hooked = jumped.drop("moved")
        labels = cut_lineage(
            labels.join(hooked, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")
            )
        )
        of_a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        # A link whose ends have one label stays so: only the others are looked at again.
        links = cut_lineage(
            links.select("a", "b").join(of_a, "a").join(of_b, "b").where("ra <> rb")
        )
        between = links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    return labels
