"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airstats.storage import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` for the ends of ``links`` (columns ``a`` and ``b``): nodes that links
    connect share a label, which is one of them.

    In each round every node joins the neighbour of the least hash, and the links between the joined
    nodes are what remains; as hashes are spread at random, that leaves a fraction of the nodes even
    of a chain. Every round is a stored table.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = stored(links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
                   .withColumn("label", F.col("node")), "nodes")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        ranked = F.struct(F.xxhash64("b").alias("rank"), F.col("b").alias("node"))
        own = F.struct(F.xxhash64("a").alias("rank"), F.col("a").alias("node"))
        least = stored(both.groupBy("a").agg(F.min(ranked).alias("best"))
                       .select(F.col("a").alias("from"), F.least("best", own)["node"].alias("to")), "least")
        nodes = stored(nodes.join(least, F.col("label") == F.col("from"), "left")
                       .select("node", F.coalesce("to", "label").alias("label")), "nodes")
        links = (links.join(least, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
                 .join(least, F.col("b") == F.col("from")).select("a", F.col("to").alias("b"))
                 .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links = stored(links, "links")
    return nodes
