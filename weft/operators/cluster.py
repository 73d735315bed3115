"""Nodes and membership edges of a computed partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.derive import cohesion, community_names


def community_nodes(graph: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, members, label, cohesion, place) of the communities of two or more, the largest first; ``members`` is (id, community)."""
    size = members.groupBy("community").agg(F.count("*").alias("members")).where("members > 1")
    kept = members.join(size.select("community"), "community", "left_semi").select("id", "community")
    names = community_names(kept.join(nodes.select("id", "name", "filePath"), "id").select("community", "name", "filePath"))
    out = size.join(names, "community", "left").join(cohesion(graph, kept), "community", "left")
    numbered = out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("members"), "community")))  # a row a community
    return numbered.select(F.concat(F.lit("comm_"), F.col("place") - 1).alias("id"), "community", "members", "label", "cohesion", F.col("place").cast("long").alias("place"))


def membership_edges(members: DataFrame) -> DataFrame:
    """(src, dst, type) of each node to its community, those of one node too."""
    return members.select(F.col("id").alias("src"), F.concat(F.lit("comm_"), "community").alias("dst"), F.lit("MEMBER_OF").alias("type"))
