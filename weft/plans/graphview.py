"""The property graph over the test tables: nodes of all labels and the edges between them.

The tables hold repeated rows, so the graph is made once a session and table folder and kept in the shared checkpoint folder: nodes
by label, edges by type and in ranges of their source, and once more in ranges of their target. Queries read the labels and types they
ask for, and of a key only the files and row groups whose range holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.store import scratch, stamp
from weft.sources.tables import table

_KEPT: dict[tuple, str] = {}
_NODES = "id string, name string, filePath string, startLine long, endLine long, language string, isExported boolean, repo string, code boolean, label string"
_EDGES = "id string, src string, dst string, confidence double, reason string, step int, repo string, type string"


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A folder per label and per edge type, so that label and type filters prune whole folders; edges lie in ranges of
    their source, and once more of their target, so that keys prune files and row groups."""
    nodes.repartitionByRange("label", "id").sortWithinPartitions("label", "id").write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edges.repartitionByRange("type", "src", "dst").sortWithinPartitions("type", "src", "dst").write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
    edges.repartitionByRange("type", "dst", "src").sortWithinPartitions("type", "dst", "src").write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges_in")


def kept_graph(spark: SparkSession, sf: str) -> str:
    """The folder of the graph; made when it is first asked for, and again when the tables have changed."""
    names = ("parsed_nodes", "shared_nodes", "communities", "processes", "graph_relationships")
    key = (spark.sparkContext.applicationId, sf, *(stamp(spark, f"{sf}/{t}.parquet") for t in names))
    if key not in _KEPT:
        folder = scratch(spark, "graph")
        write_graph(_nodes(spark, sf), _edges(spark, sf), folder)
        _KEPT[key] = folder
    return _KEPT[key]


def first_rows(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The row of each key that comes first by ``order`` (unique); an aggregate with map-side part, no window."""
    rest = [c for c in columns if c not in (key, order)]
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r"))
    return picked.select(key, F.col(f"r.{order}").alias(order), *[F.col(f"r.{c}").alias(c) for c in rest])


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("label", "name", "filePath", "startLine", "endLine", "language", "isExported", "repo")
    out = first_rows(table(spark, sf, "parsed_nodes").select("id", "seq", *cols), "id", "seq", *cols).select("id", *cols, F.lit(True).alias("code"))
    out = out.unionByName(table(spark, sf, "shared_nodes").select("id", "label", "name", "filePath", "language", "isExported", F.lit(False).alias("code")), allowMissingColumns=True)
    for t, label in (("communities", "Community"), ("processes", "Process")):
        out = out.unionByName(table(spark, sf, t).select("id", F.lit(label).alias("label"), F.col("label").alias("name"), F.lit(False).alias("code")), allowMissingColumns=True)
    return out


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("sourceId", "targetId", "type", "confidence", "reason", "step", "repo")
    e = first_rows(table(spark, sf, "graph_relationships").select("id", "seq", *cols), "id", "seq", *cols)
    return e.where("sourceId is not null and targetId is not null").select("id", F.col("sourceId").alias("src"), F.col("targetId").alias("dst"), "type", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("step", F.lit(0)).alias("step"), "repo")


def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct code nodes (id, label, name, filePath, startLine, endLine, language, isExported, repo), first one wins."""
    return spark.read.schema(_NODES).parquet(f"{kept_graph(spark, sf)}/nodes").where("code").select("id", "label", "name", "filePath", "startLine", "endLine", "language", "isExported", "repo")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes with id, label, name, filePath, language, isExported, repo: code, shared library, communities, processes."""
    return spark.read.schema(_NODES).parquet(f"{kept_graph(spark, sf)}/nodes").select("id", "label", "name", "filePath", "language", "isExported", "repo")


def edges(spark: SparkSession, sf: str, by: str = "src") -> DataFrame:
    """Distinct edges (id, src, dst, type, confidence, reason, step, repo) with both ends, first one wins; null confidence 1.0.
    ``by`` is the end whose ranges the files hold."""
    e = spark.read.schema(_EDGES).parquet(f"{kept_graph(spark, sf)}/edges{'_in' if by == 'dst' else ''}")
    return e.select("id", "src", "dst", "type", "confidence", "reason", "step", "repo")
