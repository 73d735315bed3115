"""Graph patterns as joins: a pattern is a chain of node and edge steps, compiled to one plan that Catalyst orders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """From the node before, over an edge type, to a node: ``direction`` is out, in or both; ``label`` restricts the node."""

    edge: str | Sequence[str] | None
    direction: str = "out"
    label: str | Sequence[str] | None = None
    where: Column | None = None


def of_type(edges: DataFrame, types: str | Sequence[str] | None) -> DataFrame:
    if types is None:
        return edges
    return edges.where(F.col("type") == types) if isinstance(types, str) else edges.where(F.col("type").isin(*types))


def of_label(nodes: DataFrame, labels: str | Sequence[str] | None) -> DataFrame:
    if labels is None:
        return nodes
    return nodes.where(F.col("label") == labels) if isinstance(labels, str) else nodes.where(F.col("label").isin(*labels))


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (here, there): 'both' has each edge from either end, a self-loop once a direction."""
    out = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "type", "confidence", "step")
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "type", "confidence", "step")
    if direction == "out":
        return out
    if direction == "in":
        return back
    return out.unionByName(back)


def match(nodes: DataFrame, edges: DataFrame, start: str | Sequence[str] | None, steps: Sequence[Step], columns: Sequence[str] = ("name",)) -> DataFrame:
    """All bindings of a chain: n0_id, n0_<column>.., e1_type, e1_confidence, e1_step, n1_id, ...; label filters go to the scans."""

    def side(i: int, label) -> DataFrame:
        return of_label(nodes, label).select(F.col("id").alias(f"n{i}_id"), *[F.col(c).alias(f"n{i}_{c}") for c in columns])

    out = side(0, start)
    for i, step in enumerate(steps, 1):
        e = oriented(of_type(edges, step.edge), step.direction)
        if step.where is not None:
            e = e.where(step.where)
        e = e.select(F.col("here").alias(f"n{i - 1}_id"), F.col("there").alias(f"n{i}_id"), F.col("type").alias(f"e{i}_type"), F.col("confidence").alias(f"e{i}_confidence"), F.col("step").alias(f"e{i}_step"))
        out = out.join(e, f"n{i - 1}_id").join(side(i, step.label), f"n{i}_id")
    return out


def optional_lists(nodes: DataFrame, edges: DataFrame, keep: int = 3) -> DataFrame:
    """(id, outgoing, incoming): the first ``keep`` distinct named neighbours of each side as sorted text, '' where none.

    Each side is aggregated before it meets the nodes, so no product of both sides arises.
    """
    names = nodes.where("name is not null").select("id", "name")

    def side(here: str, there: str, out: str) -> DataFrame:
        e = edges.select(F.col(here).alias("id"), F.col(there).alias("other"), "type").join(names.select(F.col("id").alias("other"), "name"), "other")
        # distinct before the cut and the cut before the list, so that a hub gives a few rows a task and not all its neighbours
        e = top_n(e.select("id", F.concat_ws(":", "type", "name").alias("s")).distinct(), ["id"], [F.col("s")], keep)
        return e.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("s")), ",").alias(out))

    return nodes.select("id").join(side("src", "dst", "outgoing"), "id", "left").join(side("dst", "src", "incoming"), "id", "left").na.fill("", ["outgoing", "incoming"])


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (column id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def outside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that leave ``ids``: the source is one of them, the target isn't."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")


def top_n(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group by a total order; Spark keeps n rows a group and task before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
