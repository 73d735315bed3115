"""Level-synchronous reachability over edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.patterns import of_type, oriented
from weft.session import checkpointed

#: Most frontier rows that are broadcast; the ids are about a hundred bytes.
BROADCAST = 200_000


def reach(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", types: Sequence[str] | None = None, least: float = 0.0, skip: DataFrame | None = None) -> DataFrame:
    """(id, depth, via_type, via, confidence) of every node first met at depth 1..depth from ``starts`` (column id).

    A node is met once, at its least depth, by the first edge of (type, here). Start nodes are not in the result. Nodes of
    ``skip`` (column id) are never entered, so nothing is reached through them. Edges need a confidence of ``least``.
    Each level is cut by a checkpoint; the frontier is broadcast only while its counted size allows.
    """
    e = oriented(of_type(edges, types), direction).where(F.col("confidence") >= least).select("here", "there", "type", "confidence")
    if depth > 2:
        e = checkpointed(e)  # read at every level
    frontier = starts.select(F.col("id").alias("here")).distinct()
    seen = frontier.select(F.col("here").alias("there"))
    if skip is not None:
        seen = seen.unionByName(skip.select(F.col("id").alias("there")))
    levels = None
    for d in range(1, depth + 1):
        small = frontier.limit(BROADCAST + 1).count() <= BROADCAST
        met = e.join(F.broadcast(frontier) if small else frontier, "here").join(seen, "there", "left_anti")
        best = met.groupBy("there").agg(F.min(F.struct("type", "here", "confidence")).alias("m"))
        level = checkpointed(best.select(F.col("there").alias("id"), F.lit(d).alias("depth"), F.col("m.type").alias("via_type"), F.col("m.here").alias("via"), F.col("m.confidence").alias("confidence")))
        levels = level if levels is None else levels.unionByName(level)
        frontier = level.select(F.col("id").alias("here"))
        seen = seen.unionByName(level.select(F.col("id").alias("there")))
        if level.isEmpty():
            break
    return levels


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of an undirected graph given as (src, dst): the least id of the connected component.

    Alternates large-star and small-star steps, which end in a number of rounds logarithmic in the longest path and never
    gather more than a node's neighbours; a hub's neighbours are aggregated by minimum, not collected.
    """
    e = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        small = checkpointed(small.select("x.a", "x.b").where("a <> b").distinct())
        changed = not small.exceptAll(e).isEmpty() or not e.exceptAll(small).isEmpty()
        e = small
        if not changed:
            break
    return ids.join(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def paths(edges: DataFrame, starts: DataFrame, depth: int, branching: int = 4, least: int = 3) -> DataFrame:
    """(path, length): simple paths from ``starts`` over (src, dst), at most ``branching`` targets a node in order of dst.

    A path ends where no target is left that isn't on it, or at ``depth`` nodes; only paths of ``least`` nodes or more.
    """
    from weft.plans.patterns import top_n

    adj = top_n(edges.select("src", "dst").distinct(), ["src"], [F.col("dst")], branching, "k").select("src", "dst")
    live = starts.select(F.array("id").alias("path"), F.col("id").alias("tip"))
    done = None
    for d in range(1, depth):
        nxt = live.join(adj, live["tip"] == adj["src"], "left").where(F.col("dst").isNull() | ~F.array_contains("path", F.col("dst")))
        grown = checkpointed(nxt.where("dst is not null").select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("tip")))
        ended = live.join(grown.select(F.slice("path", 1, d).alias("path")).distinct(), "path", "left_anti").select("path")
        done = ended if done is None else done.union(ended)
        live = grown
        if grown.isEmpty():
            break
    done = live.select("path") if done is None else done.union(live.select("path"))
    return done.distinct().select("path", F.size("path").alias("length")).where(F.col("length") >= least)
