"""Structures derived from the graph: folders, communities, entry points, flows, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import GENERIC_FOLDERS, ancestors, capitalised, directory, framework_factor, is_test, name_factor
from weft.plans.patterns import top_n
from weft.session import checkpointed

SYMBOLS = ("Function", "Class", "Method", "Interface")


def structure(paths: DataFrame) -> DataFrame:
    """(src, dst) CONTAINS edges of the folders and files of distinct paths (column path)."""
    p = paths.select("path").distinct()
    folders = ancestors(F.col("path"))
    chain = F.when(F.instr("path", "/") == 0, F.array().cast("array<string>")).otherwise(folders)
    steps = p.select("path", chain.alias("f")).where(F.size("f") > 0)
    inner = steps.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("f")), lambda i: F.struct(F.element_at("f", i).alias("a"), F.when(i < F.size("f"), F.element_at("f", F.least(i + 1, F.size("f")))).alias("b"), F.col("path").alias("path")))).alias("x"))
    return inner.select(F.concat(F.lit("Folder:"), "x.a").alias("src"), F.when(F.col("x.b").isNotNull(), F.concat(F.lit("Folder:"), "x.b")).otherwise(F.concat(F.lit("File:"), "x.path")).alias("dst")).distinct()


def clustering_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) with src < dst: undirected CALLS, EXTENDS and IMPLEMENTS between symbols, no loops, no repeats."""
    symbols = nodes.where(F.col("label").isin(*SYMBOLS)).select("id")
    e = edges.where(F.col("type").isin("CALLS", "EXTENDS", "IMPLEMENTS") & (F.col("src") != F.col("dst")))
    e = e.join(symbols.select(F.col("id").alias("src")), "src", "left_semi").join(symbols.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def propagate_labels(graph: DataFrame) -> DataFrame:
    """(id, community): synchronous label propagation from the node's own id; the most frequent label of the neighbours and
    of the node itself wins, the least of equals. It goes on until nothing changes, or two states follow each other for
    ever, of which each node takes the lesser label. Deterministic; a stand-in for modularity clustering."""
    both = checkpointed(graph.select("src", "dst").union(graph.select("dst", "src")).distinct())
    labels = checkpointed(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    before = None
    while True:
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "community").union(labels.select("id", "community"))
        counted = votes.groupBy("id", "community").agg(F.count("*").alias("n"))
        new = checkpointed(counted.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b")).select("id", F.col("b.community").alias("community")))
        if _same(new, labels):
            return labels
        if before is not None and _same(new, before):
            least = labels.unionByName(new).groupBy("id").agg(F.min("community").alias("community"))
            return checkpointed(least)
        before, labels = labels, new


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two labellings of the same nodes are equal."""
    return a.join(b.withColumnRenamed("community", "other"), "id").where("community <> other").isEmpty()


def modularity(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (edges, modularity) of a partition of an undirected graph."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = graph.join(a, "src").join(b, "dst")
    inner = e.groupBy(F.col("ca").alias("community")).agg(F.sum((F.col("ca") == F.col("cb")).cast("int")).alias("inside"))
    deg = e.select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count("*").alias("degree"))
    total = e.agg(F.count("*")).scalar()
    j = deg.join(inner, "community", "left").na.fill(0, ["inside"]).withColumn("m", total)
    return j.agg(F.max("m").alias("edges"), F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def cohesion(graph: DataFrame, members: DataFrame, most: int = 50) -> DataFrame:
    """(community, cohesion): of the edge ends of the first ``most`` members, the share that stays inside; 1.0 without edges.

    ``members`` is (id, community); the first members are those of the least id (a limit of the measure itself).
    """
    first = top_n(members, ["community"], [F.col("id")], most, "r").select("id", "community")
    ends = graph.select("src", "dst").union(graph.select("dst", "src")).toDF("id", "other")
    m2 = members.select(F.col("id").alias("other"), F.col("community").alias("c2"))
    per = first.join(ends, "id").join(m2, "other", "left").groupBy("community").agg(F.avg((F.coalesce(F.col("community") == F.col("c2"), F.lit(False))).cast("double")).alias("share"))
    return members.select("community").distinct().join(per, "community", "left").select("community", F.least(F.lit(1.0), F.coalesce("share", F.lit(1.0))).alias("cohesion"))


def community_names(members: DataFrame) -> DataFrame:
    """(community, label): the most frequent telling parent folder of the members' paths, capitalised, the least of equals;
    else the common prefix of names if it is longer than two; else 'Cluster_<size>'. ``members`` (community, name, filePath)."""
    parent = F.element_at(F.split(directory(F.col("filePath")), "/"), -1)
    votes = members.select("community", parent.alias("folder")).where((F.col("folder") != "") & ~F.lower("folder").isin(*GENERIC_FOLDERS)).groupBy("community", "folder").agg(F.count("*").alias("n"))
    top = votes.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder")).alias("t")).select("community", capitalised(F.col("t.folder")).alias("folder"))
    names = members.groupBy("community").agg(F.count("*").alias("size"), common_prefix().alias("prefix"))
    label = F.coalesce("folder", F.when((F.col("size") > 2) & (F.length("prefix") > 2), F.col("prefix")), F.concat(F.lit("Cluster_"), F.col("size").cast("string")))
    return names.join(top, "community", "left").select("community", label.alias("label"))


def common_prefix(column: str = "name"):
    """Longest common prefix of a column as an aggregate: that of its least and greatest value."""
    a, b = F.coalesce(F.min(column), F.lit("")), F.coalesce(F.max(column), F.lit(""))
    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (a.substr(F.lit(1), i) == b.substr(F.lit(1), i)) & (F.length(a) >= i), i).otherwise(acc))
    return a.substr(F.lit(1), n)


def entry_points(nodes: DataFrame, edges: DataFrame, least: float = 0.5, most: int = 200) -> DataFrame:
    """The ``most`` best entry points: callees / (callers + 1), twice for exported, by name and path; not in tests."""
    calls = edges.where((F.col("type") == "CALLS") & (F.col("confidence") >= least))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    inn = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    n = nodes.where(F.col("label").isin("Function", "Method") & ~F.coalesce(is_test(F.col("filePath"), "entry"), F.lit(False)))
    j = n.join(out, "id").join(inn, "id", "left").na.fill(0, ["callers"])
    exported = F.coalesce("isExported", F.lit(False))
    named, framed = F.coalesce(name_factor(F.col("name"), F.lower("language") if "language" in nodes.columns else None), F.lit(1.0)), F.coalesce(framework_factor(F.col("filePath")), F.lit(1.0))
    score = F.round(F.col("callees") / (F.col("callers") + 1) * F.when(exported, 2.0).otherwise(1.0) * named * framed, 6)
    why = F.array_compact(F.array(F.format_string("base:%.2f", F.col("callees") / (F.col("callers") + 1)), F.when(exported, "exported"), F.when(named > 1, "entry-pattern").when(named < 1, "utility-pattern"), F.when(framed > 1, "framework")))
    return j.select("id", "callers", "callees", score.alias("score"), F.array_join(why, ",").alias("reasons")).where("score > 0").orderBy(F.desc("score"), "id").limit(most)


def longest_per_ends(paths: DataFrame) -> DataFrame:
    """Of the paths with the same first and last node the longest, of equals the least."""
    key = paths.select("path", F.element_at("path", 1).alias("entry"), F.element_at("path", -1).alias("terminal"), F.size("path").alias("length"))
    best = key.groupBy("entry", "terminal").agg(F.min(F.struct((-F.col("length")).alias("l"), "path")).alias("b"))
    return best.select("entry", "terminal", F.col("b.path").alias("path"), (-F.col("b.l")).alias("length"))


def without_contained(paths: DataFrame) -> DataFrame:
    """Paths that are no run of consecutive nodes of a longer path.

    Every run of a path (there are at most length squared, and paths are bounded) is a key; a path whose key is a shorter
    run of another goes out by an anti join on equality, without comparing pairs.
    """
    keyed = paths.select("path", F.array_join("path", "\x1f").alias("key"), F.size("path").alias("n"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.transform(F.sequence(F.lit(1), F.col("n") - i + 1), lambda k: F.when(k < F.col("n"), F.array_join(F.slice("path", i, k), "\x1f")))))
    inner = keyed.select(F.explode(spans).alias("key")).where("key is not null").distinct()
    return keyed.join(inner, "key", "left_anti").select("path")


def cluster_rollup(communities: DataFrame, least: int = 5) -> DataFrame:
    """Communities of one name as one row: the largest's id, symbols, symbol-weighted cohesion, number of parts."""
    name = F.coalesce(F.when(F.col("heuristicLabel") != "", F.col("heuristicLabel")), F.when(F.col("label") != "", F.col("label")), F.lit("Unknown"))
    size = F.coalesce("symbolCount", F.lit(0)).cast("long")
    c = communities.select("id", name.alias("name"), size.alias("size"), F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"))
    g = c.groupBy("name").agg(F.min(F.struct((-F.col("size")).alias("s"), "id")).alias("best"), F.sum("size").alias("symbols"), F.sum(F.col("cohesion") * F.col("size")).alias("w"), F.count("*").alias("parts"))
    return g.where(F.col("symbols") >= least).select("name", F.col("best.id").alias("id"), "symbols", F.round(F.col("w") / F.col("symbols"), 6).alias("cohesion"), "parts")


def folder_rollup(paths: DataFrame) -> DataFrame:
    """(folder, files): distinct files under every folder, at any depth."""
    p = paths.select("path").where("path like '%/%'").distinct()
    return p.select(F.explode(ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))
