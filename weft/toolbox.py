"""The tools over a kept graph, with their parameters: query, context, impact, rename, detect_changes, cypher, explore,
overview, grep and augment. Every tool gives a DataFrame; names are values and never part of a statement."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import is_test, risk
from weft.operators.postings import kept_index, search, search_files
from weft.operators.search import matching_lines, nearest, ranked, reciprocal_ranks
from weft.plans.graphview import code_nodes, edges, nodes
from weft.plans.language import Graph
from weft.plans.patterns import top_n
from weft.plans.traverse import reach
from weft.sources.tables import table

DEPENDS = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS")
#: Most candidates of an ambiguous name, neighbours of each side, symbols of a definition list, and dependants by depth.
AMBIGUOUS, NEIGHBOURS, DEFINITIONS, BY_DEPTH = 10, 30, 20, (300, 200, 100)


class Toolbox:
    """The tools over the graph and texts of a table folder; ``repo`` restricts code nodes to one repository."""

    def __init__(self, spark: SparkSession, sf: str, repo: str | None = None):
        self.spark, self.sf = spark, sf
        keep = F.lit(True) if repo is None else (F.col("repo") == repo) | F.col("repo").isNull()
        self.code = code_nodes(spark, sf).where(keep)
        self.nodes = nodes(spark, sf).where(keep)
        self.out, self.into = edges(spark, sf), edges(spark, sf, by="dst")

    def files(self) -> DataFrame:
        """One content a file: (id, filePath, content)."""
        f = table(self.spark, self.sf, "embeddable_nodes").where("label = 'File' and content is not null and id is not null")
        return f.groupBy("id").agg(F.min(F.struct("seq", "filePath", "content")).alias("f")).select("id", "f.filePath", "f.content")

    # -- graph language
    def cypher(self, statement: str, **params: Any) -> DataFrame:
        """A statement of the graph language; ``$name`` and ``{{NAME}}`` stand for parameters, and ``CALL search($words, n)``
        and ``CALL nearest($vector, k)`` give hits by keyword and by vector."""
        def words(q, n=20):
            return search(self.spark, kept_index(self.spark, self.sf), q, n).select("id", "score")

        def vectors(q, k=10):
            return nearest(table(self.spark, self.sf, "embeddings"), q, k).select(F.col("vec_id").alias("id"), "distance")

        text = re.sub(r"\{\{(\w+)\}\}", lambda m: "$" + m.group(1).lower(), statement)
        return Graph(self.spark, self.nodes, self.out, {"search": words, "nearest": vectors}).query(text, **params)

    # -- looking up
    def resolve(self, name: str, file_path: str | None = None) -> DataFrame:
        """Nodes that a name means, by the first way that finds any: id, name, path, part of a name."""
        n = self.nodes if file_path is None else self.nodes.where(F.col("filePath").contains(file_path))
        low = F.lower("name")
        way = F.when(F.col("id") == name, 1).when(F.col("name") == name, 2).when((F.col("filePath") == name) & (F.col("label") == "File"), 3).when(low.contains(name.lower()), 4)
        found = n.withColumn("way", way).where("way is not null")
        return found.where(F.col("way") == found.agg(F.min("way")).scalar())

    def context(self, name: str, file_path: str | None = None, include_content: bool = False) -> DataFrame:
        """(section, type, id, name, filePath[, content]): the symbol with what refers to it, what it refers to and the flows it
        is a step of; a name that several nodes have gives only the section 'ambiguous' with the first of them."""
        cand = self.resolve(name, file_path).select("id", "label", "name", "filePath")
        many = cand.limit(AMBIGUOUS + 1).agg(F.count("*")).scalar()
        none = F.lit(None).cast("string")
        doubt = cand.where(many > 1).orderBy("id").limit(AMBIGUOUS).select(F.lit("ambiguous").alias("section"), F.col("label").alias("type"), "id", "name", "filePath")
        one = cand.where(many == 1)
        me = one.select(F.lit("symbol").alias("section"), F.col("label").alias("type"), "id", "name", "filePath")

        def side(e: DataFrame, here: str, there: str, section: str) -> DataFrame:
            near = e.where(F.col("type").isin(*DEPENDS)).join(F.broadcast(one.select(F.col("id").alias(here))), here, "left_semi").select("type", F.col(there).alias("id")).distinct()
            near = top_n(near.join(self.nodes.select("id", "name", "filePath"), "id"), ["type"], [F.col("id")], NEIGHBOURS)
            return near.select(F.lit(section).alias("section"), "type", "id", "name", "filePath")

        flows = self.out.where("type = 'STEP_IN_PROCESS'").join(F.broadcast(one.select(F.col("id").alias("src"))), "src", "left_semi").select(F.col("dst").alias("id"), "step").distinct()
        flows = flows.join(self.nodes.select("id", "name"), "id").select(F.lit("flow").alias("section"), F.concat(F.lit("step "), "step").alias("type"), "id", "name", none.alias("filePath"))
        out = doubt.unionByName(me).unionByName(side(self.into, "dst", "src", "incoming")).unionByName(side(self.out, "src", "dst", "outgoing")).unionByName(flows)
        if not include_content:
            return out
        texts = table(self.spark, self.sf, "embeddable_nodes").groupBy("id").agg(F.min_by("content", "seq").alias("content"))
        return out.join(F.broadcast(one.select("id")).join(texts, "id"), "id", "left")

    def impact(self, target: str, direction: str = "upstream", max_depth: int = 3, types: Sequence[str] = DEPENDS, min_confidence: float = 0.0, include_tests: bool = False) -> DataFrame:
        """(depth, id, name, filePath, via_type, confidence): what depends on a symbol (upstream) or what it depends on, the first
        ``BY_DEPTH`` of each depth. Of a file all its symbols are the start. Tests are not entered unless they are asked for."""
        hit = self.resolve(target).where("way < 4")
        files = hit.where("label = 'File'").select(F.col("filePath").alias("f"))
        start = hit.select("id").unionByName(self.code.join(F.broadcast(files), F.col("filePath") == F.col("f")).where("label <> 'File'").select("id")).distinct()
        skip = None if include_tests else self.code.where(is_test(F.col("filePath"))).select("id")
        r = reach(self.into if direction == "upstream" else self.out, start, max_depth, "in" if direction == "upstream" else "out", tuple(types), min_confidence, skip)
        r = r.join(self.nodes.select("id", "name", "filePath"), "id", "left")
        most = F.element_at(F.array(*[F.lit(x) for x in BY_DEPTH]), F.least(F.col("depth"), F.lit(len(BY_DEPTH))))
        cut = top_n(r, ["depth"], [F.desc("confidence"), F.col("id")], max(BY_DEPTH), "place").where(F.col("place") <= most)
        return cut.select("depth", "id", "name", "filePath", "via_type", "confidence")

    def explore(self, name: str, kind: str) -> DataFrame:
        """(section, place, id, name): a flow with its steps, a cluster with its members, or a symbol with its clusters; the first
        that has the name."""
        label = {"process": "Process", "cluster": "Community"}.get(kind)
        n = self.nodes.where(F.col("label") == label) if label else self.nodes.where(~F.col("label").isin("Process", "Community"))
        low = F.lower("name")
        rank = F.when(F.col("id") == name, 1).when(low == name.lower(), 2).when(low.contains(name.lower()), 3)
        one = n.withColumn("way", rank).where("way is not null").orderBy("way", "id").limit(1).select("id", "name")
        head = one.select(F.lit(kind).alias("section"), F.lit(0).alias("place"), "id", "name")
        type_ = "STEP_IN_PROCESS" if kind == "process" else "MEMBER_OF"
        here, there = ("src", "dst") if label is None else ("dst", "src")
        e = (self.out if label is None else self.into).where(F.col("type") == type_).join(F.broadcast(one.select(F.col("id").alias(here))), here, "left_semi").select(F.col(there).alias("id"), "step").distinct()
        e = top_n(e.join(self.nodes.select("id", "name"), "id").withColumn("one", F.lit(1)), ["one"], [F.col("step"), F.col("id")], NEIGHBOURS, "place")
        return head.unionByName(e.select(F.lit("step" if kind == "process" else "member" if kind == "cluster" else "cluster").alias("section"), "place", "id", "name"))

    def overview(self, limit: int = 20) -> DataFrame:
        """(section, name, n): the largest clusters by name, the longest flows, the dependencies between clusters and the critical
        paths (flows that cross most clusters), ``limit`` of each."""
        c = table(self.spark, self.sf, "communities").select(F.coalesce(F.when(F.col("heuristicLabel") != "", F.col("heuristicLabel")), F.lit("Unknown")).alias("name"), F.coalesce("symbolCount", F.lit(0)).cast("long").alias("n"))
        p = table(self.spark, self.sf, "processes")
        crossing = F.coalesce(F.size(F.array_distinct("communities")), F.lit(0)).cast("long")
        member = self.out.where("type = 'MEMBER_OF'").groupBy("src").agg(F.min("dst").alias("c"))
        calls = self.out.where("type = 'CALLS'").select("src", "dst").join(member, "src").withColumnRenamed("c", "a").join(member.select(F.col("src").alias("dst"), F.col("c").alias("b")), "dst").where("a <> b")

        def part(section: str, df: DataFrame) -> DataFrame:
            return df.orderBy(F.desc("n"), "name").limit(limit).select(F.lit(section).alias("section"), "name", "n")

        return (
            part("clusters", c.groupBy("name").agg(F.sum("n").alias("n")))
            .unionByName(part("flows", p.groupBy(F.col("id").alias("name")).agg(F.max(F.coalesce("stepCount", F.lit(0))).cast("long").alias("n"))))
            .unionByName(part("dependencies", calls.groupBy(F.concat("a", F.lit(" -> "), "b").alias("name")).agg(F.count("*").alias("n"))))
            .unionByName(part("critical paths", p.groupBy(F.col("id").alias("name")).agg(F.max(crossing).alias("n")).where("n > 1")))
        )

    # -- changing
    def rename(self, symbol: str, new_name: str) -> DataFrame:
        """(tier, id, line_no, old_line, new_line): edits of the definition and of the first line in each referring file (tier
        'graph'), then every other line of any file that has the name as a word (tier 'text')."""
        if not re.fullmatch(r"[^\W\d]\w*", new_name):
            raise ValueError(f"{new_name!r} is no name")
        name = symbol.rsplit(":", 1)[-1].rsplit(".", 1)[-1]
        word = rf"\b{re.escape(name)}\b"
        target = self.resolve(symbol).where("way < 3").select("id", "filePath")
        users = self.into.where(F.col("type").isin(*DEPENDS)).join(F.broadcast(target.select(F.col("id").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        paths = users.join(self.code.select("id", "filePath"), "id").select("filePath").unionByName(target.select("filePath")).where("filePath is not null").distinct()
        lines = matching_lines(self.files().where(F.col("content").contains(name)), "id", "content", word, ignore_case=False)
        lines = lines.join(self.files().select("id", "filePath"), "id")
        known = lines.join(paths.withColumn("graph", F.lit(True)), "filePath", "left")
        first = known.groupBy("id").agg(F.min("line_no").alias("first"))
        tier = F.when(F.coalesce("graph", F.lit(False)) & (F.col("line_no") == F.col("first")), "graph").otherwise("text")
        return known.join(first, "id").select(tier.alias("tier"), "id", "line_no", F.col("line").alias("old_line"), F.regexp_replace("line", word, new_name).alias("new_line"))

    def detect_changes(self, paths: DataFrame) -> DataFrame:
        """(process, steps, first_step, risk): flows with a step in a changed file (column filePath); risk by their number."""
        s = self.code.join(paths.select("filePath").distinct(), "filePath", "left_semi").select(F.col("id").alias("src"))
        a = self.out.where("type = 'STEP_IN_PROCESS'").join(s, "src", "left_semi")
        total = a.agg(F.countDistinct("dst")).scalar()
        g = a.groupBy(F.col("dst").alias("process")).agg(F.count("*").alias("steps"), F.min("step").alias("first_step")).withColumn("n", total)
        return g.select("process", "steps", "first_step", risk(F.col("n")).alias("risk"))

    # -- searching
    def hybrid(self, words: str, vector: list[float] | None = None, n: int = 50, base: int = 0, stemmed: bool = True, names: DataFrame | None = None) -> DataFrame:
        """(id, score, sources): keyword hits of all labels and vector hits by reciprocal ranks from ``base``. ``names`` says which
        node a vector is of (vec_id, id)."""
        h = search(self.spark, kept_index(self.spark, self.sf, stemmed), words, n, stemmed).groupBy("id").agg(F.max("score").alias("score"))
        lists = {"keyword": ranked(h, [F.desc("score"), F.col("id")], n)}
        if vector is not None and names is not None:
            v = nearest(table(self.spark, self.sf, "embeddings"), vector, n).join(names, "vec_id").select("id", F.round("distance", 9).alias("distance"))
            lists["vector"] = ranked(v, [F.col("distance"), F.col("id")], n)
        return reciprocal_ranks(lists, "id", base)

    def query(self, words: str, limit: int = 5, max_symbols: int = 10, vector: list[float] | None = None, stemmed: bool = True, names: DataFrame | None = None) -> DataFrame:
        """(section, place, id, name, priority): the flows that hits are steps of, by the sum of their hits' scores and a tenth of
        the best cohesion; the symbols of those flows; and the hits in no flow."""
        s = self.hybrid(words, vector, stemmed=stemmed, names=names).select("id", F.round("score", 9).alias("score"))
        s = s.join(self.nodes.select("id", "name"), "id")
        step = self.out.where("type = 'STEP_IN_PROCESS'").select(F.col("src").alias("id"), F.col("dst").alias("process"))
        p = step.join(F.broadcast(s), "id").distinct()  # at most n hits
        c = table(self.spark, self.sf, "communities").select(F.col("id").alias("dst"), "cohesion")
        m = self.out.where("type = 'MEMBER_OF'").join(F.broadcast(s.select(F.col("id").alias("src"))), "src", "left_semi").join(c, "dst").groupBy(F.col("src").alias("id")).agg(F.max("cohesion").alias("cohesion"))
        flows = p.join(m, "id", "left").groupBy("process").agg(F.round(F.sum("score") + 0.1 * F.coalesce(F.max("cohesion"), F.lit(0.0)), 6).alias("priority"))
        best = ranked(flows, [F.desc("priority"), F.col("process")], limit)
        head = best.join(self.nodes.select(F.col("id").alias("process"), "name"), "process", "left").select(F.lit("flow").alias("section"), F.col("rank").cast("long").alias("place"), F.col("process").alias("id"), "name", "priority")
        inside = top_n(p.join(F.broadcast(best.select("process", F.col("rank").alias("flow"))), "process"), ["process"], [F.desc("score"), F.col("id")], max_symbols, "at")
        rows = inside.select(F.lit("symbol").alias("section"), F.col("flow").cast("long").alias("place"), "id", "name", F.round("score", 6).alias("priority"))
        rest = s.join(step.select("id").distinct(), "id", "left_anti").orderBy(F.desc("score"), "id").limit(DEFINITIONS).select(F.lit("definition").alias("section"), F.lit(0).cast("long").alias("place"), "id", "name", F.round("score", 6).alias("priority"))
        return head.unionByName(rows).unionByName(rest)

    def grep(self, pattern: str, file_filter: str | None = None, case_sensitive: bool = False, max_results: int = 100) -> DataFrame:
        """(id, line_no, line) of the first matching lines, in order of file and line."""
        f = self.files() if file_filter is None else self.files().where(F.lower("filePath").contains(file_filter.lower()))
        return matching_lines(f, "id", "content", pattern, not case_sensitive).orderBy("id", "line_no").limit(max_results)

    def augment(self, pattern: str, stemmed: bool = True) -> DataFrame:
        """(filePath, id, name, callers, callees, flows, cohesion): of the best five of ten files by keyword, up to three symbols
        whose name has the first word, or the file alone where none has; the most coherent first."""
        word = (re.findall(r"\w+", pattern.lower()) or [""])[0]
        files = search_files(self.spark, kept_index(self.spark, self.sf, stemmed), pattern, 10, stemmed).where("place <= 5").select("filePath", "place")
        fits: Column = F.lower("name").contains(word) & ~F.col("label").isin("File", "Folder")
        s = top_n(self.code.where(fits).join(F.broadcast(files.select("filePath")), "filePath", "left_semi").select("id", "name", "filePath"), ["filePath"], [F.col("id")], 3, "at").drop("at")
        calls = self.out.where("type = 'CALLS'").select("src", "dst").distinct()
        ids = F.broadcast(s.select("id"))  # at most fifteen
        out = calls.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
        inn = calls.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
        flows = self.out.where("type = 'STEP_IN_PROCESS'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("flows"))
        c = table(self.spark, self.sf, "communities").select(F.col("id").alias("dst"), "cohesion")
        m = self.out.where("type = 'MEMBER_OF'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(c, "dst").groupBy(F.col("src").alias("id")).agg(F.max("cohesion").alias("cohesion"))
        j = s.join(out, "id", "left").join(inn, "id", "left").join(flows, "id", "left").join(m, "id", "left")
        j = files.select("filePath").join(j, "filePath", "left").na.fill(0, ["callers", "callees", "flows"]).na.fill(0.0, ["cohesion"])
        return j.select("filePath", "id", "name", F.least("callers", F.lit(3)).cast("long").alias("callers"), F.least("callees", F.lit(3)).cast("long").alias("callees"), F.col("flows").cast("long").alias("flows"), "cohesion").orderBy(F.desc("cohesion"), "filePath", "id")
