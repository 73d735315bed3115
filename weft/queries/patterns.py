"""Scans, filters, projections, joins and traversals over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import directory, file_name, ignored, is_test, is_utility, label_of, language_of
from weft.operators.dml import referential
from weft.plans.graphview import code_nodes, edges, nodes
from weft.plans.patterns import Step, induced, match, optional_lists, oriented, outside, top_n
from weft.plans.traverse import reach
from weft.functions.fixed import TEST_PATHS
from weft.queries.base import Book, graph
from weft.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql
REPO = "harbor-invoice"
HUB = "Function:shared/base/log.ts:writeLine"


@book(graph("SELECT label, count(*) AS n FROM nodes GROUP BY label"))
def label_counts(spark, sf):
    return nodes(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@book(graph("SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, round(avg(confidence), 6) AS confidence FROM edges GROUP BY type"))
def edge_counts(spark, sf):
    return edges(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.round(F.avg("confidence"), 6).alias("confidence"))


@book("""SELECT sum(CASE WHEN label = 'File' THEN 1 ELSE 0 END)::BIGINT AS files, sum(CASE WHEN label = 'Function' THEN 1 ELSE 0 END)::BIGINT AS functions,
    count(DISTINCT repo) AS repos, (SELECT count(*) FROM graph_relationships) AS edge_rows FROM parsed_nodes""")
def graph_stats(spark, sf):
    e = table(spark, sf, "graph_relationships").agg(F.count("*")).scalar()
    n = table(spark, sf, "parsed_nodes").agg(F.count_if(F.col("label") == "File").alias("files"), F.count_if(F.col("label") == "Function").alias("functions"), F.countDistinct("repo").alias("repos"))
    return n.withColumn("edge_rows", e)


@book(graph("SELECT a.id AS caller, b.id AS callee, a.name AS caller_name, b.name AS callee_name, e.confidence FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type = 'CALLS' AND a.label = 'Function' AND b.label = 'Method'"))
def typed_expand(spark, sf):
    m = match(nodes(spark, sf), edges(spark, sf), "Function", [Step("CALLS", label="Method")])
    return m.select(F.col("n0_id").alias("caller"), F.col("n1_id").alias("callee"), F.col("n0_name").alias("caller_name"), F.col("n1_name").alias("callee_name"), F.col("e1_confidence").alias("confidence"))


@book(graph(f"SELECT a.id AS caller, a.label, e.type FROM edges e JOIN nodes a ON a.id = e.src WHERE e.dst = '{HUB}'"))
def reverse_expand(spark, sf):
    e = edges(spark, sf).where(F.col("dst") == HUB)
    return e.join(nodes(spark, sf).select(F.col("id").alias("src"), "label"), "src").select(F.col("src").alias("caller"), "label", "type")


@book(graph("SELECT n.id, count(*) AS connections FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) e JOIN nodes n ON n.id = e.id GROUP BY n.id"))
def both_expand(spark, sf):
    e = oriented(edges(spark, sf), "both").groupBy(F.col("here").alias("id")).agg(F.count("*").alias("connections"))
    return e.join(nodes(spark, sf).select("id"), "id")


@book(graph("""SELECT n.id, n.name, n.label, n.filePath, c.connections FROM (SELECT id, count(*) AS connections FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) c
    JOIN nodes n ON n.id = c.id WHERE n.name IS NOT NULL ORDER BY connections DESC, n.id LIMIT 8"""))
def hotspots(spark, sf):
    """The most connected nodes; degrees are aggregated before they meet the nodes."""
    d = oriented(edges(spark, sf), "both").groupBy(F.col("here").alias("id")).agg(F.count("*").alias("connections"))
    return d.join(nodes(spark, sf), "id").where("name is not null").select("id", "name", "label", "filePath", "connections").orderBy(F.desc("connections"), "id").limit(8)


@book(graph("SELECT DISTINCT label, language, isExported FROM nodes WHERE isExported = true AND language IS NOT NULL"))
def distinct_exports(spark, sf):
    return nodes(spark, sf).where("isExported and language is not null").select("label", "language", "isExported").distinct()


@book(graph("""SELECT id, label, name FROM nodes WHERE label IN ('Function', 'Method') AND NOT (name IS NULL) AND name LIKE 'load%' AND contains(filePath, '/src/')
    AND label <> 'Method' AND (language = 'python' OR language = 'typescript')"""))
def filters(spark, sf):
    n = nodes(spark, sf)
    cond = F.col("label").isin("Function", "Method") & F.col("name").isNotNull() & F.col("name").startswith("load") & F.col("filePath").contains("/src/") & (F.col("label") != "Method") & ((F.col("language") == "python") | (F.col("language") == "typescript"))
    return n.where(cond).select("id", "label", "name")


@book("SELECT id FROM graph_relationships WHERE type = 'CALLS' AND (confidence IS NULL OR confidence >= 0.8) AND sourceId <> targetId")
def confident_edges(spark, sf):
    return table(spark, sf, "graph_relationships").where("type = 'CALLS' and (confidence is null or confidence >= 0.8) and sourceId <> targetId").select("id")


@book("""SELECT id, CASE WHEN starts_with(id, 'comm_') THEN 'Community' WHEN starts_with(id, 'proc_') THEN 'Process' ELSE split_part(id, ':', 1) END AS label_in_id,
    'code' AS origin, 2 AS depth, coalesce(nullif(name, ''), '?') AS name FROM parsed_nodes WHERE label = 'Class'""")
def projection(spark, sf):
    n = table(spark, sf, "parsed_nodes").where("label = 'Class'")
    return n.select("id", label_of(F.col("id")).alias("label_in_id"), F.lit("code").alias("origin"), F.lit(2).alias("depth"), F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("?")).alias("name"))


def _test_sql(kind: str) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" if how == "has" else f"ends_with(l, '{w}')" for how, w in TEST_PATHS[kind]) + ")"


@book(f"""WITH p AS (SELECT DISTINCT filePath AS path, lower(filePath) AS l FROM parsed_nodes WHERE filePath IS NOT NULL)
    SELECT path, {_test_sql("impact")} AS test, {_test_sql("entry")} AS entry_test, {_test_sql("report")} AS report_test,
        contains(l, '/utils/') OR contains(l, '/util/') OR contains(l, '/helpers/') OR contains(l, '/common/') OR contains(l, '/shared/') OR regexp_matches(l, '(^|/)(utils|helpers|util)\\.[a-z]+$') AS utility,
        list_has_any(string_split(path, '/'), ['node_modules', 'vendor', 'dist', 'build', 'target', '__pycache__', 'coverage', 'third_party', 'deps', 'generated']) OR regexp_matches(path, '(^|/)\\.[^/]') OR regexp_matches(l, '\\.(min|bundle|generated|gen|pb)\\.[a-z]+$') AS ignored
    FROM p""")
def path_predicates(spark, sf):
    p = table(spark, sf, "parsed_nodes").where("filePath is not null").select(F.col("filePath").alias("path")).distinct()
    c = F.col("path")
    return p.select("path", is_test(c).alias("test"), is_test(c, "entry").alias("entry_test"), is_test(c, "report").alias("report_test"), is_utility(c).alias("utility"), ignored(c).alias("ignored"))


@book("""WITH p AS (SELECT DISTINCT filePath AS path FROM parsed_nodes WHERE label = 'File' AND filePath IS NOT NULL), x AS (SELECT path, lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) AS e FROM p)
    SELECT path, CASE WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('js', 'jsx') THEN 'javascript' WHEN e = 'py' THEN 'python' WHEN e = 'java' THEN 'java' WHEN e IN ('c', 'h') THEN 'c'
        WHEN e IN ('cpp', 'cc', 'cxx', 'hpp', 'hxx', 'hh') THEN 'cpp' WHEN e = 'cs' THEN 'csharp' WHEN e = 'go' THEN 'go' WHEN e = 'rs' THEN 'rust' END AS lang FROM x""")
def languages(spark, sf):
    p = table(spark, sf, "parsed_nodes").where("label = 'File' and filePath is not null").select(F.col("filePath").alias("path")).distinct()
    return p.select("path", language_of(F.col("path")).alias("lang"))


@book(graph(""", named AS (SELECT id, name FROM nodes WHERE name IS NOT NULL),
    o AS (SELECT e.src AS id, list_sort(list(DISTINCT e.type || ':' || n.name)) AS l FROM edges e JOIN named n ON n.id = e.dst GROUP BY e.src),
    i AS (SELECT e.dst AS id, list_sort(list(DISTINCT e.type || ':' || n.name)) AS l FROM edges e JOIN named n ON n.id = e.src GROUP BY e.dst)
    SELECT s.id, coalesce(array_to_string(o.l[1:3], ','), '') AS outgoing, coalesce(array_to_string(i.l[1:3], ','), '') AS incoming FROM nodes s LEFT JOIN o ON o.id = s.id LEFT JOIN i ON i.id = s.id"""))
def optional_neighbors(spark, sf):
    """The nodes of all repositories and of none."""
    return optional_lists(nodes(spark, sf), edges(spark, sf))


@book(graph("SELECT DISTINCT n.id, m.dst AS community, p.dst AS process FROM nodes n JOIN edges m ON m.src = n.id AND m.type = 'MEMBER_OF' JOIN edges p ON p.src = n.id AND p.type = 'STEP_IN_PROCESS' WHERE n.label = 'Function'"))
def two_hop(spark, sf):
    e = edges(spark, sf)
    m = e.where("type = 'MEMBER_OF'").select(F.col("src").alias("id"), F.col("dst").alias("community"))
    p = e.where("type = 'STEP_IN_PROCESS'").select(F.col("src").alias("id"), F.col("dst").alias("process"))
    return nodes(spark, sf).where("label = 'Function'").select("id").join(m, "id").join(p, "id").distinct()


@book(graph(""", m AS (SELECT DISTINCT src AS id, dst AS c FROM edges WHERE type = 'MEMBER_OF'), calls AS (SELECT src, dst, count(*) AS n FROM edges WHERE type = 'CALLS' GROUP BY 1, 2)
    SELECT a.c AS from_community, b.c AS to_community, sum(calls.n)::BIGINT AS calls FROM calls JOIN m a ON a.id = calls.src JOIN m b ON b.id = calls.dst WHERE a.c <> b.c GROUP BY 1, 2"""))
def cluster_dependencies(spark, sf):
    """Calls between communities; calls and memberships are made distinct pairs before they meet."""
    e = edges(spark, sf)
    m = e.where("type = 'MEMBER_OF'").select(F.col("src").alias("id"), F.col("dst").alias("c")).distinct()
    calls = e.where("type = 'CALLS'").groupBy("src", "dst").agg(F.count("*").alias("n"))
    j = calls.join(m.toDF("src", "from_community"), "src").join(m.toDF("dst", "to_community"), "dst").where("from_community <> to_community")
    return j.groupBy("from_community", "to_community").agg(F.sum("n").alias("calls"))


_HOP = "edges WHERE type = 'CALLS' AND confidence >= 0.8"


@book(graph(f", c AS (SELECT DISTINCT src, dst FROM {_HOP}) SELECT DISTINCT a.src AS start, b.dst AS finish, 2 AS depth FROM c a JOIN c b ON b.src = a.dst WHERE a.src <> b.dst"))
def path2(spark, sf):
    c = edges(spark, sf).where("type = 'CALLS' and confidence >= 0.8").select("src", "dst").distinct()
    j = c.toDF("start", "mid").join(c.toDF("mid", "finish"), "mid").where("start <> finish")
    return j.select("start", "finish", F.lit(2).alias("depth")).distinct()


@book(graph(f", c AS (SELECT DISTINCT src, dst FROM {_HOP}) SELECT DISTINCT a.src AS start, d.dst AS finish, 3 AS depth FROM c a JOIN c b ON b.src = a.dst JOIN c d ON d.src = b.dst"))
def path3(spark, sf):
    """From every node; ends of two hops are made distinct before the third."""
    c = edges(spark, sf).where("type = 'CALLS' and confidence >= 0.8").select("src", "dst").distinct()
    two = c.toDF("start", "a").join(c.toDF("a", "b"), "a").select("start", "b").distinct()
    return two.join(c.toDF("b", "finish"), "b").select("start", "finish", F.lit(3).alias("depth")).distinct()


@book(graph(", x AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'EXTENDS') SELECT src || '>' || dst AS path, 1 AS hops FROM x UNION SELECT a.src || '>' || a.dst || '>' || b.dst, 2 FROM x a JOIN x b ON b.src = a.dst"))
def varlen_path(spark, sf):
    """Paths of one to two hops with their nodes in order."""
    x = edges(spark, sf).where("type = 'EXTENDS'").select("src", "dst").distinct()
    one = x.select(F.concat_ws(">", "src", "dst").alias("path"), F.lit(1).alias("hops"))
    two = x.toDF("a", "b").join(x.toDF("b", "c"), "b").select(F.concat_ws(">", "a", "b", "c").alias("path"), F.lit(2).alias("hops"))
    return one.unionByName(two).distinct()


@book(graph(f", s AS (SELECT id FROM nodes WHERE repo = '{REPO}') SELECT e.id, e.src, e.dst, e.type FROM edges e WHERE e.src IN (SELECT id FROM s) AND e.dst IN (SELECT id FROM s)"))
def induced_subgraph(spark, sf):
    return induced(edges(spark, sf), nodes(spark, sf).where(F.col("repo") == REPO).select("id")).select("id", "src", "dst", "type")


@book(graph(f", s AS (SELECT id FROM nodes WHERE repo = '{REPO}') SELECT e.id, e.src, e.dst FROM edges e WHERE e.type = 'CALLS' AND e.src IN (SELECT id FROM s) AND e.dst NOT IN (SELECT id FROM s)"))
def outside_edges(spark, sf):
    return outside(edges(spark, sf).where("type = 'CALLS'"), nodes(spark, sf).where(F.col("repo") == REPO).select("id")).select("id", "src", "dst")


@book(graph("SELECT DISTINCT c.id FROM code c WHERE c.label IN ('Function', 'Class', 'Method', 'Interface', 'File') AND c.id NOT IN (SELECT id FROM embeddable_nodes WHERE content IS NOT NULL AND id IS NOT NULL)"))
def missing_contents(spark, sf):
    have = table(spark, sf, "embeddable_nodes").where("content is not null").select("id").distinct()
    n = code_nodes(spark, sf).where(F.col("label").isin("Function", "Class", "Method", "Interface", "File"))
    return n.select("id").join(have, "id", "left_anti")


@book(graph("""SELECT folder, id, rank::BIGINT AS rank FROM (SELECT regexp_replace(filePath, '/[^/]*$', '') AS folder, id, row_number() OVER (PARTITION BY regexp_replace(filePath, '/[^/]*$', '') ORDER BY id) AS rank
    FROM nodes WHERE filePath IS NOT NULL AND contains(filePath, '/') AND label = 'Function') WHERE rank <= 3"""))
def lateral_top3(spark, sf):
    n = nodes(spark, sf).where("filePath is not null and contains(filePath, '/') and label = 'Function'").select(directory(F.col("filePath")).alias("folder"), "id")
    return top_n(n, ["folder"], [F.col("id")], 3).select("folder", "id", F.col("rank").cast("long").alias("rank"))


@book("SELECT 'Class' AS kind, name FROM parsed_nodes WHERE label = 'Class' UNION ALL SELECT 'Interface', name FROM parsed_nodes WHERE label = 'Interface' UNION ALL SELECT 'Shared', name FROM shared_nodes")
def union_labels(spark, sf):
    p = table(spark, sf, "parsed_nodes")
    a = p.where("label = 'Class'").select(F.lit("Class").alias("kind"), "name")
    return a.unionByName(p.where("label = 'Interface'").select(F.lit("Interface").alias("kind"), "name")).unionByName(table(spark, sf, "shared_nodes").select(F.lit("Shared").alias("kind"), "name"))


@book("SELECT name FROM parsed_nodes WHERE label = 'Function' AND name IS NOT NULL INTERSECT SELECT name FROM parsed_nodes WHERE label = 'Method'")
def intersect_names(spark, sf):
    p = table(spark, sf, "parsed_nodes").where("name is not null")
    return p.where("label = 'Function'").select("name").intersect(p.where("label = 'Method'").select("name"))


@book("SELECT id FROM parsed_nodes EXCEPT SELECT nodeId FROM node_deletions")
def except_deleted(spark, sf):
    return table(spark, sf, "parsed_nodes").select("id").distinct().join(table(spark, sf, "node_deletions").select(F.col("nodeId").alias("id")), "id", "left_anti")


_MODULES = "module AS (SELECT id, repo || '/' || CASE WHEN contains(filePath, '/') THEN split_part(filePath, '/', 2) ELSE '' END AS m FROM nodes WHERE repo IS NOT NULL AND filePath IS NOT NULL)"


@book(graph(f", {_MODULES} SELECT a.m AS from_module, b.m AS to_module, count(*) AS calls FROM edges e JOIN module a ON a.id = e.src JOIN module b ON b.id = e.dst WHERE e.type IN ('CALLS', 'IMPORTS') AND a.m <> b.m GROUP BY 1, 2"))
def module_edges(spark, sf):
    """Calls and imports between modules (second path segment of a repository)."""
    seg = F.when(F.col("filePath").contains("/"), F.split_part(F.col("filePath"), F.lit("/"), F.lit(2))).otherwise("")
    m = nodes(spark, sf).where("repo is not null and filePath is not null").select("id", F.concat_ws("/", "repo", seg).alias("m"))
    e = edges(spark, sf).where("type in ('CALLS', 'IMPORTS')").groupBy("src", "dst").agg(F.count("*").alias("n"))
    j = e.join(m.toDF("src", "from_module"), "src").join(m.toDF("dst", "to_module"), "dst").where("from_module <> to_module")
    return j.groupBy("from_module", "to_module").agg(F.sum("n").alias("calls"))


@book(graph("""SELECT f.id AS file, count(s.id) AS exports, coalesce(array_to_string(list_sort(list(DISTINCT s.name) FILTER (s.name IS NOT NULL)), ','), '') AS names
    FROM code f LEFT JOIN edges d ON d.src = f.id AND d.type = 'DEFINES' LEFT JOIN code s ON s.id = d.dst AND s.isExported WHERE f.label = 'File' GROUP BY f.id"""))
def exports_per_file(spark, sf):
    """Every file with its exported symbols, '' where it has none."""
    n = code_nodes(spark, sf)
    d = edges(spark, sf).where("type = 'DEFINES'").select("src", "dst").join(n.where("isExported").select(F.col("id").alias("dst"), "name"), "dst")
    g = d.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("exports"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return n.where("label = 'File'").select(F.col("id").alias("file")).join(g, "file", "left").na.fill({"exports": 0, "names": ""})


@book(graph("SELECT c.id AS community, n.id AS member, n.name FROM communities c JOIN edges e ON e.dst = c.id AND e.type = 'MEMBER_OF' JOIN nodes n ON n.id = e.src"))
def community_members(spark, sf):
    e = edges(spark, sf).where("type = 'MEMBER_OF'").select(F.col("src").alias("member"), F.col("dst").alias("community"))
    known = table(spark, sf, "communities").select(F.col("id").alias("community"))
    return e.join(known, "community").join(nodes(spark, sf).select(F.col("id").alias("member"), "name"), "member").select("community", "member", "name")


_TESTS = "skip AS (SELECT id FROM nodes WHERE contains(lower(filePath), '/test') OR contains(lower(filePath), '.test.'))"
_REACH = """, start AS (SELECT '{start}' AS id), e AS (SELECT DISTINCT {a} AS here, {b} AS there FROM edges WHERE confidence >= {least} AND type IN ({types})),
    walk AS (SELECT id, 0 AS depth FROM start UNION SELECT e.there, walk.depth + 1 FROM walk JOIN e ON e.here = walk.id WHERE walk.depth < {depth})
    SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id HAVING min(depth) > 0"""
_IMPACT = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS")
_TYPES = ", ".join(f"'{t}'" for t in _IMPACT)


def _from(spark, node):
    return spark.createDataFrame([(node,)], "id string")


@book(graph(_REACH.format(start=HUB, a="dst", b="src", least=0.0, types=_TYPES, depth=3)))
def impact_up(spark, sf):
    """What depends on a node, by least depth; the hub of the library, so the first level is wide."""
    return reach(edges(spark, sf), _from(spark, HUB), 3, "in", _IMPACT).select("id", "depth")


@book(graph(", first AS (SELECT min(src) AS id FROM edges WHERE type = 'CALLS')" + _REACH.replace(", start AS (SELECT '{start}' AS id)", ", start AS (SELECT id FROM first)").format(a="src", b="dst", least=0.8, types=_TYPES, depth=3)))
def impact_down(spark, sf):
    """What a node depends on over edges of confidence 0.8 or more."""
    e = edges(spark, sf)
    start = e.where("type = 'CALLS'").agg(F.min("src").alias("id"))
    return reach(e, start, 3, "out", _IMPACT, 0.8).select("id", "depth")


@book(graph(""", start AS (SELECT min(src) AS id FROM edges WHERE type = 'EXTENDS'), e AS (SELECT src AS here, dst AS there FROM edges WHERE type IN ('EXTENDS', 'DEFINES') UNION SELECT dst, src FROM edges WHERE type IN ('EXTENDS', 'DEFINES')),
    walk AS (SELECT id, 0 AS depth FROM start UNION SELECT e.there, walk.depth + 1 FROM walk JOIN e ON e.here = walk.id WHERE walk.depth < 2) SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id HAVING min(depth) > 0"""))
def khop(spark, sf):
    """Neighbours within two hops in either direction."""
    e = edges(spark, sf)
    return reach(e, e.where("type = 'EXTENDS'").agg(F.min("src").alias("id")), 2, "both", ["EXTENDS", "DEFINES"]).select("id", "depth")


@book(graph("SELECT e.id, e.src, e.dst, e.type FROM edges e WHERE e.src IN (SELECT id FROM nodes) AND e.dst IN (SELECT id FROM nodes)"))
def referential_filter(spark, sf):
    return referential(edges(spark, sf), nodes(spark, sf)).select("id", "src", "dst", "type")


@book(graph("""SELECT split_part(filePath, '/', -1) AS file, CASE WHEN contains(filePath, '/') THEN regexp_replace(filePath, '/[^/]*$', '') ELSE '' END AS folder, count(*) AS n FROM nodes WHERE filePath IS NOT NULL AND label = 'File' GROUP BY 1, 2"""))
def path_parts(spark, sf):
    n = nodes(spark, sf).where("filePath is not null and label = 'File'")
    return n.groupBy(file_name(F.col("filePath")).alias("file"), directory(F.col("filePath")).alias("folder")).agg(F.count("*").alias("n"))


@book(graph(""", changed AS (SELECT DISTINCT filePath AS f FROM node_deletions d JOIN code c ON c.id = d.nodeId WHERE filePath IS NOT NULL)
    SELECT f AS changed, id FROM (SELECT changed.f, n.id, row_number() OVER (PARTITION BY changed.f ORDER BY n.id) AS rn FROM nodes n JOIN changed ON contains(n.filePath, changed.f)) WHERE rn <= 20"""))
def contains_join(spark, sf):
    """Nodes whose path contains a changed path, at most 20 a changed file: a path is cut into its runs of segments, which
    are joined by equality; changed paths are whole runs, so that no pair of paths is compared."""
    n = code_nodes(spark, sf)
    changed = table(spark, sf, "node_deletions").select(F.col("nodeId").alias("id")).join(n.select("id", "filePath"), "id").where("filePath is not null").select(F.col("filePath").alias("changed")).distinct()
    parts = F.split("filePath", "/")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "/"))))
    at = nodes(spark, sf).where("filePath is not null").select("id", F.explode(runs).alias("changed"))
    return top_n(at.join(changed, "changed"), ["changed"], [F.col("id")], 20).select("changed", "id")


@book("SELECT seq, string_split(content, chr(10))[1] AS first_line FROM embeddable_nodes WHERE content IS NOT NULL")
def first_lines(spark, sf):
    """Of every content; an empty one has the empty line."""
    return table(spark, sf, "embeddable_nodes").where("content is not null").select("seq", F.split("content", "\n")[0].alias("first_line"))
