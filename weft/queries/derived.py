"""Resolution cascades and structures derived from the graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators.derive import cluster_rollup as rollup
from weft.operators.derive import clustering_graph as symbol_graph
from weft.operators.derive import cohesion, common_prefix, community_names, entry_points, folder_rollup, longest_per_ends, modularity, propagate_labels, structure, without_contained
from weft.operators.resolve import longest_prefix, resolve_calls, resolve_imports
from weft.plans.graphview import code_nodes, edges, nodes
from weft.plans.traverse import components, paths
from weft.functions.fixed import ENTRY_NAMES
from weft.functions.text import ENTRY_NAME, UTILITY_NAME
from weft.operators.cluster import community_nodes, membership_edges
from weft.queries.base import Book, graph
from weft.queries.patterns import _test_sql
from weft.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql
SYM = "label IN ('Function', 'Class', 'Method', 'Interface')"
_CLUSTER = f"""sym AS (SELECT id FROM nodes WHERE {SYM}), pair AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges
    WHERE type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS') AND src <> dst AND src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym))"""


@book("""WITH p AS (SELECT DISTINCT filePath AS path FROM parsed_nodes WHERE label = 'File' AND filePath IS NOT NULL AND contains(filePath, '/')), x AS (SELECT path, string_split(path, '/') AS s FROM p)
    SELECT DISTINCT 'Folder:' || array_to_string(s[1:i], '/') AS src, CASE WHEN i < len(s) - 1 THEN 'Folder:' || array_to_string(s[1:i + 1], '/') ELSE 'File:' || path END AS dst FROM x, unnest(range(1, len(s))) AS t(i)""")
def structure_edges(spark, sf):
    p = table(spark, sf, "parsed_nodes").where("label = 'File' and filePath is not null").select(F.col("filePath").alias("path"))
    return structure(p)


def _calls(spark, sf):
    """Calls as a parser would hand them on: the file of the caller and the bare name of what it calls."""
    n = code_nodes(spark, sf)
    e = edges(spark, sf).where("type = 'CALLS'").select("src", "dst")
    e = e.join(n.where("filePath is not null").select(F.col("id").alias("src"), F.col("filePath").alias("file")), "src")
    return e.select("file", F.substring_index(F.substring_index("dst", ":", -1), ".", -1).alias("called"))


def _symbols(spark, sf):
    return table(spark, sf, "parsed_nodes").where(f"{SYM} and filePath is not null and name is not null").select("seq", F.col("filePath").alias("file"), "name", "id")


def _imports(spark, sf):
    e = edges(spark, sf).where("type = 'IMPORTS'")
    return e.select(F.substring_index("src", ":", -1).alias("file"), F.substring_index("dst", ":", -1).alias("imported"))


@book(graph(f""", asked AS (SELECT DISTINCT n.filePath AS file, split_part(split_part(e.dst, ':', -1), '.', -1) AS called FROM edges e JOIN code n ON n.id = e.src WHERE e.type = 'CALLS' AND n.filePath IS NOT NULL),
    sy AS (SELECT seq, filePath AS file, name, id FROM parsed_nodes WHERE {SYM} AND filePath IS NOT NULL AND name IS NOT NULL), imp AS (SELECT DISTINCT split_part(src, ':', -1) AS file, split_part(dst, ':', -1) AS imported FROM edges WHERE type = 'IMPORTS'),
    l AS (SELECT file, name AS called, max_by(id, seq) AS t FROM sy GROUP BY 1, 2), v AS (SELECT a.file, a.called, min_by(sy.id, sy.seq) AS t FROM asked a JOIN imp ON imp.file = a.file JOIN sy ON sy.file = imp.imported AND sy.name = a.called GROUP BY 1, 2),
    w AS (SELECT name AS called, min_by(id, seq) AS t, count(*) AS n FROM sy GROUP BY 1)
    SELECT a.file, a.called, coalesce(l.t, v.t, w.t) AS target, (CASE WHEN l.t IS NOT NULL THEN 0.85 WHEN v.t IS NOT NULL THEN 0.9 WHEN w.n = 1 THEN 0.5 ELSE 0.3 END)::DOUBLE AS confidence,
        CASE WHEN l.t IS NOT NULL THEN 'same-file' WHEN v.t IS NOT NULL THEN 'import-resolved' ELSE 'fuzzy-global' END AS reason
    FROM asked a LEFT JOIN l ON l.file = a.file AND l.called = a.called LEFT JOIN v ON v.file = a.file AND v.called = a.called LEFT JOIN w ON w.called = a.called WHERE coalesce(l.t, v.t, w.t) IS NOT NULL"""))
def call_cascade(spark, sf):
    return resolve_calls(_calls(spark, sf), _symbols(spark, sf), _imports(spark, sf))


@book("""WITH f AS (SELECT filePath AS path, min(seq) AS seq FROM parsed_nodes WHERE label = 'File' AND filePath IS NOT NULL GROUP BY 1), i AS (SELECT path AS file, split_part(path, '/', -1) AS raw FROM f),
    x AS (SELECT path, seq, array_to_string(string_split(path, '/')[j:], '/') AS suffix FROM f, unnest(range(1, len(string_split(path, '/')) + 1)) AS t(j)),
    e AS (SELECT suffix, min_by(path, seq) AS hit FROM x GROUP BY suffix) SELECT i.file, i.raw, e.hit AS resolved FROM i JOIN e ON e.suffix = i.raw""")
def import_by_suffix(spark, sf):
    """Every file's own name as an import: the first file that ends with it."""
    f = table(spark, sf, "parsed_nodes").where("label = 'File' and filePath is not null").groupBy(F.col("filePath").alias("path")).agg(F.min("seq").alias("seq"))
    return resolve_imports(f.select(F.col("path").alias("file"), F.substring_index("path", "/", -1).alias("raw")), f)


@book("""WITH f AS (SELECT filePath AS path, row_number() OVER (ORDER BY filePath) AS seq FROM (SELECT DISTINCT filePath FROM parsed_nodes WHERE label = 'File' AND regexp_matches(filePath, '^[^.].*/.*\\.(ts|js)$')))
    SELECT path AS file, './' || regexp_replace(split_part(path, '/', -1), '\\.[a-z]+$', '') AS raw, arg_min(p, k) AS resolved FROM
    (SELECT f.path, g.path AS p, CASE WHEN g.path = regexp_replace(f.path, '\\.[a-z]+$', '') || '.ts' THEN 1 ELSE 2 END AS k FROM f JOIN f g ON g.path IN (regexp_replace(f.path, '\\.[a-z]+$', '') || '.ts', regexp_replace(f.path, '\\.[a-z]+$', '') || '.js')) GROUP BY path""")
def import_relative(spark, sf):
    """Relative imports without an extension: the candidate ends are tried in their order."""
    f = table(spark, sf, "parsed_nodes").where("label = 'File'").where(F.col("filePath").rlike(r"^[^.].*/.*\.(ts|js)$")).groupBy(F.col("filePath").alias("path")).agg(F.min("seq").alias("seq"))
    raw = F.concat(F.lit("./"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.[a-z]+$", ""))
    return resolve_imports(f.select(F.col("path").alias("file"), raw.alias("raw")), f)


@book("""WITH r AS (SELECT DISTINCT rtrim(path, '/') AS root FROM registry WHERE path IS NOT NULL), p AS (SELECT DISTINCT '/srv/checkouts/' || filePath AS path FROM parsed_nodes WHERE filePath IS NOT NULL)
    SELECT p.path, arg_max(r.root, length(r.root)) AS root FROM p JOIN r ON rtrim(p.path, '/') = r.root OR starts_with(p.path, r.root || '/') GROUP BY p.path""")
def longest_prefix_repo(spark, sf):
    """The registered checkout that a path lies in."""
    p = table(spark, sf, "parsed_nodes").where("filePath is not null").select(F.concat(F.lit("/srv/checkouts/"), "filePath").alias("path")).distinct()
    return longest_prefix(p, table(spark, sf, "registry").where("path is not null").select(F.col("path").alias("root")))


@book(graph(f", {_CLUSTER} SELECT src, dst FROM pair"))
def clustering_graph(spark, sf):
    return symbol_graph(nodes(spark, sf), edges(spark, sf))


_SPARSE = "sparse AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)"


@book(f"""WITH RECURSIVE {_SPARSE}, e AS (SELECT 'o' || o AS a, 'p' || p AS b FROM sparse), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS id, a AS root FROM both_ways UNION SELECT w.b, r.root FROM r JOIN both_ways w ON w.a = r.id)
    SELECT id, min(root) AS component FROM r GROUP BY id""")
def communities_cc(spark, sf):
    """Connected components of the sparse order-part graph."""
    e = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    return components(e)


_MEMBERS = "mem AS (SELECT src AS id, min(dst) AS community FROM edges WHERE type = 'MEMBER_OF' GROUP BY src)"


@book()
def label_propagation(spark, sf):
    """Communities of the symbol graph; deterministic label propagation, no SQL."""
    return propagate_labels(symbol_graph(nodes(spark, sf), edges(spark, sf)))


def _members(spark, sf):
    """Symbols and their least community."""
    return edges(spark, sf).where("type = 'MEMBER_OF'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("community"))




@book(graph(f""", {_CLUSTER}, {_MEMBERS}, e AS (SELECT a.community AS ca, b.community AS cb FROM pair JOIN mem a ON a.id = pair.src JOIN mem b ON b.id = pair.dst), d AS (SELECT c, count(*) AS degree FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY c),
    i AS (SELECT ca AS c, count(*) AS inside FROM e WHERE ca = cb GROUP BY ca), m AS (SELECT count(*) AS m FROM e)
    SELECT max(m.m) AS edges, round(sum(coalesce(inside, 0) / m.m - pow(degree / (2.0 * m.m), 2)), 6) AS modularity FROM d LEFT JOIN i ON i.c = d.c, m"""))
def community_modularity(spark, sf):
    """Modularity of the stored communities on the symbol graph."""
    m = modularity(symbol_graph(nodes(spark, sf), edges(spark, sf)), _members(spark, sf))
    return m.select("edges", F.round("modularity", 6).alias("modularity"))


@book(graph(f""", {_CLUSTER}, {_MEMBERS}, f AS (SELECT id, community FROM mem QUALIFY row_number() OVER (PARTITION BY community ORDER BY id) <= 50), ends AS (SELECT src AS id, dst AS other FROM pair UNION ALL SELECT dst, src FROM pair),
    s AS (SELECT f.community, avg(CASE WHEN f.community = m2.community THEN 1.0 ELSE 0.0 END) AS share FROM f JOIN ends ON ends.id = f.id LEFT JOIN mem m2 ON m2.id = ends.other GROUP BY 1)
    SELECT c.community, round(least(1.0, coalesce(share, 1.0)), 6)::DOUBLE AS cohesion FROM (SELECT DISTINCT community FROM mem) c LEFT JOIN s ON s.community = c.community"""))
def community_cohesion(spark, sf):
    return cohesion(symbol_graph(nodes(spark, sf), edges(spark, sf)), _members(spark, sf)).select("community", F.round("cohesion", 6).alias("cohesion"))


@book(graph(f""", {_MEMBERS}, m AS (SELECT mem.community, c.name, CASE WHEN contains(c.filePath, '/') THEN string_split(regexp_replace(c.filePath, '/[^/]*$', ''), '/')[-1] ELSE '' END AS folder FROM mem JOIN code c ON c.id = mem.id),
    v AS (SELECT community, folder, count(*) AS n FROM m WHERE folder <> '' AND lower(folder) NOT IN ('src', 'lib', 'core', 'utils', 'common', 'shared', 'helpers') GROUP BY 1, 2)
    SELECT community, upper(substr(folder, 1, 1)) || substr(folder, 2) AS label FROM v QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, folder) = 1"""))
def community_labels(spark, sf):
    """The most telling folder of each community (all here have one)."""
    m = _members(spark, sf).join(code_nodes(spark, sf).select("id", "name", "filePath"), "id")
    return community_names(m).where("label not like 'Cluster%'")


@book("""WITH g AS (SELECT filePath, min(name) AS a, max(name) AS b FROM parsed_nodes WHERE label = 'Method' AND filePath IS NOT NULL AND name IS NOT NULL GROUP BY filePath),
    p AS (SELECT filePath, a, coalesce(list_max(list_filter(range(1, length(a) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))), 0) AS n FROM g) SELECT filePath, substr(a, 1, n) AS prefix FROM p""")
def common_prefixes(spark, sf):
    m = table(spark, sf, "parsed_nodes").where("label = 'Method' and filePath is not null and name is not null")
    return m.groupBy("filePath").agg(common_prefix().alias("prefix"))


@book(graph(""", c AS (SELECT src, dst FROM edges WHERE type = 'CALLS' AND confidence >= 0.5), o AS (SELECT src AS id, count(*) AS callees FROM c GROUP BY 1), i AS (SELECT dst AS id, count(*) AS callers FROM c GROUP BY 1) SELECT o.id, coalesce(i.callers, 0) AS callers, o.callees FROM o LEFT JOIN i ON i.id = o.id"""))
def call_degrees(spark, sf):
    c = edges(spark, sf).where("type = 'CALLS' and confidence >= 0.5")
    o, i = c.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees")), c.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    return o.join(i, "id", "left").na.fill(0, ["callers"]).select("id", "callers", "callees")


_LANG_FACTOR = " ".join(f"WHEN lower(language) = '{x}' AND regexp_matches(name, '{'|'.join(f'(?:{i})' for i in p)}') THEN 1.5" for x, p in ENTRY_NAMES.items() if x != "*")


@book(graph(f""", c AS (SELECT src, dst FROM edges WHERE type = 'CALLS' AND confidence >= 0.5), o AS (SELECT src AS id, count(*) AS callees FROM c GROUP BY 1), i AS (SELECT dst AS id, count(*) AS callers FROM c GROUP BY 1),
    n AS (SELECT *, '/' || lower(filePath) AS p, replace(lower(filePath), chr(92), '/') AS l FROM nodes WHERE label IN ('Function', 'Method')),
    f AS (SELECT n.id, callees, coalesce(callers, 0) AS callers, coalesce(isExported, false) AS exported,
        CASE WHEN name IS NULL THEN 1.0 WHEN regexp_matches(name, '{UTILITY_NAME}') THEN 0.3 WHEN regexp_matches(name, '{ENTRY_NAME}') THEN 1.5 {_LANG_FACTOR} ELSE 1.0 END AS named,
        CASE WHEN p IS NULL THEN 1.0 WHEN regexp_matches(p, '/pages/.*\\.(tsx|ts|jsx|js)$') AND NOT contains(p, '/_') AND NOT contains(p, '/api/') THEN 3.0 WHEN regexp_matches(p, '/app/.*page\\.(tsx|ts|jsx|js)$|/pages/api/|/app/.*route\\.(ts|js)$') THEN 3.0
            WHEN ends_with(p, 'views.py') OR regexp_matches(p, 'controller\\.java$|controller\\.cs$') THEN 3.0 WHEN regexp_matches(p, '/main\\.(go|rs|c|cpp)$') THEN 3.0
            WHEN regexp_matches(p, '/routes/|/controllers/|/handlers/|/routers/|/bin/|/app\\.c$|\\.razor$') THEN 2.5 WHEN ends_with(p, 'urls.py') OR regexp_matches(p, '/app/.*layout\\.(tsx|ts)$') OR contains(p, '/api/') AND ends_with(p, '.py') THEN 2.0
            WHEN contains(p, '/services/') AND ends_with(p, '.java') OR regexp_matches(p, '/api/index\\.(ts|js)$') THEN 1.8 ELSE 1.0 END AS framed
        FROM n JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id WHERE NOT coalesce({_test_sql("entry")}, false)),
    s AS (SELECT id, callers, callees, round(callees / (callers + 1) * CASE WHEN exported THEN 2.0 ELSE 1.0 END * named * framed, 6)::DOUBLE AS score,
        concat_ws(',', printf('base:%.2f', (callees / (callers + 1))::DOUBLE), CASE WHEN exported THEN 'exported' END, CASE WHEN named > 1 THEN 'entry-pattern' WHEN named < 1 THEN 'utility-pattern' END, CASE WHEN framed > 1 THEN 'framework' END) AS reasons FROM f)
    SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 200"""))
def entry_scores(spark, sf):
    """The 200 best entry points with their score and its reasons."""
    return entry_points(nodes(spark, sf), edges(spark, sf))


@book(graph(f""", {_CLUSTER}, {_MEMBERS}, z AS (SELECT community, count(*) AS members FROM mem GROUP BY 1 HAVING count(*) > 1), f AS (SELECT id, community FROM mem QUALIFY row_number() OVER (PARTITION BY community ORDER BY id) <= 50),
    ends AS (SELECT src AS id, dst AS other FROM pair UNION ALL SELECT dst, src FROM pair), s AS (SELECT f.community, avg(CASE WHEN f.community = m2.community THEN 1.0 ELSE 0.0 END) AS share FROM f JOIN ends ON ends.id = f.id LEFT JOIN mem m2 ON m2.id = ends.other GROUP BY 1)
    SELECT 'comm_' || (row_number() OVER (ORDER BY members DESC, z.community) - 1) AS id, z.community, members, round(least(1.0, coalesce(share, 1.0)), 6)::DOUBLE AS cohesion FROM z LEFT JOIN s ON s.community = z.community"""))
def partition_nodes(spark, sf):
    """Nodes of a partition: communities of two or more, the largest first."""
    c = community_nodes(symbol_graph(nodes(spark, sf), edges(spark, sf)), _members(spark, sf), nodes(spark, sf))
    return c.select("id", "community", "members", F.round("cohesion", 6).alias("cohesion"))


@book(graph(f""", {_MEMBERS} SELECT id AS src, 'comm_' || community AS dst, 'MEMBER_OF' AS type FROM mem"""))
def partition_edges(spark, sf):
    """Membership edges of a partition, those of single nodes too."""
    return membership_edges(_members(spark, sf))


_TRANS = "t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), g AS (SELECT DISTINCT a, b FROM t WHERE b IS NOT NULL AND a <> b), adj AS (SELECT a, b FROM g QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 4)"


def _transitions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, sf, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return t.where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


@book("SELECT a AS src, b AS dst, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1, 2")
def event_transitions(spark, sf):
    return _transitions(spark, sf)


@book(f"""WITH RECURSIVE {_TRANS}, w AS (SELECT [a] AS p, a AS tip FROM (SELECT min(a) AS a FROM g) UNION ALL SELECT list_append(w.p, adj.b), adj.b FROM w JOIN adj ON adj.a = w.tip WHERE NOT list_contains(w.p, adj.b) AND len(w.p) < 4)
    SELECT array_to_string(p, '->') AS path, len(p)::INTEGER AS length FROM w WHERE len(p) >= 3 AND (len(p) = 4 OR NOT EXISTS (SELECT 1 FROM adj WHERE adj.a = w.tip AND NOT list_contains(w.p, adj.b)))""")
def trace_paths(spark, sf):
    """Simple paths of up to four steps over the event transitions."""
    g = _transitions(spark, sf).where("src <> dst").select("src", "dst")
    p = paths(g, g.agg(F.min("src").alias("id")), 4)
    return p.select(F.array_join("path", "->").alias("path"), "length")


@book()
def flows(spark, sf):
    """Flows over calls from the best entry points: contained traces dropped, the longest of the same ends kept."""
    e = edges(spark, sf)
    starts = entry_points(nodes(spark, sf), e).select("id")
    c = e.where("type = 'CALLS' and confidence >= 0.5 and src <> dst").select("src", "dst")
    kept = longest_per_ends(without_contained(paths(c, starts, 6).select("path")))
    return kept.select("entry", "terminal", F.array_join("path", "->").alias("path"), "length")


_NAME = "coalesce(nullif(heuristicLabel, ''), nullif(label, ''), 'Unknown')"


@book(f"""SELECT {_NAME} AS name, arg_min(id, (-coalesce(symbolCount, 0), id)) AS id, sum(coalesce(symbolCount, 0))::BIGINT AS symbols, round(sum(coalesce(cohesion, 0) * coalesce(symbolCount, 0)) / sum(coalesce(symbolCount, 0)), 6) AS cohesion, count(*) AS parts
    FROM communities GROUP BY 1 HAVING sum(coalesce(symbolCount, 0)) >= 5""")
def cluster_rollups(spark, sf):
    return rollup(table(spark, sf, "communities"))


@book("SELECT count(*) AS n, count(*) FILTER (processType = 'cross_community') AS crossing, round(avg(stepCount), 1) AS steps FROM processes")
def process_stats(spark, sf):
    return table(spark, sf, "processes").agg(F.count("*").alias("n"), F.count_if(F.col("processType") == "cross_community").alias("crossing"), F.round(F.avg("stepCount"), 1).alias("steps"))


@book(graph("SELECT dst AS process, src AS symbol, row_number() OVER (PARTITION BY dst ORDER BY step, src, id)::BIGINT AS position FROM edges WHERE type = 'STEP_IN_PROCESS'"))
def process_steps(spark, sf):
    """Symbols of a flow in the order of their step."""
    e = edges(spark, sf).where("type = 'STEP_IN_PROCESS'")
    return e.select(F.col("dst").alias("process"), F.col("src").alias("symbol"), F.row_number().over(Window.partitionBy("dst").orderBy("step", "src", "id")).cast("long").alias("position"))


@book(graph("SELECT step, count(*) AS symbols FROM edges WHERE type = 'STEP_IN_PROCESS' GROUP BY step"))
def steps_histogram(spark, sf):
    return edges(spark, sf).where("type = 'STEP_IN_PROCESS'").groupBy("step").agg(F.count("*").alias("symbols"))


@book("""WITH p AS (SELECT DISTINCT filePath AS path FROM parsed_nodes WHERE label = 'File' AND contains(filePath, '/')) SELECT array_to_string(string_split(path, '/')[1:i], '/') AS folder, count(*) AS files FROM p, unnest(range(1, len(string_split(path, '/')))) AS t(i) GROUP BY 1""")
def folder_counts(spark, sf):
    return folder_rollup(table(spark, sf, "parsed_nodes").where("label = 'File'").select(F.col("filePath").alias("path")))


@book("SELECT repo, count(*) FILTER (c >= 0.9) AS high, count(*) FILTER (c >= 0.8 AND c < 0.9) AS medium, count(*) FILTER (c < 0.8 OR c IS NULL) AS low FROM (SELECT repo, confidence AS c FROM graph_relationships) GROUP BY repo")
def confidence_buckets(spark, sf):
    c = F.col("confidence")
    return table(spark, sf, "graph_relationships").groupBy("repo").agg(F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.8) & (c < 0.9)).alias("medium"), F.count_if((c < 0.8) | c.isNull()).alias("low"))


@book("SELECT repo, sum(ceil(length(content) / 4.0))::BIGINT AS tokens, count(*) AS files, sum(ceil(length(content) / 4.0)) > 30000 AND count(*) > 3 AS split FROM embeddable_nodes WHERE label = 'File' AND content IS NOT NULL GROUP BY repo")
def module_tokens(spark, sf):
    f = table(spark, sf, "embeddable_nodes").where("label = 'File' and content is not null")
    t = F.sum(F.ceil(F.length("content") / 4.0))
    return f.groupBy("repo").agg(t.cast("long").alias("tokens"), F.count("*").alias("files"), ((t > 30000) & (F.count("*") > 3)).alias("split"))
