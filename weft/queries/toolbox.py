"""The tools with given parameters, and statements of the graph language, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.queries.base import Book, graph
from weft.queries.patterns import _test_sql
from weft.sources.tables import table
from weft.toolbox import Toolbox

book = Book()
QUERIES, SQL = book.queries, book.sql
HUB = "Class:shared/model/entity.py:Entity"
_DEPENDS = "('CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS')"


def statement(key: str, text: str, sql: str, **params) -> None:
    """Registers a statement of the graph language as a query."""

    def run(spark, sf):
        return Toolbox(spark, sf).cypher(text, **params)

    run.__name__, run.__doc__ = key, text
    book(graph(sql))(run)


statement("cy_filter", "MATCH (a:Function)-[r:CALLS]->(b) WHERE r.confidence >= $least AND NOT b.name IN ['log', 'print'] RETURN b.name AS name, count(*) AS n ORDER BY n DESC, name LIMIT 25",
    "SELECT b.name, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src AND a.label = 'Function' JOIN nodes b ON b.id = e.dst WHERE e.type = 'CALLS' AND e.confidence >= 0.8 AND b.name NOT IN ('log', 'print') GROUP BY 1 ORDER BY n DESC, b.name LIMIT 25", least=0.8)
statement("cy_optional", "MATCH (c:Class) OPTIONAL MATCH (c)-[:EXTENDS]->(p:Class) WHERE p.name STARTS WITH 'E' RETURN c.id AS id, join(collect(DISTINCT p.name), ',') AS parents",
    "SELECT c.id, coalesce(array_to_string(list_sort(list(DISTINCT p.name) FILTER (p.name IS NOT NULL)), ','), '') AS parents FROM nodes c LEFT JOIN (SELECT e.src, p.name FROM edges e JOIN nodes p ON p.id = e.dst AND p.label = 'Class' WHERE e.type = 'EXTENDS' AND starts_with(p.name, 'E')) p ON p.src = c.id WHERE c.label = 'Class' GROUP BY 1")
statement("cy_paths", "MATCH path = (a:Class)-[:EXTENDS|IMPLEMENTS*1..2]->(b) RETURN a.id AS first, join([n IN nodes(path) | n.name], '>') AS names, length(path) AS hops",
    """, x AS (SELECT src, dst FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS'))
    SELECT a.id AS first, concat_ws('>', a.name, b.name) AS names, 1 AS hops FROM nodes a JOIN x ON x.src = a.id JOIN nodes b ON b.id = x.dst WHERE a.label = 'Class'
    UNION ALL SELECT a.id, concat_ws('>', a.name, m.name, b.name), 2 FROM nodes a JOIN x ON x.src = a.id JOIN nodes m ON m.id = x.dst JOIN x y ON y.src = m.id JOIN nodes b ON b.id = y.dst WHERE a.label = 'Class'""")  # fmt: skip
statement("cy_with", "MATCH (n)<-[:CALLS]-(m) WITH n, count(DISTINCT m) AS callers WHERE callers > 3 MATCH (n)-[:MEMBER_OF]->(c:Community) RETURN n.id AS id, callers, c.id AS cluster",
    ", k AS (SELECT e.dst AS id, count(DISTINCT m.id) AS callers FROM edges e JOIN nodes m ON m.id = e.src WHERE e.type = 'CALLS' GROUP BY 1 HAVING count(DISTINCT m.id) > 3) SELECT n.id, callers, c.id AS cluster FROM k JOIN nodes n ON n.id = k.id JOIN edges e ON e.src = n.id AND e.type = 'MEMBER_OF' JOIN nodes c ON c.id = e.dst AND c.label = 'Community'")
statement("cy_union", "MATCH (n) RETURN n.label AS what, count(*) AS n UNION ALL MATCH ()-[r]->() RETURN r.type AS what, count(*) AS n",
    "SELECT label AS what, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT e.type, count(*) FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY 1")
statement("cy_both_ways", "MATCH (n {name: $name})-[r:CALLS]-(o) RETURN DISTINCT o.id AS id, CASE WHEN o.label = 'Method' THEN 'method' ELSE 'other' END AS kind",
    ", t AS (SELECT id FROM nodes WHERE name = 'writeLine'), x AS (SELECT dst AS id FROM edges JOIN t ON t.id = src WHERE type = 'CALLS' UNION SELECT src FROM edges JOIN t ON t.id = dst WHERE type = 'CALLS') SELECT o.id, CASE WHEN o.label = 'Method' THEN 'method' ELSE 'other' END AS kind FROM nodes o JOIN x ON x.id = o.id", name="writeLine")
statement("cy_two_patterns", "MATCH (a)-[:CALLS]->(b), (a)-[:MEMBER_OF]->(c:Community), (b)-[:MEMBER_OF]->(d:Community) WHERE c.id <> d.id RETURN c.id AS source, d.id AS target, count(*) AS calls",
    ", m AS (SELECT e.src, e.dst FROM edges e JOIN nodes c ON c.id = e.dst AND c.label = 'Community' WHERE e.type = 'MEMBER_OF') SELECT c.dst AS source, d.dst AS target, count(*) AS calls FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst JOIN m c ON c.src = a.id JOIN m d ON d.src = b.id WHERE e.type = 'CALLS' AND c.dst <> d.dst GROUP BY 1, 2")
statement("cy_texts", "MATCH (n:Function|Method) WHERE n.filePath ENDS WITH '.go' AND n.name =~ '[a-z]+Ticket' AND n.language IS NOT NULL RETURN DISTINCT split(n.filePath, '/')[0] AS root, toLower(n.name) AS name, size(split(n.filePath, '/')) AS depth",
    "SELECT DISTINCT split_part(filePath, '/', 1) AS root, lower(name) AS name, len(string_split(filePath, '/'))::INTEGER AS depth FROM nodes WHERE label IN ('Function', 'Method') AND ends_with(filePath, '.go') AND regexp_full_match(name, '[a-z]+Ticket') AND language IS NOT NULL")
statement("cy_unwind", "UNWIND $ids AS hit MATCH (n {id: hit})-[:DEFINES]-(f:File) RETURN hit, f.id AS file",
    ", t AS (SELECT unnest(['Class:shared/model/entity.py:Entity', 'none']) AS hit) SELECT hit, f.id AS file FROM t JOIN nodes n ON n.id = hit JOIN (SELECT src AS a, dst AS b FROM edges WHERE type = 'DEFINES' UNION ALL SELECT dst, src FROM edges WHERE type = 'DEFINES') e ON e.a = n.id JOIN nodes f ON f.id = e.b AND f.label = 'File'", ids=[HUB, "none"])


@book("SELECT vec_id AS id, round(distance, 6) AS distance FROM (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10)")
def cy_nearest(spark, sf):
    """A statement with a query vector as a parameter."""
    v = table(spark, sf, "embeddings").where("vec_id = 3").first()["embedding"]
    return Toolbox(spark, sf).cypher("CALL nearest({{QUERY_VECTOR}}, 10) YIELD id, distance RETURN id, round(distance, 6) AS distance", query_vector=list(map(float, v)))


@book(graph(f""", me AS (SELECT * FROM nodes WHERE id = '{HUB}'),
    i AS (SELECT DISTINCT 'incoming' AS section, e.type, n.id, n.name, n.filePath FROM edges e JOIN me ON me.id = e.dst JOIN nodes n ON n.id = e.src WHERE e.type IN {_DEPENDS}),
    o AS (SELECT DISTINCT 'outgoing' AS section, e.type, n.id, n.name, n.filePath FROM edges e JOIN me ON me.id = e.src JOIN nodes n ON n.id = e.dst WHERE e.type IN {_DEPENDS})
    SELECT 'symbol' AS section, label AS type, id, name, filePath FROM me UNION ALL (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY type ORDER BY id) <= 30) UNION ALL (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY type ORDER BY id) <= 30)
    UNION ALL SELECT DISTINCT 'flow', 'step ' || e.step, p.id, p.name, NULL FROM edges e JOIN me ON me.id = e.src JOIN nodes p ON p.id = e.dst WHERE e.type = 'STEP_IN_PROCESS'"""))
def tool_context(spark, sf):
    """A symbol with both sides by type and its flows."""
    return Toolbox(spark, sf).context(HUB)


@book(graph("""SELECT 'ambiguous' AS section, label AS type, id, name, filePath FROM nodes WHERE contains(lower(name), 'ticket') ORDER BY id LIMIT 10"""))
def tool_context_ambiguous(spark, sf):
    """A part of a name that many nodes have."""
    return Toolbox(spark, sf).context("ticket")


@book(graph(f""", f AS (SELECT filePath FROM code WHERE id = 'File:shared/model/entity.py' UNION SELECT 'shared/model/entity.py'), s AS (SELECT id, 0 AS d FROM nodes WHERE id = '{HUB}'),
    bad AS (SELECT id FROM code, (SELECT 1) WHERE coalesce({_test_sql('impact').replace('l,', "replace(lower(filePath), chr(92), '/'),")}, false)), e AS (SELECT DISTINCT dst AS here, src AS there FROM edges WHERE type IN {_DEPENDS} AND confidence >= 0.5),
    w AS (SELECT id, d FROM s UNION SELECT e.there, w.d + 1 FROM w JOIN e ON e.here = w.id WHERE w.d < 2 AND e.there NOT IN (SELECT id FROM bad)), r AS (SELECT id, min(d) AS depth FROM w GROUP BY id HAVING min(d) > 0),
    x AS (SELECT r.depth, r.id, n.name, n.filePath, arg_min(e.type, (e.type, e.dst, e.confidence)) AS via_type, arg_min(e.confidence, (e.type, e.dst, e.confidence)) AS confidence FROM r JOIN edges e ON e.src = r.id AND e.type IN {_DEPENDS} AND e.confidence >= 0.5 JOIN (SELECT id, depth FROM r UNION ALL SELECT id, 0 FROM s) b ON b.id = e.dst AND b.depth = r.depth - 1 LEFT JOIN nodes n ON n.id = r.id GROUP BY ALL)
    SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY depth ORDER BY confidence DESC, id) <= CASE depth WHEN 1 THEN 300 ELSE 200 END"""))
def tool_impact(spark, sf):
    """What depends on a class within two levels, without tests."""
    return Toolbox(spark, sf).impact(HUB, max_depth=2, min_confidence=0.5)


@book(graph("""SELECT 'process' AS section, 0 AS place, id, name FROM nodes WHERE id = 'proc_7' UNION ALL
    SELECT 'step', place, id, name FROM (SELECT x.id, n.name, row_number() OVER (ORDER BY x.step, x.id)::INTEGER AS place FROM (SELECT DISTINCT src AS id, step FROM edges WHERE type = 'STEP_IN_PROCESS' AND dst = 'proc_7') x JOIN nodes n ON n.id = x.id QUALIFY place <= 30)"""))
def tool_explore(spark, sf):
    """A flow with its steps."""
    return Toolbox(spark, sf).explore("proc_7", "process")


@book(graph("""SELECT 'cluster' AS section, 0 AS place, id, name FROM nodes WHERE id = 'comm_5' UNION ALL
    SELECT 'member', place, id, name FROM (SELECT x.id, n.name, row_number() OVER (ORDER BY x.step, x.id)::INTEGER AS place FROM (SELECT DISTINCT src AS id, step FROM edges WHERE type = 'MEMBER_OF' AND dst = 'comm_5') x JOIN nodes n ON n.id = x.id QUALIFY place <= 30)"""))
def tool_explore_cluster(spark, sf):
    return Toolbox(spark, sf).explore("comm_5", "cluster")


@book(graph(""", mem AS (SELECT src, min(dst) AS c FROM edges WHERE type = 'MEMBER_OF' GROUP BY 1), cl AS (SELECT coalesce(nullif(heuristicLabel, ''), 'Unknown') AS name, sum(coalesce(symbolCount, 0))::BIGINT AS n FROM communities GROUP BY 1 ORDER BY n DESC, name LIMIT 20),
    fl AS (SELECT id AS name, max(coalesce(stepCount, 0))::BIGINT AS n FROM processes GROUP BY 1 ORDER BY n DESC, name LIMIT 20), de AS (SELECT a.c || ' -> ' || b.c AS name, count(*) AS n FROM edges e JOIN mem a ON a.src = e.src JOIN mem b ON b.src = e.dst WHERE e.type = 'CALLS' AND a.c <> b.c GROUP BY 1 ORDER BY n DESC, name LIMIT 20),
    cr AS (SELECT id AS name, max(coalesce(len(list_distinct(communities)), 0))::BIGINT AS n FROM processes GROUP BY 1 HAVING n > 1 ORDER BY n DESC, name LIMIT 20)
    SELECT 'clusters' AS section, * FROM cl UNION ALL SELECT 'flows', * FROM fl UNION ALL SELECT 'dependencies', * FROM de UNION ALL SELECT 'critical paths', * FROM cr"""))
def tool_overview(spark, sf):
    """Clusters, flows, dependencies between clusters and critical paths."""
    return Toolbox(spark, sf).overview()


@book(graph(f""", me AS (SELECT id, filePath FROM nodes WHERE name = 'merge_session'), p AS (SELECT c.filePath FROM edges e JOIN me ON me.id = e.dst JOIN code c ON c.id = e.src WHERE e.type IN {_DEPENDS} AND c.filePath IS NOT NULL UNION SELECT filePath FROM me),
    f AS (SELECT id, arg_min(filePath, seq) AS filePath, arg_min(content, seq) AS content FROM embeddable_nodes WHERE label = 'File' AND content IS NOT NULL AND id IS NOT NULL GROUP BY id),
    l AS (SELECT id, filePath, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM f WHERE contains(content, 'merge_session')), h AS (SELECT *, min(i) OVER (PARTITION BY id) AS first FROM l WHERE regexp_matches(l, '\\bmerge_session\\b'))
    SELECT CASE WHEN filePath IN (SELECT filePath FROM p WHERE filePath IS NOT NULL) AND i = first THEN 'graph' ELSE 'text' END AS tier, id, i::INTEGER AS line_no, l AS old_line, regexp_replace(l, '\\bmerge_session\\b', 'combine_session', 'g') AS new_line FROM h"""))
def tool_rename(spark, sf):
    """Edits by the graph and by text."""
    return Toolbox(spark, sf).rename("merge_session", "combine_session")


@book(graph(""", f AS (SELECT DISTINCT filePath FROM parsed_nodes WHERE indexedAt >= TIMESTAMP '2025-06-01' AND filePath IS NOT NULL), a AS (SELECT e.dst AS process, e.step FROM edges e JOIN code c ON c.id = e.src JOIN f ON f.filePath = c.filePath WHERE e.type = 'STEP_IN_PROCESS'), n AS (SELECT count(DISTINCT process) AS n FROM a)
    SELECT process, count(*) AS steps, min(step) AS first_step, CASE WHEN n = 0 THEN 'low' WHEN n <= 5 THEN 'medium' WHEN n <= 15 THEN 'high' ELSE 'critical' END AS risk FROM a, n GROUP BY process, n"""))
def tool_detect_changes(spark, sf):
    """Flows with a step in a file indexed since a day."""
    since = table(spark, sf, "parsed_nodes").where(F.col("indexedAt") >= F.lit("2025-06-01").cast("timestamp_ntz")).where("filePath is not null")
    return Toolbox(spark, sf).detect_changes(since.select("filePath"))


_TOKENS = """one AS (SELECT label, id, arg_min(filePath, seq) AS filePath, arg_min(content, seq) AS content FROM embeddable_nodes WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY 1, 2),
    tk AS (SELECT label, id, filePath, list_filter(string_split_regex(lower(content), '[^a-z0-9_]+'), lambda x: length(x) > 1) AS t FROM one), st AS (SELECT label, count(*) AS n, avg(len(t)) AS a FROM tk GROUP BY 1),
    tf AS (SELECT label, id, filePath, w, len(list_filter(t, lambda x: x = w)) AS f, len(t) AS dl FROM tk, (VALUES ('basket'), ('prune')) AS q(w)), df AS (SELECT label, w, count(*) FILTER (f > 0) AS d FROM tf GROUP BY 1, 2),
    sc AS (SELECT tf.label, tf.id, tf.filePath, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score FROM tf JOIN df ON df.label = tf.label AND df.w = tf.w JOIN st ON st.label = tf.label WHERE f > 0 GROUP BY 1, 2, 3),
    top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) <= {n})"""


@book("WITH " + _TOKENS.format(n=20) + ", g AS (SELECT filePath, round(sum(score), 6) AS score FROM top WHERE filePath IS NOT NULL GROUP BY 1) SELECT filePath, score, row_number() OVER (ORDER BY score DESC, filePath)::INTEGER AS place FROM g QUALIFY place <= 20")
def index_search(spark, sf):
    """Files by the scores of five indexes, from stored postings."""
    from weft.operators.postings import kept_index, search_files

    return search_files(spark, kept_index(spark, sf, False), "basket prune", stemmed=False)


@book()
def index_search_stemmed(spark, sf):
    """The same with stems: 'pruned baskets' finds what 'prune basket' does."""
    from weft.operators.postings import kept_index, search_files

    return search_files(spark, kept_index(spark, sf), "pruned baskets")


@book(graph(", " + _TOKENS.format(n=50) + """, hit AS (SELECT id, max(score) AS score FROM top GROUP BY 1), rk AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM hit QUALIFY r <= 50), s AS (SELECT rk.id, n.name, round(1.0 / (60 + r - 1), 9)::DOUBLE AS score FROM rk JOIN nodes n ON n.id = rk.id),
    p AS (SELECT DISTINCT s.id, s.name, s.score, e.dst AS process FROM s JOIN edges e ON e.src = s.id AND e.type = 'STEP_IN_PROCESS'), m AS (SELECT e.src AS id, max(c.cohesion) AS cohesion FROM edges e JOIN communities c ON c.id = e.dst WHERE e.type = 'MEMBER_OF' GROUP BY 1),
    fl AS (SELECT process, round(sum(score) + 0.1 * coalesce(max(cohesion), 0), 6) AS priority FROM p LEFT JOIN m ON m.id = p.id GROUP BY 1), best AS (SELECT *, row_number() OVER (ORDER BY priority DESC, process) AS place FROM fl QUALIFY place <= 5)
    SELECT 'flow' AS section, place, process AS id, n.name, priority FROM best LEFT JOIN nodes n ON n.id = process
    UNION ALL (SELECT 'symbol', b.place, p.id, p.name, round(p.score, 6) FROM p JOIN best b ON b.process = p.process QUALIFY row_number() OVER (PARTITION BY p.process ORDER BY p.score DESC, p.id) <= 10)
    UNION ALL (SELECT 'definition', 0, id, name, round(score, 6) FROM s WHERE id NOT IN (SELECT src FROM edges WHERE type = 'STEP_IN_PROCESS') ORDER BY score DESC, id LIMIT 20)"""))
def tool_query(spark, sf):
    """Flows by their keyword hits, the symbols in them, and hits in none."""
    return Toolbox(spark, sf).query("basket prune", stemmed=False)


@book()
def tool_query_hybrid(spark, sf):
    """The same with a vector list: vectors stand for the nodes of their number."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id = 0").first()["embedding"]
    n = table(spark, sf, "parsed_nodes").where("id is not null").groupBy(F.col("seq").alias("vec_id")).agg(F.min("id").alias("id"))
    return Toolbox(spark, sf).query("basket prune", vector=list(map(float, q)), names=n)


@book("""WITH f AS (SELECT id, arg_min(filePath, seq) AS filePath, arg_min(content, seq) AS content FROM embeddable_nodes WHERE label = 'File' AND content IS NOT NULL AND id IS NOT NULL GROUP BY id),
    l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1))::INTEGER AS line_no FROM f WHERE contains(lower(filePath), '.py')) SELECT id, line_no, line FROM l WHERE regexp_matches(line, '(?i)def \\w*ticket') ORDER BY id, line_no LIMIT 50""")
def tool_grep(spark, sf):
    return Toolbox(spark, sf).grep(r"def \w*ticket", file_filter=".PY", max_results=50)


@book(graph(", " + _TOKENS.format(n=10) + """, g AS (SELECT filePath, round(sum(score), 6) AS score FROM top WHERE filePath IS NOT NULL GROUP BY 1), f AS (SELECT filePath FROM g ORDER BY score DESC, filePath LIMIT 5),
    s AS (SELECT id, name, filePath FROM code WHERE contains(lower(name), 'basket') AND label NOT IN ('File', 'Folder') AND filePath IN (SELECT filePath FROM f) QUALIFY row_number() OVER (PARTITION BY filePath ORDER BY id) <= 3),
    k AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'CALLS'), o AS (SELECT src AS id, count(*) AS callees FROM k GROUP BY 1), i AS (SELECT dst AS id, count(*) AS callers FROM k GROUP BY 1), fl AS (SELECT src AS id, count(DISTINCT dst) AS flows FROM edges WHERE type = 'STEP_IN_PROCESS' GROUP BY 1),
    m AS (SELECT e.src AS id, max(c.cohesion) AS cohesion FROM edges e JOIN communities c ON c.id = e.dst WHERE e.type = 'MEMBER_OF' GROUP BY 1)
    SELECT f.filePath, s.id, s.name, least(coalesce(callers, 0), 3)::BIGINT AS callers, least(coalesce(callees, 0), 3)::BIGINT AS callees, coalesce(flows, 0)::BIGINT AS flows, coalesce(cohesion, 0.0)::DOUBLE AS cohesion
    FROM f LEFT JOIN s ON s.filePath = f.filePath LEFT JOIN o ON o.id = s.id LEFT JOIN i ON i.id = s.id LEFT JOIN fl ON fl.id = s.id LEFT JOIN m ON m.id = s.id"""))
def tool_augment(spark, sf):
    """Symbols of the best files by keyword, with callers, callees, flows and cohesion."""
    return Toolbox(spark, sf).augment("basket prune", stemmed=False)
