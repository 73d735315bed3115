"""Views that put several patterns together: symbols, clusters, flows, changes, sessions, and event aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import risk
from weft.plans.graphview import code_nodes, edges, nodes
from weft.plans.patterns import oriented, top_n
from weft.queries.base import Book, graph
from weft.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql
HUB = "Function:shared/base/log.ts:writeLine"


@book(graph(f"""SELECT 'incoming' AS side, lower(type) AS kind, count(*) AS n, min(src) AS least FROM edges WHERE dst = '{HUB}' GROUP BY 2 UNION ALL SELECT 'outgoing', lower(type), count(*), min(dst) FROM edges WHERE src = '{HUB}' GROUP BY 2"""))
def symbol_context(spark, sf):
    """References to and from a symbol by kind."""
    e = edges(spark, sf)
    a = e.where(F.col("dst") == HUB).groupBy(F.lower("type").alias("kind")).agg(F.count("*").alias("n"), F.min("src").alias("least")).select(F.lit("incoming").alias("side"), "kind", "n", "least")
    b = e.where(F.col("src") == HUB).groupBy(F.lower("type").alias("kind")).agg(F.count("*").alias("n"), F.min("dst").alias("least")).select(F.lit("outgoing").alias("side"), "kind", "n", "least")
    return a.unionByName(b)


@book(graph(""", m AS (SELECT id, 1 AS p FROM nodes WHERE id = 'comm_0' UNION ALL SELECT id, 2 FROM nodes WHERE name = 'comm_0' UNION ALL SELECT id, 3 FROM nodes WHERE contains(lower(name), 'ticket')) SELECT id, min(p)::INTEGER AS preference FROM m GROUP BY id ORDER BY preference, id LIMIT 10"""))
def resolve_entity(spark, sf):
    """Nodes by id, then name, then part of the name; the ten best."""
    n = nodes(spark, sf)
    p = F.when(F.col("id") == "comm_0", 1).when(F.col("name") == "comm_0", 2).when(F.lower("name").contains("ticket"), 3)
    return n.select("id", p.alias("preference")).where("preference is not null").orderBy("preference", "id").limit(10)


@book(graph("SELECT c.id, c.label, count(e.id) AS members, count(DISTINCT n.repo) AS repos FROM communities c LEFT JOIN edges e ON e.dst = c.id AND e.type = 'MEMBER_OF' LEFT JOIN nodes n ON n.id = e.src GROUP BY c.id, c.label"))
def overview(spark, sf):
    """Every community with its members and the repositories they come from."""
    e = edges(spark, sf).where("type = 'MEMBER_OF'").select(F.col("src").alias("member"), F.col("dst").alias("id"))
    g = e.join(nodes(spark, sf).select(F.col("id").alias("member"), "repo"), "member", "left").groupBy("id").agg(F.count("*").alias("members"), F.countDistinct("repo").alias("repos"))
    return table(spark, sf, "communities").select("id", "label").join(g, "id", "left").na.fill(0, ["members", "repos"])


@book(graph("SELECT DISTINCT e.dst AS community, n.id AS member FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type = 'MEMBER_OF' QUALIFY dense_rank() OVER (PARTITION BY e.dst ORDER BY n.id) <= 30"))
def cluster_detail(spark, sf):
    m = edges(spark, sf).where("type = 'MEMBER_OF'").select(F.col("dst").alias("community"), F.col("src").alias("member")).distinct()
    m = m.join(nodes(spark, sf).select(F.col("id").alias("member")), "member", "left_semi")
    return top_n(m, ["community"], [F.col("member")], 30).select("community", "member")


@book(graph(""", f AS (SELECT DISTINCT c.filePath FROM node_deletions d JOIN code c ON c.id = d.nodeId WHERE c.filePath IS NOT NULL), s AS (SELECT id FROM code WHERE filePath IN (SELECT filePath FROM f)),
    a AS (SELECT e.dst AS process, e.src AS symbol, e.step FROM edges e WHERE e.type = 'STEP_IN_PROCESS' AND e.src IN (SELECT id FROM s)), n AS (SELECT count(DISTINCT process) AS n FROM a)
    SELECT process, count(*) AS steps, min(step) AS first_step, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols, CASE WHEN n = 0 THEN 'low' WHEN n <= 5 THEN 'medium' WHEN n <= 15 THEN 'high' ELSE 'critical' END AS risk FROM a, n GROUP BY process, n"""))
def change_impact(spark, sf):
    """Flows with a step in a changed file, and the risk by their number."""
    n = code_nodes(spark, sf).where("filePath is not null")
    f = table(spark, sf, "node_deletions").select(F.col("nodeId").alias("id")).join(n.select("id", "filePath"), "id").select("filePath").distinct()
    s = n.join(f, "filePath", "left_semi").select(F.col("id").alias("src"))
    a = edges(spark, sf).where("type = 'STEP_IN_PROCESS'").join(s, "src", "left_semi")
    g = a.groupBy(F.col("dst").alias("process")).agg(F.count("*").alias("steps"), F.min("step").alias("first_step"), F.array_join(F.array_sort(F.collect_set("src")), ",").alias("symbols"))
    total = a.agg(F.countDistinct("dst")).scalar()
    return g.withColumn("n", total).select("process", "steps", "first_step", "symbols", risk(F.col("n")).alias("risk"))


@book(graph(""", x AS (SELECT a.repo AS ra, b.repo AS rb, a.filePath AS fa, b.filePath AS fb, e.type FROM edges e JOIN code a ON a.id = e.src JOIN code b ON b.id = e.dst WHERE e.type = 'CALLS')
    SELECT ra AS repo, count(*) AS calls, count(*) FILTER (fa = fb) AS same_file, count(*) FILTER (fa <> fb AND ra = rb) AS same_repo, count(*) FILTER (ra <> rb) AS other_repo FROM x GROUP BY ra"""))
def call_locality(spark, sf):
    """Calls inside a file, a repository and across repositories."""
    n = code_nodes(spark, sf).select("id", "repo", "filePath")
    e = edges(spark, sf).where("type = 'CALLS'").select("src", "dst")
    x = e.join(n.toDF("src", "ra", "fa"), "src").join(n.toDF("dst", "rb", "fb"), "dst")
    return x.groupBy(F.col("ra").alias("repo")).agg(F.count("*").alias("calls"), F.count_if(F.col("fa") == F.col("fb")).alias("same_file"), F.count_if((F.col("fa") != F.col("fb")) & (F.col("ra") == F.col("rb"))).alias("same_repo"), F.count_if(F.col("ra") != F.col("rb")).alias("other_repo"))


@book(graph(""", s AS (SELECT dst AS process, src FROM edges WHERE type = 'STEP_IN_PROCESS') SELECT DISTINCT a.process, e.src, e.dst FROM edges e JOIN s a ON a.src = e.src JOIN s b ON b.src = e.dst AND b.process = a.process WHERE e.type = 'CALLS'"""))
def flowchart_edges(spark, sf):
    """Calls between the steps of one flow."""
    e = edges(spark, sf)
    s = e.where("type = 'STEP_IN_PROCESS'").select(F.col("dst").alias("process"), "src").distinct()
    c = e.where("type = 'CALLS'").select("src", "dst").distinct()
    return c.join(s, "src").join(s.select("process", F.col("src").alias("dst")), ["process", "dst"], "left_semi").select("process", "src", "dst")


@book(graph("""SELECT n.repo, n.id, d.n AS connections FROM (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) d JOIN nodes n ON n.id = d.id WHERE n.repo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n.repo ORDER BY d.n DESC, n.id) <= 3"""))
def hotspots_by_repo(spark, sf):
    """The three most connected nodes of every repository."""
    d = oriented(edges(spark, sf), "both").groupBy(F.col("here").alias("id")).agg(F.count("*").alias("connections"))
    j = d.join(nodes(spark, sf).where("repo is not null").select("id", "repo"), "id")
    return top_n(j, ["repo"], [F.desc("connections"), F.col("id")], 3).select("repo", "id", "connections")


@book(graph("""SELECT h.repo, h.name, h.type, max_by(h.connections, (h.reportedAt, h.reportId)) AS reported FROM hotspots h WHERE h.name IS NOT NULL AND h.reportedAt IS NOT NULL GROUP BY 1, 2, 3"""))
def hotspot_reports(spark, sf):
    """The last report of each hotspot."""
    h = table(spark, sf, "hotspots").where("name is not null and reportedAt is not null")
    return h.groupBy("repo", "name", "type").agg(F.max_by("connections", F.struct("reportedAt", "reportId")).alias("reported"))


@book("""WITH x AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), y AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x)
    SELECT user_id, min(ts) AS start, count(*) AS events FROM y GROUP BY user_id, s""")
def sessions(spark, sf):
    """Sessions of a user: events less than six hours apart."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


@book("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS value FROM events GROUP BY 1, 2")
def daily_events(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("value"))


@book("""SELECT n_name, c_mktsegment, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def orders_by_nation(spark, sf):
    """A star join: orders are aggregated by customer before they meet the customer and nation."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    j = o.join(c, "c_custkey").join(F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name")), "n_nationkey")
    return j.groupBy("n_name", "c_mktsegment").agg(F.sum("n").alias("orders"), F.sum("t").cast("double").alias("total"))


@book("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS quantity, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS price FROM lineitem GROUP BY 1, 2""")
def line_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"))


@book("SELECT '| ' || name || ' | ' || CASE WHEN length(path) > 20 THEN substr(path, 1, 17) || '...' ELSE path END || ' |' AS row FROM registry ORDER BY name LIMIT 50")
def markdown_rows(spark, sf):
    """Rows of a text table, cells cut at a width; fifty rows are the report."""
    r = table(spark, sf, "registry")
    cell = F.when(F.length("path") > 20, F.concat(F.substring("path", 1, 17), F.lit("..."))).otherwise(F.col("path"))
    return r.orderBy("name").limit(50).select(F.concat(F.lit("| "), "name", F.lit(" | "), cell, F.lit(" |")).alias("row"))
