"""Tool-shaped reports: impact with risk, enrichment with fallback, search with context, ids and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.operators.search import nearest
from weft.plans.graphview import edges, nodes
from weft.plans.patterns import top_n
from weft.plans.traverse import reach
from weft.queries.base import Book, graph
from weft.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql
TARGET = "Class:shared/model/entity.py:Entity"


def risk_of(direct: Column, flows: Column, clusters: Column, total: Column) -> Column:
    """Risk of a change by direct dependants, flows, clusters and all dependants; the highest level that any reaches."""
    return (
        F.when((direct >= 30) | (flows >= 5) | (clusters >= 5) | (total >= 200), "CRITICAL")
        .when((direct >= 15) | (flows >= 3) | (clusters >= 3) | (total >= 100), "HIGH")
        .when((direct >= 5) | (total >= 30), "MEDIUM").otherwise("LOW")
    )


@book(graph(f""", e AS (SELECT DISTINCT dst AS here, src AS there FROM edges WHERE type IN ('CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS')), w AS (SELECT '{TARGET}' AS id, 0 AS d UNION SELECT e.there, w.d + 1 FROM w JOIN e ON e.here = w.id WHERE w.d < 2),
    r AS (SELECT id, min(d) AS d FROM w GROUP BY id HAVING min(d) > 0), c AS (SELECT count(*) FILTER (d = 1) AS direct, count(*) AS total FROM r),
    f AS (SELECT count(DISTINCT dst) AS flows FROM edges WHERE type = 'STEP_IN_PROCESS' AND src IN (SELECT id FROM r)), k AS (SELECT count(DISTINCT dst) AS clusters FROM edges WHERE type = 'MEMBER_OF' AND src IN (SELECT id FROM r))
    SELECT direct, total, flows, clusters, CASE WHEN direct >= 30 OR flows >= 5 OR clusters >= 5 OR total >= 200 THEN 'CRITICAL' WHEN direct >= 15 OR flows >= 3 OR clusters >= 3 OR total >= 100 THEN 'HIGH' WHEN direct >= 5 OR total >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c, f, k"""))
def impact_report(spark, sf):
    """Dependants of a class within two levels, the flows and clusters they are in, and the risk."""
    e = edges(spark, sf)
    r = reach(e, spark.createDataFrame([(TARGET,)], "id string"), 2, "in", ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS")).select("id", "depth")
    met = r.select(F.col("id").alias("src"))
    flows = e.where("type = 'STEP_IN_PROCESS'").join(met, "src", "left_semi").agg(F.countDistinct("dst")).scalar()
    clusters = e.where("type = 'MEMBER_OF'").join(met, "src", "left_semi").agg(F.countDistinct("dst")).scalar()
    c = r.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("total")).select("direct", "total", flows.alias("flows"), clusters.alias("clusters"))
    return c.select("*", risk_of(F.col("direct"), F.col("flows"), F.col("clusters"), F.col("total")).alias("risk"))


@book(graph("""SELECT c.id, coalesce(nullif(c.description, ''), nullif(c.heuristicLabel, ''), 'Unknown') AS description, coalesce(c.enrichedBy, 'heuristic') AS enriched_by, coalesce(array_to_string(list_sort(m.l)[1:15], ','), '') AS members
    FROM communities c LEFT JOIN (SELECT e.dst AS id, list(DISTINCT n.name) AS l FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type = 'MEMBER_OF' AND n.name IS NOT NULL GROUP BY 1) m ON m.id = c.id"""))
def enriched_clusters(spark, sf):
    """Every community with a description, by its label where none was made, and up to fifteen member names."""
    m = edges(spark, sf).where("type = 'MEMBER_OF'").select("src", F.col("dst").alias("id")).join(nodes(spark, sf).where("name is not null").select(F.col("id").alias("src"), "name"), "src").select("id", "name").distinct()
    m = top_n(m, ["id"], [F.col("name")], 15).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))
    text = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.when(F.col("heuristicLabel") != "", F.col("heuristicLabel")), F.lit("Unknown"))
    c = table(spark, sf, "communities").select("id", text.alias("description"), F.coalesce("enrichedBy", F.lit("heuristic")).alias("enriched_by"))
    return c.join(m, "id", "left").na.fill("", ["members"])


@book("""SELECT vec_id, label, round(distance, 6) AS distance, NULL::VARCHAR AS connected, NULL::VARCHAR AS hops FROM (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 5)""")
def semantic_with_context(spark, sf):
    """The five nearest vectors in the flat shape of a context search, whose other columns are null."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id = 1").first()["embedding"]
    return nearest(v, q, 5).select("vec_id", "label", F.round("distance", 6).alias("distance"), F.lit(None).cast("string").alias("connected"), F.lit(None).cast("string").alias("hops"))


@book("""SELECT name, path, count(*) OVER (PARTITION BY lower(substr(name, 1, 4))) > 1 AS shared, lower(name) || CASE WHEN count(*) OVER (PARTITION BY lower(substr(name, 1, 4))) > 1 THEN '-' || substr(translate(to_base64(encode(path)), '+/', '-_'), 1, 6) ELSE '' END AS repo_id FROM registry""")
def repo_ids(spark, sf):
    """Ids of repositories; those that share the start of their name get a suffix from their path."""
    from pyspark.sql import Window

    shared = F.count("*").over(Window.partitionBy(F.lower(F.substring("name", 1, 4)))) > 1
    suffix = F.concat(F.lit("-"), F.substring(F.translate(F.base64(F.encode("path", "UTF-8")), "+/", "-_"), 1, 6))
    r = table(spark, sf, "registry").withColumn("shared", shared)
    return r.select("name", "path", "shared", F.concat(F.lower("name"), F.when(F.col("shared"), suffix).otherwise("")).alias("repo_id"))


@book("""SELECT event_type, count(*) AS runs, count(*) FILTER (value > 0) AS charged, round(count(*) FILTER (value > 100) / greatest(count(*), 1), 6)::DOUBLE AS rate, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / greatest(count(*), 1), 4) AS mean FROM events GROUP BY event_type""")
def run_metrics(spark, sf):
    """Rates and means of runs with a guard against no runs."""
    e = table(spark, sf, "events")
    n = F.greatest(F.count("*"), F.lit(1))
    return e.groupBy("event_type").agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 0).alias("charged"), F.round(F.count_if(F.col("value") > 100) / n, 6).alias("rate"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / n, 4).alias("mean"))


@book("""SELECT DISTINCT w AS word, regexp_extract('grep -rn -i "' || w || '" src/', '\\b(?:grep|rg|ag)\\s+(?:-\\S+\\s+)*["'']?([^"''\\s]+)', 1) AS pattern FROM (SELECT unnest(keywords) AS w FROM communities)""")
def search_patterns(spark, sf):
    """The pattern in a search command, flags skipped."""
    w = table(spark, sf, "communities").select(F.explode("keywords").alias("word")).distinct()
    cmd = F.concat(F.lit('grep -rn -i "'), F.col("word"), F.lit('" src/'))
    return w.select("word", F.regexp_extract(cmd, r"""\b(?:grep|rg|ag)\s+(?:-\S+\s+)*["']?([^"'\s]+)""", 1).alias("pattern"))


@book(graph(""", hit AS (SELECT id FROM nodes WHERE label = 'Function' AND contains(lower(name), 'cursor')), p AS (SELECT e.dst AS process, count(DISTINCT hit.id) AS matches FROM hit JOIN edges e ON e.src = hit.id AND e.type = 'STEP_IN_PROCESS' GROUP BY 1)
    SELECT coalesce(p.process, 'none') AS process, p.matches FROM p UNION ALL SELECT 'none', count(*) FROM hit WHERE id NOT IN (SELECT src FROM edges WHERE type = 'STEP_IN_PROCESS')"""))
def hits_by_flow(spark, sf):
    """Search hits by flow, and those in no flow together."""
    hit = nodes(spark, sf).where("label = 'Function' and contains(lower(name), 'cursor')").select(F.col("id").alias("src"))
    s = edges(spark, sf).where("type = 'STEP_IN_PROCESS'").select("src", F.col("dst").alias("process"))
    a = hit.join(s, "src").groupBy("process").agg(F.countDistinct("src").alias("matches"))
    return a.unionByName(hit.join(s.select("src").distinct(), "src", "left_anti").agg(F.count("*").alias("matches")).select(F.lit("none").alias("process"), "matches"))
