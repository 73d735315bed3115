"""Loads, changes and the checks around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators.dml import delete_files, read_csv, update_columns, upsert, validated, write_csv
from weft.plans.graphview import code_nodes, edges, first_rows, nodes
from weft.queries.base import Book, graph
from weft.operators.store import scratch
from weft.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql


@book("SELECT id, label, name, repo FROM parsed_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1")
def first_wins(spark, sf):
    return first_rows(table(spark, sf, "parsed_nodes"), "id", "seq", "label", "name", "repo").select("id", "label", "name", "repo")


@book("""WITH old AS (SELECT id, name, indexedAt FROM parsed_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
    new AS (SELECT id, name, indexedAt FROM parsed_nodes WHERE id IS NOT NULL AND indexedAt >= TIMESTAMP '2025-05-01' QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexedAt DESC, seq DESC) = 1)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)""")
def upsert_nodes(spark, sf):
    """Later versions of a node replace the first."""
    n = table(spark, sf, "parsed_nodes").where("id is not null")
    old = first_rows(n, "id", "seq", "name", "indexedAt").select("id", "name", "indexedAt")
    new = n.where(F.col("indexedAt") >= F.lit("2025-05-01").cast("timestamp_ntz"))
    best = new.groupBy("id").agg(F.max_by(F.struct("name", "indexedAt"), F.struct("indexedAt", "seq")).alias("r")).select("id", "r.name", "r.indexedAt")
    return upsert(old, best, "id")


@book(graph(""", f AS (SELECT DISTINCT c.filePath FROM node_deletions d JOIN code c ON c.id = d.nodeId WHERE c.filePath IS NOT NULL), gone AS (SELECT id FROM nodes WHERE filePath IN (SELECT filePath FROM f))
    SELECT 'node' AS kind, id FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edge', id FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)"""))
def delete_cascade(spark, sf):
    """What is left after the files of deleted nodes go with all their edges."""
    n = nodes(spark, sf)
    f = table(spark, sf, "node_deletions").select(F.col("nodeId").alias("id")).join(code_nodes(spark, sf).select("id", "filePath"), "id").where("filePath is not null").select("filePath")
    kept, e, _ = delete_files(n, edges(spark, sf), f)
    return kept.select(F.lit("node").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), "id"))


_LABELS = ["Folder", "File", "Class", "Interface", "Function", "Method", "Community", "Process"]
_LABEL = "CASE WHEN starts_with({0}, 'comm_') THEN 'Community' WHEN starts_with({0}, 'proc_') THEN 'Process' ELSE split_part({0}, ':', 1) END"


@book(graph(f", x AS (SELECT type, {_LABEL.format('src')} AS from_label, {_LABEL.format('dst')} AS to_label FROM edges) SELECT type, from_label, to_label, count(*) AS skipped FROM x WHERE from_label NOT IN {tuple(_LABELS)} OR to_label NOT IN {tuple(_LABELS)} GROUP BY 1, 2, 3"))
def skipped_edges(spark, sf):
    """Edges whose ends have no known label, by type and labels."""
    from weft.functions.text import label_of

    bad = validated(edges(spark, sf), _LABELS)[1]
    return bad.groupBy("type", label_of(F.col("src")).alias("from_label"), label_of(F.col("dst")).alias("to_label")).agg(F.count("*").alias("skipped"))


@book("SELECT id, CASE WHEN symbolCount > 100 THEN 'Large' ELSE label END AS label, coalesce(description, '') AS description FROM communities")
def property_update(spark, sf):
    c = table(spark, sf, "communities").select("id", "label", F.coalesce("description", F.lit("")).alias("description"))
    big = table(spark, sf, "communities").where("symbolCount > 100").select("id", F.lit("Large").alias("label"))
    return update_columns(c, big, "id", ["label"])


@book("SELECT e.vec_id, e.label FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)")
def embedding_restore(spark, sf):
    """Kept vectors whose row is still there."""
    return table(spark, sf, "embeddings").select("vec_id", "label").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")


@book("SELECT name, rtrim(path, '/') AS path, coalesce(stats.files, 0) AS files FROM registry WHERE lastCommit IS NOT NULL AND name IN (SELECT repo FROM parsed_nodes)")
def registry_pruned(spark, sf):
    """Registered repositories that still have nodes and a commit."""
    r = table(spark, sf, "registry").where("lastCommit is not null").join(table(spark, sf, "parsed_nodes").select(F.col("repo").alias("name")).distinct(), "name", "left_semi")
    return r.select("name", F.regexp_replace("path", "/+$", "").alias("path"), F.coalesce("stats.files", F.lit(0)).alias("files"))


@book("SELECT seq, id, content FROM embeddable_nodes")
def csv_round_trip(spark, sf):
    """All rows, with every line end and with null and empty contents, written as CSV to the shared folder and read again."""
    folder = scratch(spark, "csv")
    write_csv(table(spark, sf, "embeddable_nodes").select("seq", "id", "content"), folder)
    return read_csv(spark, folder, "seq long, id string, content string")


@book("SELECT id, label, to_json(struct_pack(name := name, repo := repo)) AS body FROM parsed_nodes")
def json_export(spark, sf):
    """All rows; a null name or repository is written as null."""
    return table(spark, sf, "parsed_nodes").select("id", "label", F.to_json(F.struct("name", "repo"), {"ignoreNullFields": "false"}).alias("body"))


@book("SELECT label, count(*) AS files, sum(rows)::BIGINT AS rows FROM (SELECT label, count(*) AS rows FROM parsed_nodes WHERE id IS NOT NULL AND label <> '' GROUP BY label) GROUP BY label")
def csv_per_label(spark, sf):
    """Rows of one CSV folder per label, written and read again."""
    folder = scratch(spark, "csv-labels")
    n = table(spark, sf, "parsed_nodes").where("id is not null and label <> ''").select("label", "id", "name", "filePath")
    n.repartition("label").write.mode("overwrite").partitionBy("label").option("quoteAll", True).option("escape", '"').option("header", True).csv(folder)
    back = spark.read.schema("id string, name string, filePath string, label string").option("escape", '"').option("multiLine", True).option("header", True).csv(folder)
    return back.groupBy("label").agg(F.lit(1).cast("long").alias("files"), F.count("*").alias("rows"))


@book("SELECT count(*) FILTER (f) AS inserted, count(*) FILTER (NOT f) AS failed FROM (SELECT DISTINCT id, label IN ('Class', 'Function', 'Method') AS f FROM parsed_nodes WHERE id IS NOT NULL)")
def upsert_result(spark, sf):
    """How many nodes a batch would insert and how many are of no known label."""
    known = F.col("label").isin("Class", "Function", "Method")
    n = table(spark, sf, "parsed_nodes").where("id is not null").select("id", known.alias("f")).distinct()
    return n.agg(F.count_if(F.col("f")).alias("inserted"), F.count_if(~F.col("f")).alias("failed"))


@book(graph(""", gone AS (SELECT DISTINCT c.id FROM code c JOIN (SELECT DISTINCT x.filePath FROM node_deletions d JOIN code x ON x.id = d.nodeId WHERE x.filePath IS NOT NULL) f ON f.filePath = c.filePath)
    SELECT (SELECT count(*) FROM gone) AS nodes, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM gone) OR dst IN (SELECT id FROM gone)) AS edges"""))
def delete_counts(spark, sf):
    """How many nodes and edges the deletion of some files takes away."""
    from weft.operators.dml import delete_files
    from weft.plans.graphview import code_nodes, edges

    n, e = code_nodes(spark, sf), edges(spark, sf)
    f = table(spark, sf, "node_deletions").select(F.col("nodeId").alias("id")).join(n.select("id", "filePath"), "id").where("filePath is not null").select("filePath").distinct()
    _, left, gone = delete_files(n, e, f)
    removed = e.agg(F.count("*")).scalar() - left.agg(F.count("*")).scalar()
    return gone.agg(F.count("*").alias("nodes")).select("nodes", removed.alias("edges"))


@book("""SELECT name, rtrim(path, '/') AS path, CASE WHEN configId % 2 = 0 THEN 'renewed' ELSE lastCommit END AS lastCommit FROM registry UNION ALL SELECT 'added', '/new/place', 'first'""")
def registry_upsert(spark, sf):
    """The registry after a write of some entries by path: known paths are renewed, a new one is added."""
    from weft.operators.dml import upsert

    r = table(spark, sf, "registry").select("name", F.regexp_replace("path", "/+$", "").alias("path"), "lastCommit", "configId")
    new = r.where("configId % 2 = 0").withColumn("lastCommit", F.lit("renewed")).select("name", "path", "lastCommit")
    new = new.unionByName(spark.createDataFrame([("added", "/new/place", "first")], "name string, path string, lastCommit string"))
    return upsert(r.select("name", "path", "lastCommit"), new, "path")


@book("SELECT id, label, name, repo FROM parsed_nodes")
def json_restore(spark, sf):
    """Nodes written as JSON lines and read again."""
    folder = scratch(spark, "json")
    table(spark, sf, "parsed_nodes").select("id", "label", "name", "repo").write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
    return spark.read.schema("id string, label string, name string, repo string").json(folder)
