"""Modules, heritage, language-specific imports, raw SQL and other small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators.modules import NOISE, affected_modules, renewal, rust_files, tree_nodes, fenced_json, first_claims, fuzzy_path_score, graph_views, java_static_owner, module_tree, package_files, resolve_heritage, rust_module
from weft.plans.graphview import code_nodes, edges, nodes
from weft.queries.base import Book, graph
from weft.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_FILES = "files AS (SELECT filePath AS path, min(seq) AS seq FROM parsed_nodes WHERE label = 'File' AND filePath IS NOT NULL GROUP BY 1)"


def _files(spark, sf):
    return table(spark, sf, "parsed_nodes").where("label = 'File' and filePath is not null").groupBy(F.col("filePath").alias("path")).agg(F.min("seq").alias("seq"))


@book(graph(""", sy AS (SELECT seq, filePath AS file, name, id FROM parsed_nodes WHERE label IN ('Class', 'Interface') AND filePath IS NOT NULL AND name IS NOT NULL),
    h AS (SELECT DISTINCT c.filePath AS file, c.name, CASE e.type WHEN 'EXTENDS' THEN 'extends' ELSE 'implements' END AS kind, split_part(e.dst, ':', -1) AS parentName FROM edges e JOIN code c ON c.id = e.src WHERE e.type IN ('EXTENDS', 'IMPLEMENTS') AND c.filePath IS NOT NULL AND c.name IS NOT NULL),
    own AS (SELECT file, name, max_by(id, seq) AS own FROM sy GROUP BY 1, 2), f AS (SELECT name, min_by(id, seq) AS first FROM sy GROUP BY 1),
    o AS (SELECT h.file, h.name, h.kind, coalesce(own.own, n.first, 'Class:' || h.file || ':' || h.name) AS child, coalesce(u.first, 'Class:' || h.parentName) AS parent
        FROM h LEFT JOIN own ON own.file = h.file AND own.name = h.name LEFT JOIN f n ON n.name = h.name LEFT JOIN f u ON u.name = h.parentName)
    SELECT * FROM o WHERE kind <> 'extends' OR child <> parent"""))
def heritage(spark, sf):
    e = edges(spark, sf).where("type in ('EXTENDS', 'IMPLEMENTS')").join(code_nodes(spark, sf).where("filePath is not null and name is not null").select(F.col("id").alias("src"), F.col("filePath").alias("file"), "name"), "src")
    h = e.select("file", "name", F.when(F.col("type") == "EXTENDS", "extends").otherwise("implements").alias("kind"), F.substring_index("dst", ":", -1).alias("parentName"))
    s = table(spark, sf, "parsed_nodes").where("label in ('Class', 'Interface') and filePath is not null and name is not null").select("seq", F.col("filePath").alias("file"), "name", "id")
    return resolve_heritage(h, s)


@book(f"""WITH {_FILES} SELECT path, CASE WHEN contains(path, '/src/') THEN split_part(path, '/src/', 1) || '/src' ELSE split_part(path, '/', 1) END || '/vendor/Report' AS target FROM files WHERE path LIKE '%.rs'""")
def rust_imports(spark, sf):
    """Where ``crate::vendor::Report`` points from every Rust file."""
    f = _files(spark, sf).where("path like '%.rs'")
    return f.select("path", rust_module(F.lit("crate::vendor::Report"), F.col("path")).alias("target"))


@book(f"""WITH {_FILES}, d AS (SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM files WHERE path LIKE '%.go' AND path NOT LIKE '%\\_test.go' ESCAPE '\\')
    SELECT DISTINCT a.path AS file, a.dir AS package, b.path AS imported FROM d a JOIN d b ON (b.dir = a.dir OR ends_with(b.dir, '/' || a.dir)) WHERE a.dir <> '' AND a.path <> b.path""")
def go_packages(spark, sf):
    """The files of a Go file's own package."""
    from weft.functions.text import directory

    f = _files(spark, sf)
    own = f.where("path like '%.go' and not endswith(path, '_test.go')").select(F.col("path").alias("file"), directory(F.col("path")).alias("package"))
    return package_files(own, f, ".go", "_test.go")


@book("""SELECT n AS name, regexp_replace(n, '\\.(?:\\*|[a-z]\\w*|[A-Z][A-Z0-9_]*)$', '') AS owner FROM (SELECT DISTINCT 'java.util.' || name || '.' || m AS n FROM parsed_nodes, (VALUES ('*'), ('of'), ('MAX_VALUE'), ('Entry')) AS t(m) WHERE label = 'Class' AND regexp_matches(name, '^[A-Za-z]+$'))""")
def java_static_imports(spark, sf):
    c = table(spark, sf, "parsed_nodes").where("label = 'Class'").where(F.col("name").rlike("^[A-Za-z]+$")).select("name").distinct()
    n = c.select(F.explode(F.array(*[F.concat(F.lit("java.util."), F.col("name"), F.lit(f".{m}")) for m in ("*", "of", "MAX_VALUE", "Entry")])).alias("name"))
    return n.select("name", java_static_owner(F.col("name")).alias("owner"))


@book(f"""WITH {_FILES}, p AS (SELECT path, lower(path) AS l FROM files) SELECT path, (CASE WHEN l = 'src/main.go' THEN 1000 WHEN ends_with(l, 'src/main.go') THEN 100 + greatest(0, 200 - length(l))
    WHEN strpos(l, 'src') > 0 AND strpos(substr(l, strpos(l, 'src') + 3), 'main.go') > 0 THEN 20 WHEN strpos(l, 'src') > 0 OR strpos(l, 'main.go') > 0 THEN 10 ELSE 0 END)::INTEGER AS score FROM p""")
def fuzzy_paths(spark, sf):
    return _files(spark, sf).select("path", fuzzy_path_score(F.col("path"), "src/main.go").cast("int").alias("score"))


_TOKENS = "ft AS (SELECT filePath AS path, max(ceil(length(content) / 4.0))::BIGINT AS tokens FROM embeddable_nodes WHERE label = 'File' AND content IS NOT NULL AND filePath IS NOT NULL GROUP BY 1)"
_TREE = f"""{_TOKENS}, tt AS (SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'Root' END AS top FROM ft), big AS (SELECT top, sum(tokens) > 30000 AND count(*) > 3 AS split FROM tt GROUP BY top),
    tree AS (SELECT CASE WHEN split AND len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE tt.top END AS module, path FROM tt JOIN big ON big.top = tt.top)"""


def _tree(spark, sf):
    f = table(spark, sf, "embeddable_nodes").where("label = 'File' and content is not null and filePath is not null")
    return module_tree(f.groupBy(F.col("filePath").alias("path")).agg(F.max(F.ceil(F.length("content") / 4.0)).cast("long").alias("tokens")))


@book(f"WITH {_TREE} SELECT module, count(*) AS files FROM tree GROUP BY module")
def module_sizes(spark, sf):
    return _tree(spark, sf).groupBy("module").agg(F.count("*").alias("files"))


@book(f"""WITH {_TREE}, ch AS (SELECT DISTINCT filePath AS path FROM parsed_nodes WHERE filePath IS NOT NULL AND indexedAt >= TIMESTAMP '2025-06-01' AND label <> 'Folder')
    SELECT coalesce(module, 'Other') AS module, count(*) AS files, count(*) FILTER (module IS NULL) AS added FROM ch LEFT JOIN tree ON tree.path = ch.path GROUP BY 1""")
def modules_to_renew(spark, sf):
    """Modules with files indexed since a day."""
    ch = table(spark, sf, "parsed_nodes").where("filePath is not null and label <> 'Folder'").where(F.col("indexedAt") >= F.lit("2025-06-01").cast("timestamp_ntz")).select(F.col("filePath").alias("path"))
    return affected_modules(_tree(spark, sf), ch)


@book(f"""WITH {_FILES}, cl AS (SELECT filePath AS path, seq, repo AS module FROM parsed_nodes WHERE label = 'Class' AND filePath IS NOT NULL), w AS (SELECT path, min_by(module, seq) AS module FROM cl GROUP BY 1)
    SELECT files.path, coalesce(w.module, 'Other') AS module FROM files LEFT JOIN w ON w.path = files.path""")
def claimed_files(spark, sf):
    """Files by the repository of their first class, the rest as 'Other'."""
    cl = table(spark, sf, "parsed_nodes").where("label = 'Class' and filePath is not null").select(F.col("filePath").alias("path"), "seq", F.col("repo").alias("module"))
    return first_claims(cl, _files(spark, sf))


@book(graph(f"""SELECT split_part(split_part(dst, ':', -1), '.', -1) AS called, count(*) AS n FROM edges WHERE type = 'CALLS' AND split_part(split_part(dst, ':', -1), '.', -1) NOT IN {NOISE} GROUP BY 1"""))
def telling_calls(spark, sf):
    called = F.substring_index(F.substring_index("dst", ":", -1), ".", -1)
    return edges(spark, sf).where("type = 'CALLS'").groupBy(called.alias("called")).agg(F.count("*").alias("n")).where(~F.col("called").isin(*NOISE))


@book("""SELECT id, CASE WHEN contains(t, '```') THEN trim(regexp_extract(t, '```(?:json)?\\s*([\\s\\S]*?)```', 1), chr(10) || ' ') ELSE regexp_extract(t, '(\\{[\\s\\S]*\\})', 1) END AS body FROM
    (SELECT id, CASE WHEN symbolCount % 2 = 0 THEN 'Here: ```json' || chr(10) || '{"id": "' || id || '"}' || chr(10) || '``` done' ELSE 'so {"id": "' || id || '"} it is' END AS t FROM communities WHERE symbolCount IS NOT NULL)""")
def json_in_text(spark, sf):
    """Answers with JSON in a fence or in the text."""
    obj = F.concat(F.lit('{"id": "'), "id", F.lit('"}'))
    t = F.when(F.col("symbolCount") % 2 == 0, F.concat(F.lit("Here: ```json\n"), obj, F.lit("\n``` done"))).otherwise(F.concat(F.lit("so "), obj, F.lit(" it is")))
    c = table(spark, sf, "communities").where("symbolCount is not null").select("id", t.alias("t"))
    return c.select("id", F.regexp_replace(fenced_json(F.col("t")), r"^\s+|\s+$", "").alias("body"))


@book(graph("SELECT n.label, count(*) AS n, count(DISTINCT e.type) AS types FROM nodes n JOIN edges e ON e.dst = n.id GROUP BY n.label HAVING count(*) > 10"))
def raw_sql(spark, sf):
    """Any SQL over the registered graph."""
    graph_views(nodes(spark, sf), edges(spark, sf))
    return spark.sql("SELECT n.label, count(*) AS n, count(DISTINCT e.type) AS types FROM nodes n JOIN edges e ON e.dst = n.id GROUP BY n.label HAVING count(*) > 10")


@book("""WITH r AS (SELECT id, heuristicLabel, coalesce(symbolCount, 0) AS s, coalesce(cohesion, 0) AS c FROM communities ORDER BY s DESC, id LIMIT 200)
    SELECT coalesce(nullif(heuristicLabel, ''), 'Unknown') AS name, sum(s)::BIGINT AS symbols, count(*) AS parts FROM r GROUP BY 1 ORDER BY symbols DESC, name LIMIT 10""")
def overfetched_clusters(spark, sf):
    """The 200 largest communities rolled up by name, the ten largest names."""
    r = table(spark, sf, "communities").select("id", "heuristicLabel", F.coalesce("symbolCount", F.lit(0)).alias("s")).orderBy(F.desc("s"), "id").limit(200)
    name = F.coalesce(F.when(F.col("heuristicLabel") != "", F.col("heuristicLabel")), F.lit("Unknown"))
    return r.groupBy(name.alias("name")).agg(F.sum("s").cast("long").alias("symbols"), F.count("*").alias("parts")).orderBy(F.desc("symbols"), "name").limit(10)


@book("SELECT event_type, user_id, n, rank() OVER (PARTITION BY event_type ORDER BY n DESC)::BIGINT AS place FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY place <= 5")
def busiest_users(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("n"))).cast("long")).where("place <= 5")


@book("""WITH p AS (SELECT DISTINCT id, communities FROM processes) SELECT p.id, coalesce(len(list_distinct(p.communities)), 0)::BIGINT AS touched, CASE WHEN coalesce(len(list_distinct(p.communities)), 0) > 1 THEN 'cross_community' ELSE 'intra_community' END AS kind FROM p""")
def process_kinds(spark, sf):
    """Flows by the number of different communities they touch."""
    n = F.coalesce(F.size(F.array_distinct("communities")), F.lit(0))
    return table(spark, sf, "processes").select("id", n.cast("long").alias("touched"), F.when(n > 1, "cross_community").otherwise("intra_community").alias("kind"))


@book(f"""WITH {_TREE}, l AS (SELECT DISTINCT module, path FROM tree), p AS (SELECT DISTINCT split_part(module, '/', 1) AS module, path FROM l WHERE contains(module, '/')), pm AS (SELECT DISTINCT module FROM p)
    SELECT module, 'leaf' AS kind, count(*) AS files FROM l WHERE module NOT IN (SELECT module FROM pm) GROUP BY 1 UNION ALL SELECT module, 'parent', count(*) FROM (SELECT module, path FROM l WHERE module IN (SELECT module FROM pm) UNION SELECT module, path FROM p) GROUP BY 1""")
def module_nodes(spark, sf):
    """Leaves and parents of the module tree with their files."""
    return tree_nodes(_tree(spark, sf))


@book(f"""WITH {_TREE}, ch AS (SELECT DISTINCT filePath AS path FROM parsed_nodes WHERE filePath IS NOT NULL AND indexedAt >= TIMESTAMP '2025-06-01' AND label <> 'Folder'),
    a AS (SELECT coalesce(module, 'Other') AS module, count(*) FILTER (module IS NULL) AS added FROM ch LEFT JOIN tree ON tree.path = ch.path GROUP BY 1) SELECT CASE WHEN coalesce(sum(added), 0) > 5 THEN 'all' ELSE 'some' END AS way, count(*) AS modules, coalesce(sum(added), 0)::BIGINT AS added FROM a""")
def renewal_way(spark, sf):
    """Whether the modules with new files are renewed alone or all are."""
    ch = table(spark, sf, "parsed_nodes").where("filePath is not null and label <> 'Folder'").where(F.col("indexedAt") >= F.lit("2025-06-01").cast("timestamp_ntz")).select(F.col("filePath").alias("path"))
    return renewal(_tree(spark, sf), ch)


_RUST = f"""WITH {_FILES}, r AS (SELECT path, unnest(regexp_extract_all(content, 'use (crate(?:::[a-z_]+)+)', 1)) AS raw FROM (SELECT filePath AS path, content FROM embeddable_nodes WHERE label = 'File' AND content IS NOT NULL AND filePath LIKE '%.rs')),
    t AS (SELECT DISTINCT path, raw, CASE WHEN contains(path, '/src/') THEN split_part(path, '/src/', 1) || '/src' ELSE split_part(path, '/', 1) END || '/' || replace(substr(raw, 8), '::', '/') AS target FROM r)"""


@book(_RUST + """, c AS (SELECT path, raw, target, n, p FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS n, unnest([target || '.rs', target || '/mod.rs', target || '/lib.rs', regexp_replace(target, '/[^/]*$', '') || '.rs', regexp_replace(target, '/[^/]*$', '') || '/mod.rs', regexp_replace(target, '/[^/]*$', '') || '/lib.rs']) AS p FROM t)),
    h AS (SELECT c.path, raw, target, arg_min(p, n) AS imported FROM c JOIN files ON files.path = c.p GROUP BY 1, 2, 3) SELECT t.path, t.raw, t.target, h.imported FROM t LEFT JOIN h ON h.path = t.path AND h.raw = t.raw AND h.target = t.target""")
def rust_resolved(spark, sf):
    """The module paths that Rust files use, and the files they stand for."""
    f = table(spark, sf, "embeddable_nodes").where("label = 'File' and content is not null and filePath like '%.rs'").select(F.col("filePath").alias("path"), F.explode(F.regexp_extract_all("content", F.lit("use (crate(?:::[a-z_]+)+)"), F.lit(1))).alias("raw"))
    return rust_files(f.select("path", "raw", rust_module(F.col("raw"), F.col("path")).alias("target")), _files(spark, sf))


@book(f"""WITH {_FILES}, d AS (SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM files WHERE path LIKE '%.java'), w AS (SELECT DISTINCT path AS file, string_split(dir, '/')[-1] AS package FROM d WHERE dir <> '')
    SELECT DISTINCT w.file, w.package, d.path AS imported FROM w JOIN d ON string_split(d.dir, '/')[-1] = w.package WHERE d.path <> w.file AND w.package <> ''""")
def java_wildcards(spark, sf):
    """The files of every package with the last name of a Java file's own, as a wildcard import takes them."""
    from weft.functions.text import directory

    f = _files(spark, sf)
    own = f.where("path like '%.java' and path like '%/%'").select(F.col("path").alias("file"), F.element_at(F.split(directory(F.col("path")), "/"), -1).alias("package"))
    return package_files(own, f, ".java")


@book("""WITH p AS (SELECT DISTINCT filePath AS path FROM parsed_nodes WHERE label = 'File' AND filePath IS NOT NULL), x AS (SELECT split_part(path, '/', 1) AS name, NOT contains(path, '/') AS is_file FROM p)
    SELECT name, is_file, count(*) AS files FROM x GROUP BY 1, 2 ORDER BY is_file, files DESC, name LIMIT 30""")
def root_listing(spark, sf):
    """Entries of the root: folders first, by files, then by name; the first thirty."""
    p = table(spark, sf, "parsed_nodes").where("label = 'File' and filePath is not null").select(F.col("filePath").alias("path")).distinct()
    x = p.select(F.substring_index("path", "/", 1).alias("name"), (F.instr("path", "/") == 0).alias("is_file"))
    return x.groupBy("name", "is_file").agg(F.count("*").alias("files")).orderBy("is_file", F.desc("files"), "name").limit(30)


@book("""WITH r AS (SELECT name, rtrim(path, '/') AS path FROM registry), c AS (SELECT DISTINCT rtrim(path, '/') || '/src/deep' AS cwd FROM registry UNION SELECT regexp_replace(rtrim(path, '/'), '/[^/]*$', '') FROM registry),
    m AS (SELECT c.cwd, r.name, length(r.path) AS l FROM c JOIN r ON starts_with(c.cwd || '/', r.path || '/') OR starts_with(r.path || '/', c.cwd || '/')) SELECT cwd, arg_min(name, (-l, name)) AS repo FROM m GROUP BY 1""")
def nearest_repo(spark, sf):
    """The registered repository of a working folder: one that holds it or lies in it, the longest path first. The registry is a
    fixed table of 48 rows, so its side of the comparison is bounded."""
    r = table(spark, sf, "registry").select("name", F.regexp_replace("path", "/+$", "").alias("path"))
    cwd = r.select(F.concat("path", F.lit("/src/deep")).alias("cwd")).union(r.select(F.regexp_replace("path", "/[^/]*$", ""))).distinct()
    a, b = F.concat("cwd", F.lit("/")), F.concat("path", F.lit("/"))
    m = cwd.join(F.broadcast(r), a.startswith(b) | b.startswith(a))
    return m.groupBy("cwd").agg(F.min(F.struct((-F.length("path")).alias("l"), "name")).alias("b")).select("cwd", F.col("b.name").alias("repo"))


@book("""SELECT name, path, count(*) OVER (PARTITION BY lower(name)) > 1 AS shared, lower(name) || CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN '-' || substr(translate(to_base64(encode(path)), '+/', '-_'), 1, 6) ELSE '' END AS repo_id
    FROM (SELECT name, path FROM registry UNION ALL SELECT name, path || '/copy' FROM registry WHERE configId = 1)""")
def colliding_repo_ids(spark, sf):
    """Ids of repositories; those whose id is equal get a suffix from their path."""
    r = table(spark, sf, "registry").select("name", "path", "configId")
    r = r.select("name", "path").unionByName(r.where("configId = 1").select("name", F.concat("path", F.lit("/copy")).alias("path")))
    shared = F.count("*").over(Window.partitionBy(F.lower("name"))) > 1
    suffix = F.concat(F.lit("-"), F.substring(F.translate(F.base64(F.encode("path", "UTF-8")), "+/", "-_"), 1, 6))
    return r.withColumn("shared", shared).select("name", "path", "shared", F.concat(F.lower("name"), F.when(F.col("shared"), suffix).otherwise("")).alias("repo_id"))
