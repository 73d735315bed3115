"""Keyword, vector, hybrid and line search, renaming and references in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators.search import bm25, matching_lines, nearest, postings, ranked, reciprocal_ranks
from weft.plans.graphview import code_nodes, edges
from weft.plans.patterns import top_n
from weft.queries.base import Book, graph
from weft.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql
TERMS = ("cache", "lock", "index")
NAME, NEW = "writeLine", "printLine"


def _bm25(source: str, key: str, text: str, terms, every=False, extra: str = "") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(sorted(terms)))
    d = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(terms)))
    cond = (" AND " if every else " OR ").join(f"f{i} > 0" for i in range(len(terms)))
    return f"""WITH c AS (SELECT {key}{extra}, len(t) AS l, {tf} FROM (SELECT {key}{extra}, list_filter(string_split_regex(lower({text}), '[^a-z0-9_]+'), lambda x: length(x) > 1) AS t FROM {source} WHERE {text} IS NOT NULL)),
        s AS (SELECT count(*) AS n, avg(l) AS a, {d} FROM c), hits AS (SELECT {key}{extra}, {score} AS score FROM c, s WHERE {cond})"""


@book(_bm25("documents", "doc_id", "text", TERMS) + " SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_any(spark, sf):
    return bm25(table(spark, sf, "documents"), "text", TERMS, keep=["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@book(_bm25("documents", "doc_id", "text", TERMS, True) + " SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_all_terms(spark, sf):
    return bm25(table(spark, sf, "documents"), "text", TERMS, every=True, keep=["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@book(_bm25("embeddable_nodes", "filePath", "content", ("basket", "prune"), extra=", seq") + " SELECT filePath, round(sum(score), 6) AS score, count(*) AS hits FROM hits WHERE filePath IS NOT NULL GROUP BY filePath ORDER BY score DESC, filePath LIMIT 20")
def bm25_by_file(spark, sf):
    """Scores of symbols and files added up by file, the best twenty."""
    h = bm25(table(spark, sf, "embeddable_nodes"), "content", ("basket", "prune"), keep=["filePath", "seq"]).where("filePath is not null")
    return h.groupBy("filePath").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("hits")).orderBy(F.desc("score"), "filePath").limit(20)


@book("""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 1)) AS term FROM documents WHERE text IS NOT NULL)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""")
def posting_stats(spark, sf):
    p = postings(table(spark, sf, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_NAMES = "SELECT DISTINCT name FROM parsed_nodes WHERE name IS NOT NULL"


@book(f"SELECT name, (CASE WHEN lower(name) = 'scan' THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight FROM ({_NAMES}) WHERE starts_with(lower(name), 'scan')")
def prefix_search(spark, sf):
    n = table(spark, sf, "parsed_nodes").where("name is not null").select("name").distinct()
    return n.where(F.lower("name").startswith("scan")).select("name", F.when(F.lower("name") == "scan", 2.0).otherwise(1.0).alias("weight"))


@book(f"SELECT name, levenshtein(name, 'loadTicket')::INTEGER AS distance FROM ({_NAMES}) WHERE levenshtein(name, 'loadTicket') <= 3")
def fuzzy_search(spark, sf):
    n = table(spark, sf, "parsed_nodes").where("name is not null").select("name").distinct()
    d = F.levenshtein(F.col("name"), F.lit("loadTicket"), 3)
    return n.select("name", d.alias("distance")).where("distance >= 0")


_NEAR = "SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10"


def _query(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


@book(f"SELECT vec_id, round(distance, 6) AS distance FROM ({_NEAR}) WHERE distance < 0.6")
def vector_topk(spark, sf):
    """The ten nearest vectors, then those closer than 0.6: the cut comes before the threshold."""
    return nearest(table(spark, sf, "embeddings"), _query(spark, sf), 10, 0.6).select("vec_id", F.round("distance", 6).alias("distance"))


_HYBRID = _bm25("documents", "doc_id", "text", TERMS) + f""", b AS (SELECT doc_id AS k, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM hits QUALIFY r <= 20),
    v AS (SELECT vec_id AS k, row_number() OVER (ORDER BY round(distance, 9), vec_id) AS r FROM ({_NEAR})),
    u AS (SELECT k, 1.0 / (60 + r - 1 + {{base}}) AS p, 'keyword' AS s FROM b UNION ALL SELECT k, 1.0 / (60 + r - 1 + {{base}}), 'vector' FROM v)
    SELECT k AS key, round(sum(p), 9)::DOUBLE AS score, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources FROM u GROUP BY k"""


def _hybrid(spark, sf, base):
    b = bm25(table(spark, sf, "documents"), "text", TERMS, keep=["doc_id"]).select(F.col("doc_id").alias("key"), F.round("score", 9).alias("score"))
    v = nearest(table(spark, sf, "embeddings"), _query(spark, sf), 10).select(F.col("vec_id").alias("key"), F.round("distance", 9).alias("distance"))
    lists = {"keyword": ranked(b, [F.desc("score"), F.col("key")], 20), "vector": ranked(v, [F.col("distance"), F.col("key")], 10)}
    r = reciprocal_ranks(lists, "key", base)
    return r.select("key", F.round("score", 9).alias("score"), "sources")


@book(_HYBRID.format(base=1))
def rrf_merge(spark, sf):
    """Documents and vectors by one number space, put together by reciprocal ranks from 1."""
    return _hybrid(spark, sf, 1)


@book(_HYBRID.format(base=0))
def rrf_merge_from_zero(spark, sf):
    return _hybrid(spark, sf, 0)


_GROUPED = _bm25("embeddable_nodes", "id", "content", ("basket", "prune"), extra=", seq").replace("WITH c AS", "{graph}, c AS") + """,
    best AS (SELECT id, max(score) AS score FROM hits GROUP BY id), top AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM best QUALIFY r <= 50),
    sy AS (SELECT id, 1.0 / (60 + r) AS score FROM top),
    p AS (SELECT DISTINCT sy.id, sy.score, e.dst AS process FROM sy JOIN edges e ON e.src = sy.id AND e.type = 'STEP_IN_PROCESS'),
    c2 AS (SELECT e.src AS id, max(c.cohesion) AS cohesion FROM edges e JOIN communities c ON c.id = e.dst WHERE e.type = 'MEMBER_OF' GROUP BY 1)
    SELECT process, count(*) AS symbols, round(sum(p.score) + 0.1 * coalesce(max(c2.cohesion), 0), 6)::DOUBLE AS priority FROM p LEFT JOIN c2 ON c2.id = p.id GROUP BY process"""


@book(_GROUPED.replace("{graph}", graph("").rstrip()))
def grouped_query(spark, sf):
    """Keyword hits as symbols, grouped by the flows they are steps of: sum of reciprocal ranks plus a tenth of the best cohesion."""
    h = bm25(table(spark, sf, "embeddable_nodes"), "content", ("basket", "prune"), keep=["id", "seq"]).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))
    s = ranked(h, [F.desc("score"), F.col("id")], 50).select("id", (1.0 / (60 + F.col("rank"))).alias("score"))
    e = edges(spark, sf)
    p = e.where("type = 'STEP_IN_PROCESS'").select(F.col("src").alias("id"), F.col("dst").alias("process")).join(F.broadcast(s), "id").distinct()
    c = table(spark, sf, "communities").select(F.col("id").alias("dst"), "cohesion")
    m = e.where("type = 'MEMBER_OF'").join(F.broadcast(s.select(F.col("id").alias("src"))), "src", "left_semi").join(c, "dst").groupBy(F.col("src").alias("id")).agg(F.max("cohesion").alias("cohesion"))
    return p.join(m, "id", "left").groupBy("process").agg(F.count("*").alias("symbols"), F.round(F.sum("score") + 0.1 * F.coalesce(F.max("cohesion"), F.lit(0.0)), 6).alias("priority"))


@book("""SELECT seq, (i)::INTEGER AS line_no, l AS line FROM (SELECT seq, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM embeddable_nodes WHERE label = 'File' AND content IS NOT NULL AND filePath LIKE '%.go') WHERE regexp_matches(l, '(?i)println\\(.*cache')""")
def grep_lines(spark, sf):
    f = table(spark, sf, "embeddable_nodes").where("label = 'File' and content is not null and filePath like '%.go'")
    return matching_lines(f, "seq", "content", r"println\(.*cache")


@book(f"""SELECT id, i::INTEGER AS line_no, l AS old_line, regexp_replace(l, '\\bhits\\b', 'found', 'g') AS new_line FROM (SELECT DISTINCT id, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i
    FROM embeddable_nodes WHERE label = 'File' AND content IS NOT NULL AND contains(content, 'hits')) WHERE regexp_matches(l, '\\bhits\\b')""")
def rename_preview(spark, sf):
    """Lines that a renaming changes, at word borders only."""
    f = table(spark, sf, "embeddable_nodes").where("label = 'File' and content is not null and contains(content, 'hits')")
    m = matching_lines(f, "id", "content", r"\bhits\b", ignore_case=False).distinct()
    return m.select("id", "line_no", F.col("line").alias("old_line"), F.regexp_replace("line", r"\bhits\b", "found").alias("new_line"))


@book("""SELECT DISTINCT s.id AS symbol, f.id AS file FROM (SELECT id, name, filePath FROM parsed_nodes WHERE label = 'Class' AND name IS NOT NULL) s
    JOIN (SELECT id, filePath, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*'))) AS w FROM embeddable_nodes WHERE label = 'File' AND content IS NOT NULL) f ON f.w = s.name WHERE f.filePath IS DISTINCT FROM s.filePath""")
def text_references(spark, sf):
    """Files that name a class of another file; words of a file are joined by equality."""
    s = table(spark, sf, "parsed_nodes").where("label = 'Class' and name is not null").select(F.col("id").alias("symbol"), F.col("name").alias("w"), F.col("filePath").alias("own")).distinct()
    f = table(spark, sf, "embeddable_nodes").where("label = 'File' and content is not null").select(F.col("id").alias("file"), "filePath", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("w"))
    return f.join(s, "w").where(~F.col("filePath").eqNullSafe(F.col("own"))).select("symbol", "file").distinct()


@book(graph(""", hit AS (SELECT id, filePath FROM code WHERE label IN ('Function', 'Method') AND contains(lower(name), 'ticket')), f AS (SELECT filePath, count(*) AS n FROM hit WHERE filePath IS NOT NULL GROUP BY 1 ORDER BY n DESC, filePath LIMIT 5),
    s AS (SELECT h.id, row_number() OVER (PARTITION BY h.filePath ORDER BY h.id) AS rn FROM hit h JOIN f ON f.filePath = h.filePath QUALIFY rn <= 3),
    o AS (SELECT src AS id, count(DISTINCT dst) AS callees FROM edges WHERE type = 'CALLS' GROUP BY 1), i AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM edges WHERE type = 'CALLS' GROUP BY 1)
    SELECT s.id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM s LEFT JOIN o ON o.id = s.id LEFT JOIN i ON i.id = s.id"""))
def augment(spark, sf):
    """The five files with most symbols that fit a word, three symbols of each, with callers and callees."""
    hit = code_nodes(spark, sf).where("label in ('Function', 'Method') and contains(lower(name), 'ticket')").select("id", "filePath")
    f = hit.where("filePath is not null").groupBy("filePath").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "filePath").limit(5)
    s = top_n(hit.join(F.broadcast(f.select("filePath")), "filePath"), ["filePath"], [F.col("id")], 3).select("id")
    e = edges(spark, sf).where("type = 'CALLS'")
    o = e.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("callees"))
    i = e.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))
    return s.join(o, "id", "left").join(i, "id", "left").na.fill(0, ["callers", "callees"])
