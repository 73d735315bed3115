"""Scalar functions over ids, paths, texts, arrays, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import ancestors, capitalised, cleaned, is_binary, make_id, name_factor, name_tokens, normal_path, percent, risk, sanitised_id, sanitised_text, short_path, slug, snippet, tokens, truncated
from weft.operators.search import cosine_distance
from weft.functions.fixed import ENTRY_NAMES, STOP_WORDS, UTILITY_NAMES
from weft.queries.base import Book
from weft.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql


@book("""SELECT seq, label || ':' || filePath AS made, upper(substr(name, 1, 1)) || substr(name, 2) AS capital, lower(substr(regexp_replace(name, '[^A-Za-z0-9]', '_', 'g'), 1, 20)) AS safe,
    array_to_string(string_split(filePath, '/')[greatest(1, len(string_split(filePath, '/')) - 2):], '/') AS short, substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS slug
    FROM parsed_nodes WHERE name IS NOT NULL AND filePath IS NOT NULL""")
def id_functions(spark, sf):
    n = table(spark, sf, "parsed_nodes").where("name is not null and filePath is not null")
    name, path = F.col("name"), F.col("filePath")
    return n.select("seq", make_id(F.col("label"), path).alias("made"), capitalised(name).alias("capital"), sanitised_id(name).alias("safe"), short_path(path).alias("short"), slug(name).alias("slug"))


@book("""WITH p AS (SELECT DISTINCT filePath AS path FROM parsed_nodes WHERE label = 'File' AND contains(filePath, '/')), x AS (SELECT path, string_split(path, '/') AS s FROM p)
    SELECT path, array_to_string(s[1:i], '/') AS folder, i::INTEGER AS level FROM x, unnest(range(1, len(s))) AS t(i)""")
def ancestor_paths(spark, sf):
    p = table(spark, sf, "parsed_nodes").where("label = 'File' and contains(filePath, '/')").select(F.col("filePath").alias("path")).distinct()
    return p.select("path", F.posexplode(ancestors(F.col("path"))).alias("i", "folder")).select("path", "folder", (F.col("i") + 1).alias("level"))


@book("""WITH p AS (SELECT DISTINCT filePath AS path FROM parsed_nodes WHERE label = 'File' AND contains(filePath, '/'))
    SELECT path, regexp_replace(path, '^[.]/', '') AS straight, array_to_string(list_concat(string_split(regexp_replace(path, '^[.]/', ''), '/')[1:len(string_split(regexp_replace(path, '^[.]/', ''), '/')) - 1], ['x.ts']), '/') AS sibling FROM p""")
def normal_paths(spark, sf):
    p = table(spark, sf, "parsed_nodes").where("label = 'File' and contains(filePath, '/')").select(F.col("filePath").alias("path")).distinct()
    return p.select("path", normal_path(F.concat(F.lit("./"), F.col("path"))).alias("straight"), normal_path(F.concat(F.col("path"), F.lit("/../x.ts"))).alias("sibling"))


@book("""SELECT seq, length(c) AS clean_length, CASE WHEN length(content) <= 80 THEN content ELSE substr(content, 1, CASE WHEN contains(substr(content, 1, 80), ' ') AND 80 - strpos(reverse(substr(content, 1, 80)), ' ') > 64 THEN 80 - strpos(reverse(substr(content, 1, 80)), ' ') ELSE 80 END) || '...' END AS short,
    ceil(length(content) / 4.0)::BIGINT AS tokens FROM (SELECT *, trim(regexp_replace(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), ' ') AS c FROM embeddable_nodes WHERE content IS NOT NULL)""")
def text_functions(spark, sf):
    n = table(spark, sf, "embeddable_nodes").where("content is not null")
    return n.select("seq", F.length(cleaned(F.col("content"))).cast("long").alias("clean_length"), truncated(F.col("content"), 80).alias("short"), F.ceil(F.length("content") / 4.0).cast("long").alias("tokens"))


@book("""SELECT seq, md5(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS sanitised,
    length(substr(content, 1, 1000)) > 0 AND length(regexp_replace(substr(content, 1, 1000), '[^\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g')) * 10 > length(substr(content, 1, 1000)) AS binary_like FROM embeddable_nodes WHERE content IS NOT NULL""")
def sanitised_contents(spark, sf):
    n = table(spark, sf, "embeddable_nodes").where("content is not null")
    return n.select("seq", F.md5(sanitised_text(F.col("content"))).alias("sanitised"), is_binary(F.col("content")).alias("binary_like"))


@book("""WITH f AS (SELECT id, string_split(content, chr(10)) AS l FROM (SELECT filePath AS id, content, row_number() OVER (PARTITION BY filePath ORDER BY seq) AS rn FROM embeddable_nodes WHERE label = 'File' AND content IS NOT NULL AND filePath IS NOT NULL) WHERE rn = 1),
    s AS (SELECT id AS node, filePath, startLine AS a, endLine AS b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM parsed_nodes) WHERE rn = 1 AND label = 'Method' AND startLine >= 0)
    SELECT node, array_to_string(l[greatest(a - 2, 0) + 1 : least(b + 2, len(l) - 1) + 1], chr(10)) AS code FROM s JOIN f ON f.id = s.filePath""")
def snippets(spark, sf):
    """Methods cut out of their file with two lines around."""
    f = table(spark, sf, "embeddable_nodes").where("label = 'File' and content is not null and filePath is not null").groupBy("filePath").agg(F.min(F.struct("seq", "content")).alias("f")).select("filePath", "f.content")
    n = table(spark, sf, "parsed_nodes").groupBy("id").agg(F.min(F.struct("seq", "label", "filePath", "startLine", "endLine")).alias("n")).select("id", "n.*")
    m = n.where("label = 'Method' and startLine >= 0").join(f, "filePath")
    return m.select(F.col("id").alias("node"), snippet(F.col("content"), F.col("startLine"), F.col("endLine")).alias("code"))


@book("""SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS words, coalesce(array_to_string(list_sort(list_distinct(t))[1:3], ' '), '') AS least
    FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 1) AS t FROM documents WHERE text IS NOT NULL)""")
def tokenised(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("words"), F.array_join(F.slice(F.array_sort(F.array_distinct("t")), 1, 3), " ").alias("least"))


def _matches(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(name, '{p}')" for p in patterns) + ")"


_LANGUAGE_NAMES = " ".join(f"WHEN language = '{x}' AND {_matches(p)} THEN 1.5" for x, p in ENTRY_NAMES.items() if x != "*")


@book(f"""SELECT DISTINCT name, language, CASE WHEN {_matches(UTILITY_NAMES)} THEN 0.3 WHEN {_matches(ENTRY_NAMES["*"])} THEN 1.5 {_LANGUAGE_NAMES} ELSE 1.0 END::DOUBLE AS factor FROM parsed_nodes WHERE name IS NOT NULL""")
def name_factors(spark, sf):
    """How much a name speaks for an entry point of its language."""
    return table(spark, sf, "parsed_nodes").where("name is not null").select("name", "language", name_factor(F.col("name"), F.col("language")).alias("factor")).distinct()


@book("""WITH n AS (SELECT DISTINCT name FROM parsed_nodes WHERE name IS NOT NULL), r AS (SELECT name, unnest(string_split_regex(name, '[\\s\\-_./\\\\(){}\\[\\]<>:;,!?''"]+')) AS t FROM n),
    p AS (SELECT name, unnest(list_distinct(list_concat(string_split(lower(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g')), ' '), [lower(t)]))) AS w FROM r)
    SELECT name, w AS token, count(*) AS n FROM p WHERE length(w) > 1 AND w NOT IN %s GROUP BY 1, 2""" % (STOP_WORDS,))
def name_words(spark, sf):
    """Search tokens of names, camel case split."""
    n = table(spark, sf, "parsed_nodes").where("name is not null").select("name").distinct()
    return n.select("name", F.explode(name_tokens(F.col("name"))).alias("token")).groupBy("name", "token").agg(F.count("*").alias("n"))


@book("""SELECT id, coalesce(len(keywords), 0) AS n, coalesce(array_to_string(list_transform(list_filter(keywords, lambda x: length(x) > 4), lambda x: upper(x)), ' '), '') AS long_ones, coalesce(list_contains(keywords, 'node'), false) AS has_node,
    coalesce(keywords[1], '-') AS first_one, greatest(20, least(300, round(symbolCount / 10.0)))::BIGINT AS cap, CASE WHEN symbolCount = 0 THEN 'low' WHEN symbolCount <= 5 THEN 'medium' WHEN symbolCount <= 15 THEN 'high' ELSE 'critical' END AS risk, printf('%.2f%%', round(cohesion * 100, 2)) AS cohesion FROM communities WHERE symbolCount IS NOT NULL AND cohesion IS NOT NULL""")
def array_functions(spark, sf):
    c = table(spark, sf, "communities").where("symbolCount is not null and cohesion is not null")
    k = F.col("keywords")
    return c.select(
        "id", F.when(k.isNull(), 0).otherwise(F.size(k)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform(F.filter(k, lambda x: F.length(x) > 4), F.upper), " "), F.lit("")).alias("long_ones"),
        F.coalesce(F.array_contains(k, "node"), F.lit(False)).alias("has_node"), F.coalesce(F.get(k, F.lit(0)), F.lit("-")).alias("first_one"),
        F.greatest(F.lit(20), F.least(F.lit(300), F.round(F.col("symbolCount") / 10.0))).cast("long").alias("cap"), risk(F.col("symbolCount")).alias("risk"), percent(F.col("cohesion"), 2).alias("cohesion"),
    )


@book("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS missing FROM events GROUP BY event_type")
def json_values(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count_if(F.col("k").isNull()).alias("missing"))


@book("SELECT label, count(*) AS n, round(avg(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))), 6) AS distance FROM embeddings GROUP BY label")
def mean_distance(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id = 0").select("embedding").scalar()
    return v.withColumn("q", q).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cosine_distance(F.col("embedding"), F.col("q"))), 6).alias("distance"))
