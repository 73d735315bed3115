"""Parsing, embedding and scanning operators; their results have no SQL and are tested on fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators.embed import embed, embedding_text
from weft.queries.base import Book
from weft.sources.parser import enclosing, parse
from weft.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql


def _files(spark, sf):
    return table(spark, sf, "embeddable_nodes").where("label = 'File' and content is not null and filePath is not null").select(F.col("filePath").alias("path"), "content")


@book()
def parsed_definitions(spark, sf):
    """Definitions of all files."""
    return parse(_files(spark, sf)).where("kind = 'definition'").drop("kind", "detail").distinct()


@book()
def parsed_imports(spark, sf):
    return parse(_files(spark, sf)).where("kind = 'import'").select("file", "language", "name").distinct()


@book()
def parsed_heritage(spark, sf):
    return parse(_files(spark, sf)).where("kind = 'heritage'").select("file", F.col("label").alias("relation"), "name", F.col("detail").alias("parent")).distinct()


@book()
def calls_in_definitions(spark, sf):
    """Calls by the definition they stand in."""
    p = parse(_files(spark, sf))
    c = enclosing(p.where("kind = 'call'").select("file", "name", "startLine").distinct(), p.where("kind = 'definition'"))
    return c.groupBy("file", "caller", "name").agg(F.count("*").alias("calls"))


@book()
def node_embeddings(spark, sf):
    """Embeddings of all nodes with a text, one per id."""
    n = table(spark, sf, "embeddable_nodes").groupBy("id").agg(F.min(F.struct("seq", "label", "name", "filePath", "content")).alias("n")).select("id", "n.*")
    return embed(embedding_text(n))


@book("""SELECT fileKey, language, len(string_split(content, chr(10))) AS lines, length(content) AS chars FROM third_party_files""")
def outside_files(spark, sf):
    t = table(spark, sf, "third_party_files")
    return t.select("fileKey", "language", F.size(F.split("content", "\n")).cast("long").alias("lines"), F.length("content").cast("long").alias("chars"))
