"""The queries of the training-data operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.tables import table

from .checking import acceptance, check_files
from .encoding import decoded_bytes, encode_corpus, grown_otherwise, token_counts
from .lexing import EXTENSIONS
from .mixing import mix, rates, shares
from .origin import classify_origin
from .prose import fit_profiles, languages_in_code
from .redaction import find_credentials, lines, redact_files
from .splitting import cut_items, split_items
from .truncation import find_truncated

_SOURCE = r"(?:" + "|".join(sorted(x.replace(".", r"\.") for x in EXTENSIONS)) + r")$"


def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """File rows with content, of any extension."""
    return table(spark, sf, "embeddable_nodes").where("label = 'File' and content is not null")


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (id, content) of source files would move the contents; repeated rows are few and are left as they are."""
    return file_rows(spark, sf).where(F.col("id").rlike(_SOURCE))


def with_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddable nodes with maxlen and overlap of their repository's configuration (48 and 6 rows, fixed tables)."""
    limits = table(spark, sf, "registry").join(table(spark, sf, "embedding_config"), "configId").select(F.col("name").alias("repo"), F.col("maxSnippetLength").alias("maxlen"), F.col("overlapLength").alias("overlap"))
    return table(spark, sf, "embeddable_nodes").join(F.broadcast(limits), "repo").select("seq", "id", "content", "maxlen", "overlap")


def p1_found(spark, sf):
    return cut_items(with_limits(spark, sf)).select("id").distinct()


def p1_pieces(spark, sf):
    return split_items(with_limits(spark, sf))


def p1_covered(spark, sf):
    """Per item the code points that its pieces hold without the overlaps, and whether all fit and follow each other."""
    limits = with_limits(spark, sf).select("seq", "maxlen", F.least(F.coalesce("overlap", F.lit(0)), F.col("maxlen") - 1).alias("o"))
    cut = cut_items(with_limits(spark, sf)).select("seq", "id", "start", "end", F.length("text").alias("n"))
    sums = cut.groupBy("seq", "id").agg(F.sum("n").alias("all"), F.count("*").alias("pieces"), F.min("start").alias("first"), F.max("end").alias("last"), F.max("n").alias("longest"))
    fits = (F.col("first") == 0) & (F.col("longest") <= F.col("maxlen")) & (F.col("last") == F.col("all") - (F.col("pieces") - 1) * F.col("o"))
    return sums.join(limits, "seq").select("seq", "id", (F.col("all") - (F.col("pieces") - 1) * F.col("o")).alias("covered"), fits.alias("fits"))


def p3_found(spark, sf):
    return check_files(source_files(spark, sf)).where("errors > 0").select("id").distinct()


def p3_errors(spark, sf):
    return check_files(source_files(spark, sf)).where("errors > 0").select("id", "repo", "lang", "errors", "line", "message", "cause", F.array_join("all_errors", "; ").alias("all_errors"))


def p3_rates(spark, sf):
    return acceptance(check_files(source_files(spark, sf)))


def p3_languages(spark, sf):
    """Files, broken files and their rate per language over all repositories."""
    r = acceptance(check_files(source_files(spark, sf)))
    return r.groupBy("lang").agg(F.sum("files").alias("files"), F.sum("broken").alias("broken"), F.round(F.sum("broken") / F.sum("files"), 6).alias("rate"))


def p4_found(spark, sf):
    return lines(find_credentials(file_rows(spark, sf)))


def p4_spans(spark, sf):
    return find_credentials(file_rows(spark, sf)).distinct()


def p4_redacted(spark, sf):
    return redact_files(file_rows(spark, sf))


def p5_found(spark, sf):
    return classify_origin(source_files(spark, sf), table(spark, sf, "third_party_files")).where("origin is not null").select("id").distinct()


def p5_origins(spark, sf):
    return classify_origin(source_files(spark, sf), table(spark, sf, "third_party_files"))


def _prose(spark, sf):
    return languages_in_code(source_files(spark, sf), fit_profiles(table(spark, sf, "documents")))


def p7_found(spark, sf):
    return _prose(spark, sf).select("id", "lang")


def p7_shares(spark, sf):
    return _prose(spark, sf)


def p8_ids(spark, sf):
    return encode_corpus(table(spark, sf, "documents"))


def p8_counts(spark, sf):
    return token_counts(table(spark, sf, "documents"), "doc_id")


def p8_bytes(spark, sf):
    """Bytes that the ids of each text stand for: those of the text itself, as every id is a run of its bytes."""
    return decoded_bytes(encode_corpus(table(spark, sf, "documents")))


def p8_edited(spark, sf):
    """Whether the ids of each text come out alike when it grows by an append and edits."""
    return grown_otherwise(table(spark, sf, "documents"))


def p9_rates(spark, sf):
    """The sources that take part, with their most repeats and target shares."""
    sized = token_counts(table(spark, sf, "documents").where("source is not null and text is not null"), "source").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    return rates(sized, table(spark, sf, "source_weights")).select("source", F.col("maxRepeats").alias("max_repeats"), F.round("target", 9).alias("target_share"))


def p9_mixture(spark, sf):
    return mix(table(spark, sf, "documents"), table(spark, sf, "source_weights"))


def p9_shares(spark, sf):
    return shares(p9_mixture(spark, sf), table(spark, sf, "source_weights"))


def p10_found(spark, sf):
    return find_truncated(table(spark, sf, "documents")).where("cut").select("doc_id").distinct()


def p10_rates(spark, sf):
    """Texts, cut texts and their share per source; a null source is ''."""
    t = find_truncated(table(spark, sf, "documents"))
    return t.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("int")).alias("cut"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_covered, p3_found, p3_errors, p3_rates, p3_languages, p4_found, p4_spans, p4_redacted, p5_found, p5_origins, p7_found, p7_shares, p8_ids, p8_counts, p8_bytes, p8_edited, p9_rates, p9_mixture, p9_shares, p10_found, p10_rates)}

SQL = {
    "p1_found": """
        SELECT DISTINCT e.id FROM embeddable_nodes e JOIN registry r ON r.name = e.repo
        JOIN embedding_config c ON c.configId = r.configId WHERE length(e.content) > c.maxSnippetLength""",
    "p1_covered": """
        SELECT e.seq, e.id, length(e.content)::BIGINT AS covered, true AS fits FROM embeddable_nodes e JOIN registry r ON r.name = e.repo
        JOIN embedding_config c ON c.configId = r.configId WHERE length(e.content) > c.maxSnippetLength""",
    "p8_bytes": "SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents",
    "p8_edited": "SELECT doc_id, true AS same FROM documents",
    "p9_rates": """
        WITH w AS (SELECT source, max(weight) AS weight, max(maxRepeats)::BIGINT AS max_repeats FROM source_weights
                   WHERE source IS NOT NULL AND weight > 0 AND maxRepeats > 0 GROUP BY source),
             live AS (SELECT * FROM w WHERE source IN (SELECT source FROM documents WHERE source IS NOT NULL AND length(text) > 0))
        SELECT source, max_repeats, round(weight / (SELECT sum(weight) FROM live), 9) AS target_share FROM live""",
}
