"""A stored inverted index with BM25: one table of postings for all labels, ranges of terms in files.

Texts are tokenised, stemmed and counted once, when the index is made. A search reads the postings of its terms (files and
row groups of other terms are pruned by their ranges) and the statistics, a row for each label: no text is read.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.stem import stem
from weft.operators.search import K1, B
from weft.operators.store import scratch, stamp
from weft.plans.patterns import top_n
from weft.session import checkpointed
from weft.sources.tables import table

_WORD = re.compile(r"[a-z0-9_]+")
_KEPT: dict[tuple, str] = {}
_POSTINGS = "label string, term string, id string, filePath string, tf long, dl long"
_STATS = "label string, texts long, average double"


def build_index(texts: DataFrame, folder: str, stemmed: bool = True) -> None:
    """Writes the index of (label, id, filePath, text); null texts are not in it, and an id has one text a label."""

    def counted(batches):
        for pdf in batches:
            rows = []
            for label, i, path, text in zip(pdf["label"], pdf["id"], pdf["filePath"], pdf["text"]):
                words = [w for w in _WORD.findall(text.lower()) if len(w) > 1]
                n = Counter(map(stem, words) if stemmed else words)
                rows.extend((label, t, i, path, k, len(words)) for t, k in n.items())
                rows.append((label, None, i, path, 0, len(words)))
            yield pd.DataFrame(rows, columns=["label", "term", "id", "filePath", "tf", "dl"])

    # a text's words are counted where it lies; what is shuffled are its postings, once, into ranges of terms
    rows = checkpointed(texts.where("text is not null").select("label", "id", "filePath", "text").mapInPandas(counted, _POSTINGS))
    rows.where("term is null").groupBy("label").agg(F.count("*").alias("texts"), F.avg("dl").alias("average")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    rows.where("term is not null").repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")


def kept_index(spark: SparkSession, sf: str, stemmed: bool = True) -> str:
    """The index over the content of all embeddable nodes; made when it is first asked for, again when the table has changed."""
    key = (spark.sparkContext.applicationId, sf, stemmed, stamp(spark, f"{sf}/embeddable_nodes.parquet"))
    if key not in _KEPT:
        n = table(spark, sf, "embeddable_nodes").where("id is not null and content is not null")
        one = n.groupBy("label", "id").agg(F.min(F.struct("seq", "filePath", "content")).alias("n")).select("label", "id", "n.filePath", F.col("n.content").alias("text"))
        folder = scratch(spark, "postings")
        build_index(one, folder, stemmed)
        _KEPT[key] = folder
    return _KEPT[key]


def search(spark: SparkSession, folder: str, query: str, per_label: int = 20, stemmed: bool = True) -> DataFrame:
    """(label, id, filePath, score) of the best ``per_label`` texts of each label that have a word of the query."""
    words = sorted({stem(w) if stemmed else w for w in _WORD.findall(query.lower()) if len(w) > 1})
    p = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings").where(F.col("term").isin(words))
    s = spark.read.schema(_STATS).parquet(f"{folder}/stats")
    df = p.groupBy("label", "term").agg(F.count("*").alias("df"))  # at most labels x words rows
    known = F.broadcast(df.join(s, "label"))
    idf = F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("average")))
    hits = p.join(known, ["label", "term"]).groupBy("label", "id", "filePath").agg(F.round(F.sum(part), 9).alias("score"))
    return top_n(hits, ["label"], [F.desc("score"), F.col("id")], per_label, "place").drop("place")


def search_files(spark: SparkSession, folder: str, query: str, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """(filePath, score, place): the scores of each label's best added up by file, the best files."""
    from weft.operators.search import ranked

    h = search(spark, folder, query, limit, stemmed).where("filePath is not null").groupBy("filePath").agg(F.round(F.sum("score"), 6).alias("score"))
    return ranked(h, [F.desc("score"), F.col("filePath")], limit).withColumnRenamed("rank", "place")
