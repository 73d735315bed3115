"""Keyword, vector and hybrid search as plans over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import tokens

#: BM25 parameters, and the constant of reciprocal ranks.
K1, B, RRF = 1.2, 0.75, 60


def bm25(docs: DataFrame, text: str, terms: Sequence[str], every: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """docs' kept columns with ``score`` for rows that have a term (or all of them): two scans, one of them for one row of
    corpus statistics; nothing but that row is shuffled, as term counts are taken inside each text."""
    terms = sorted(set(terms))
    t = docs.where(F.col(text).isNotNull()).withColumn("__t", tokens(F.col(text)))

    def times(term: str) -> Column:
        return F.size(F.filter("__t", lambda x: x == term))

    tf = [times(w).alias(f"__f{i}") for i, w in enumerate(terms)]
    counted = t.select(*keep, F.size("__t").alias("__l"), *tf)
    stats = counted.agg(F.count("*").alias("__n"), F.avg("__l").alias("__a"), *[F.sum((F.col(f"__f{i}") > 0).cast("int")).alias(f"__d{i}") for i in range(len(terms))])
    has = [F.col(f"__f{i}") > 0 for i in range(len(terms))]
    cond = has[0]
    for h in has[1:]:
        cond = (cond & h) if every else (cond | h)
    j = counted.where(cond).withColumn("__s", stats.select(F.struct("*")).scalar())
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = F.col(f"__s.__d{i}")
        idf = F.log(1 + (F.col("__s.__n") - df + 0.5) / (df + 0.5))
        f = F.col(f"__f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__l") / F.col("__s.__a")))
    return j.select(*keep, score.alias("score"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf): the inverted index as a table; tokens of a text are counted before they are shuffled."""
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def ranked(hits: DataFrame, order: Sequence[Column], n: int, base: int = 1) -> DataFrame:
    """The n best hits with their rank; the cut comes first, so that the rank is given to n rows only."""
    from pyspark.sql import Window

    best = hits.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1 + base)


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, most: float | None = None) -> DataFrame:
    """The k nearest vectors by cosine distance, then those closer than ``most``; exact, one scan with a top-k a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.withColumn("distance", cosine_distance(F.col("embedding"), q)).orderBy("distance", "vec_id").limit(k)
    return d if most is None else d.where(F.col("distance") < most)


def reciprocal_ranks(lists: dict[str, DataFrame], key: str, base: int = 1) -> DataFrame:
    """(key, score, sources) of ranked lists (key, rank from 1) put together by the sum of 1 / (RRF + rank)."""
    out = None
    for name, df in lists.items():
        d = df.select(key, (1.0 / (RRF + F.col("rank") - 1 + base)).alias("part"), F.lit(name).alias("source"))
        out = d if out is None else out.unionByName(d)
    return out.groupBy(key).agg(F.sum("part").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def matching_lines(files: DataFrame, key: str, text: str, pattern: str, ignore_case: bool = True) -> DataFrame:
    """(key, line_no, line) of the lines that match; lines are made only for files that match at all."""
    p = ("(?i)" if ignore_case else "") + pattern
    some = files.where(F.col(text).rlike(p)).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return some.where(F.col("line").rlike(p)).select(key, (F.col("i") + 1).alias("line_no"), "line")
