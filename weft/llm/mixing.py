"""A mixture of sources with target shares of tokens, by Poisson replication.

A source whose tokens must come r times into the mixture has mean rate r. The number of copies of a document is the
quantile of a Poisson distribution at a uniform number seeded by the document's hash, cut at the source's most repeats; the
Poisson parameter is the one whose number, so cut, has the mean r. The uniform number is the document's place among the
tokens of its source in the order of the hashes: each document has a uniform place, and the places of a source are spread
evenly, so that what is drawn differs from its mean by little more than a document. Places are sums over hash buckets
(per source and bucket, so a source with most of the rows is many groups) and within a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import checkpointed

from .encoding import token_counts
from .tokenizing import TOKENIZERS

#: Groups of each source's documents by hash; they only spread the work and don't change the result.
BUCKETS = 4096
#: Where no size is given, the part of the copies it may have that the scarcest source gets on average; a cut Poisson number
#: has a mean below its greatest value.
FILL = 0.9


def cut_cdf(parameter: float, most: int) -> list[float]:
    """P(N <= k) of a Poisson number for k < most, as far as it differs from 1."""
    out, total = [], 0.0
    for k in range(most):
        total += math.exp(k * math.log(parameter) - parameter - math.lgamma(k + 1)) if parameter > 0 else float(k == 0)
        out.append(min(1.0, total))
        if total >= 1.0 - 2.0**-53 and k > parameter:
            break
    return out


def cut_mean(parameter: float, most: int) -> float:
    """The mean of a Poisson number cut at ``most``: the sum of P(N > k) for k < most."""
    return math.fsum(1.0 - c for c in cut_cdf(parameter, most))


def parameter_for(rate: float, most: int) -> float:
    """The Poisson parameter whose number, cut at ``most``, has the mean ``rate``; a rate of ``most`` or more is all copies."""
    if rate <= 0:
        return 0.0
    lo, hi = rate, 2.0 * most + 60.0 + 8.0 * math.sqrt(most)
    if rate >= cut_mean(hi, most):
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        if cut_mean(mid, most) < rate:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def rates(totals: DataFrame, weights: DataFrame, total: int | None = None, fill: float = FILL) -> DataFrame:
    """(source, tokens, maxRepeats, target, rate, cdf) of the sources with tokens and a positive weight and maxRepeats.

    ``totals`` has source, tokens. Targets are the weights scaled to 1. Without ``total`` the mixture is so large that the
    scarcest source is repeated ``fill`` times maxRepeats on average; with it, sources that can't reach their part give
    all copies they may. A source listed twice counts with its largest weight and maxRepeats.
    """
    w = weights.where("source is not null and weight > 0 and maxRepeats > 0").groupBy("source").agg(F.max("weight").cast("double").alias("weight"), F.max("maxRepeats").cast("long").alias("maxRepeats"))
    live = checkpointed(totals.where("tokens > 0").join(w, "source"))  # a row a source
    sums = live.agg(F.sum("weight").alias("w"), F.min(F.col("tokens") * F.col("maxRepeats") / F.col("weight")).alias("most"))
    known = live.withColumn("s", sums.select(F.struct("*")).scalar())
    size = F.lit(float(total)) if total is not None else F.col("s.most") * F.col("s.w") * fill
    target = F.col("weight") / F.col("s.w")
    rated = known.select("source", "tokens", "maxRepeats", target.alias("target"), (target * size / F.col("tokens")).alias("rate"))

    def tables(batches):
        for pdf in batches:
            yield pdf.assign(cdf=[cut_cdf(parameter_for(r, int(m)), int(m)) for r, m in zip(pdf["rate"], pdf["maxRepeats"])])

    return rated.mapInPandas(tables, "source string, tokens long, maxRepeats long, target double, rate double, cdf array<double>")


def draw(sized: DataFrame, rated: DataFrame, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """``sized`` (doc_id, source, tokens, all tokens positive) with ``place`` in [0, 1) and ``n``, the number of copies."""
    placed = sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.floor((F.shiftrightunsigned("h", 11) / float(1 << 53)) * buckets).cast("int"))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed), F.lit("within")), 11) / float(1 << 53)
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.withColumn("base", before).join(rated.select("source", F.col("tokens").alias("all"), "cdf"), "source").select("source", "bucket", "base", "all", "cdf")
    order = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("h", 11), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("ahead", F.coalesce(F.sum("tokens").over(order), F.lit(0))).join(bases, ["source", "bucket"])
    place = (F.col("base") + F.col("ahead") + F.col("tokens") * unit) / F.col("all")
    return out.withColumn("place", place).withColumn("n", F.size(F.filter("cdf", lambda c: c <= F.col("place"))))


def mix(documents: DataFrame, weights: DataFrame, seed: int = 17, total: int | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, copy, source, tokens, mix_order): every document as often as drawn, in an order shuffled over all sources.

    Sources without a row in ``weights``, with a null or non-positive weight or maxRepeats, and documents without a source
    are not in the mixture; a source listed twice counts with its largest weight. Texts without tokens never change a share
    and are left out. doc_id is unique. The shares really reached are ``shares`` of the result.
    """
    sized = checkpointed(token_counts(documents.where("source is not null and text is not null"), "doc_id", "source", folder=folder).where("tokens > 0"))
    rated = rates(sized.groupBy("source").agg(F.sum("tokens").alias("tokens")), weights, total)
    out = draw(sized, rated, seed).where("n > 0").select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return out.withColumn("mix_order", F.xxhash64("doc_id", "copy", F.lit(seed + 1))).orderBy("mix_order", "doc_id", "copy").select("doc_id", "copy", "source", "tokens", "mix_order")


def shares(mixture: DataFrame, weights: DataFrame) -> DataFrame:
    """Per source of the weights: weight, max_repeats, target_share (among sources that are in the mixture), tokens, copies,
    most_copies and the share really reached. The mixture is read once."""
    held = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), F.max("copy").alias("most_copies"))
    out = checkpointed(weights.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("maxRepeats").alias("max_repeats")).join(held, "source", "left"))
    sums = out.agg(F.coalesce(F.sum("tokens"), F.lit(1)).alias("all"), F.coalesce(F.sum(F.when(F.col("tokens").isNotNull(), F.col("weight"))), F.lit(1.0)).alias("live"))
    return out.withColumn("s", sums.select(F.struct("*")).scalar()).select(
        "source", "weight", "max_repeats", F.when(F.col("tokens").isNotNull(), F.col("weight") / F.col("s.live")).otherwise(0.0).alias("target_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.coalesce("tokens", F.lit(0)) / F.col("s.all")).alias("share"),
    )
