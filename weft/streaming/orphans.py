"""Pending orphans of a stream of references, arrivals and deletions: the steps of ``operators.orphans`` as micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.orphans import INDEX, REFS, State, advance
from weft.operators.store import BUCKETS, Store

#: One table for the stream: kind 'ref' uses the columns of a reference, kind 'entry' those of an index entry.
CHANGES = "kind string, id string, ref_end string, key string, ref_table string, month string, fixed boolean, arrived timestamp_ntz, deleted timestamp_ntz"


def changes_of(refs: DataFrame, entries: DataFrame) -> DataFrame:
    r, e = refs.withColumn("kind", F.lit("ref")), entries.withColumn("kind", F.lit("entry"))
    return r.unionByName(e, allowMissingColumns=True)


def follow(changes: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS):
    """Keeps index, references and pending orphans under ``target``, a bucketed store; a micro-batch reads and writes the
    buckets it touches, and a batch that is run again starts from the manifest before it, so that nothing counts twice."""

    def step(batch: DataFrame, n: int) -> None:
        refs = batch.where("kind = 'ref'").selectExpr(*[c.split()[0] for c in REFS.split(", ")])
        entries = batch.where("kind = 'entry'").selectExpr(*[c.split()[0] for c in INDEX.split(", ")])
        advance(State(Store(batch.sparkSession, target, buckets, before=n)), refs, entries, n)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def waiting(spark: SparkSession, target: str) -> DataFrame:
    """The pending orphans that the stream has left."""
    return State(Store(spark, target)).pending
