"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Both inputs of a join are aggregated by the join key before they meet. What is joined are compact states, one row per key
and group, so a key that holds a third of all rows is one row a partition before the shuffle and one row after it. Counts
of pairs are products of counts, sums of one side are multiplied by the count of the other, and a last roll-up gives the
groups asked for. No key is split by value, sampled or capped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """(key, n) of all rows; a null key is one key."""
    return rows.groupBy(key).agg(F.count("*").alias(name))


def joined_states(rows: DataFrame, key: str, records: DataFrame, record_key: str) -> DataFrame:
    """(key, n, records, pairs): per non-null key of ``rows`` its number of rows, the number of records with that key (0 for
    none) and of pairs that the join of both has; both sides are compact before they meet."""
    left = key_counts(rows.select(key).where(F.col(key).isNotNull()), key)
    right = key_counts(records.select(F.col(record_key).alias(key)).where(F.col(key).isNotNull()), key, "records")
    both = left.join(right, key, "left").na.fill(0, ["records"])
    return both.select(key, "n", "records", (F.col("n") * F.col("records")).alias("pairs"))


def heavy_keys(rows: DataFrame, key: str, share: float, records: DataFrame | None = None, record_key: str = "id") -> DataFrame:
    """(key, n, records, pairs) of the non-null keys on at least ``share`` of all rows, null keys counted in the whole.

    ``records`` are what the keys refer to; a key without a record stays, with 0. An empty table has no heavy keys. The whole
    is a count that reads no column.
    """
    whole = rows.agg(F.count("*")).scalar()
    states = joined_states(rows, key, rows.limit(0) if records is None else records, key if records is None else record_key)
    return states.where(F.col("n") >= whole * F.lit(share))


def joined_aggregates(left: DataFrame, right: DataFrame, left_key: str, right_key: str, right_groups: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """count and sums of ``left JOIN right ON left_key = right_key GROUP BY right_groups``, without the joined rows.

    ``sums`` are exact (integer or decimal) expressions over ``left``. Null keys join nothing; repeated rows of either side
    multiply as they do in the join.
    """
    compact = left.where(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("__key")).agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    states = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("__key"), *right_groups).agg(F.count("*").alias("__m"))
    both = states.join(compact, "__key")
    return both.groupBy(*right_groups).agg(F.sum(F.col("__n") * F.col("__m")).alias("pairs"), *[F.sum(F.col(f"__{k}") * F.col("__m")).alias(k) for k in sums])


def connections(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, incoming, outgoing, connections) of every distinct non-null id of ``nodes``; ids without edges have 0.

    ``edges`` has sourceId and targetId; each row counts at each end that is not null, a self-loop twice.
    """
    ins = key_counts(edges.select(F.col("targetId").alias("id")).where("id is not null"), "id", "incoming")
    outs = key_counts(edges.select(F.col("sourceId").alias("id")).where("id is not null"), "id", "outgoing")
    ids = nodes.select("id").where("id is not null").distinct()
    both = ids.join(ins, "id", "left").join(outs, "id", "left").na.fill(0, ["incoming", "outgoing"])
    return both.select("id", "incoming", "outgoing", (F.col("incoming") + F.col("outgoing")).alias("connections"))
