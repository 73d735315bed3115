"""References to records that don't exist, kept as incremental state.

The state lies in a bucketed store (``operators.store``): an index of parents (per key: is it in a table without deletions, last
arrival, last deletion), the references seen so far, and those that wait for a parent, all by the key's bucket. A step takes
new references, arrivals and deletions. New references probe the buckets of the index they name; arrivals take references
with their key out of the waiting ones; deletions read the references of the deleted keys' buckets and let them wait again.
No other bucket is read or written, so a step costs what it touches, however much was seen before. Index entries merge by
maximum and a step may be repeated, and may come in any cut; the last state doesn't depend on it.

Keys are compared exactly. Only distinct keys are joined with the index. Where references meet a table of keys, it is
broadcast up to ``BROADCAST`` keys, by count; beyond that both sides are shuffled by key and salt, so that a key with a third
of all references is the work of many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.store import BUCKETS, Store, bucket_of, scratch
from weft.session import checkpointed

INDEX = "key string, fixed boolean, arrived timestamp_ntz, deleted timestamp_ntz"
REFS = "key string, id string, ref_end string, ref_table string, month string"
#: The tables that references name, and references as they are stored: end and table in one number, months counted.
TABLES = ["parsed_nodes", "shared_nodes", "communities", "processes"]
PACKED = "key string, id string, kind tinyint, month int"
#: Most keys that are broadcast (about 100 bytes each), and the parts of each key in a shuffle.
BROADCAST, SALTS = 200_000, 4


@dataclass
class State:
    store: Store
    version: int = 0

    @property
    def pending(self) -> DataFrame:
        """The waiting references as they stood after this step; later steps write other files."""
        return unpacked(self.store.read("pending", schema=PACKED))


def packed(refs: DataFrame) -> DataFrame:
    kind = (F.array_position(F.array(*map(F.lit, TABLES)), F.col("ref_table")) - 1) * 2 + (F.col("ref_end") == "target").cast("int")
    month = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int") - 1
    return refs.select("key", "id", kind.cast("tinyint").alias("kind"), month.alias("month"))


def unpacked(refs: DataFrame) -> DataFrame:
    month = F.format_string("%04d-%02d", F.floor(F.col("month") / 12), F.col("month") % 12 + 1)
    return refs.select("key", "id", F.when(F.col("kind") % 2 == 1, "target").otherwise("source").alias("ref_end"), F.element_at(F.array(*map(F.lit, TABLES)), F.floor(F.col("kind") / 2).cast("int") + 1).alias("ref_table"), F.when(F.col("month").isNotNull(), month).alias("month"))


def exists() -> Column:
    """Whether the parent of an index entry is there: in a fixed table or arrived, and not deleted after its last arrival."""
    gone = F.col("arrived").isNotNull() & F.col("deleted").isNotNull() & (F.col("deleted") > F.col("arrived"))
    return (F.coalesce("fixed", F.lit(False)) | F.col("arrived").isNotNull()) & ~gone


def merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.max("fixed").alias("fixed"), F.max("arrived").alias("arrived"), F.max("deleted").alias("deleted"))


def having_key(refs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """refs with (left_semi) or without (left_anti) a key of a checkpointed table of distinct keys."""
    if keys.limit(BROADCAST + 1).count() <= BROADCAST:
        return refs.join(F.broadcast(keys), "key", how)
    spread = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("id", "kind"), F.lit(SALTS)).cast("int"))
    return salted.join(spread.hint("merge"), ["key", "salt"], how).drop("salt")


def empty(spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS) -> State:
    """A state without entries; its folder is one in the shared checkpoint folder unless it is given."""
    return State(Store(spark, folder or scratch(spark, "orphans"), buckets))


def advance(state: State, refs: DataFrame, entries: DataFrame, version: int | None = None) -> State:
    """One step: new references and new index entries (arrivals and deletions)."""
    spark, n = refs.sparkSession, state.version + 1 if version is None else version
    store = state.store.copy()
    delta = checkpointed(merged(entries))
    by_entry = store.touched(delta, "key")
    by_ref = store.write("refs", packed(refs), "key", n, None, False)
    fresh = store.read("refs", by_ref, PACKED, of=n)
    # the touched keys as they stand now, each moved once; buckets as the unit of work are the partitions of the files too
    old = store.read("index", by_entry, INDEX).withColumn("new", F.lit(False))
    both = old.unionByName(delta.withColumn("new", F.lit(True))).withColumn("bucket", bucket_of("key", store.buckets)).repartition("bucket")
    standing = checkpointed(both.groupBy("bucket", "key").agg(*[F.max(c).alias(c) for c in ("fixed", "arrived", "deleted", "new")], F.max(~F.col("new") & exists()).alias("was")))
    store.put("index", standing.drop("new", "was"), n, by_entry)
    index = store.read("index", sorted({*by_entry, *by_ref}), INDEX)
    missing = checkpointed(fresh.select("key").distinct().join(index.where(exists()).select("key").hint("merge"), "key", "left_anti"))
    orphans = having_key(fresh, missing)
    there = checkpointed(standing.where(F.col("new") & exists()).select("key"))
    waiting = having_key(store.read("pending", by_entry, PACKED), there, "left_anti")
    gone = checkpointed(standing.where(F.col("new") & F.col("was") & ~exists()).select("key"))  # others wait already
    reopened = having_key(store.read("refs", store.touched(gone, "key"), PACKED, below=n), gone)
    # buckets with entries are written anew, those with references only get more rows
    names = [c.split()[0] for c in PACKED.split(", ")]
    store.write("pending", waiting.select(*names).unionByName(reopened.select(*names)).unionByName(orphans.select(*names)), "key", n, by_entry, True)
    store.keep("pending", sorted(set(by_ref) - set(by_entry)), n)
    store.commit(n)
    return State(store, n)


def table_of(key: Column, reason: Column) -> Column:
    """The table that a reference names, by the form of the id and the reason."""
    return (
        F.when(key.startswith("comm_") | (reason == "leiden-algorithm") & ~key.contains(":"), "communities")
        .when(key.startswith("proc_") | (reason == "trace-detection") & ~key.contains(":"), "processes")
        .when(F.substring_index(key, ":", -1).isNotNull() & key.rlike(r"^[A-Za-z]+:shared/"), "shared_nodes")
        .otherwise("parsed_nodes")
    )


def references(relationships: DataFrame) -> DataFrame:
    """One row per relationship row and end that is not null, with the time it came in."""
    ends = F.explode(F.array(F.struct(F.lit("source").alias("ref_end"), F.col("sourceId").alias("key")), F.struct(F.lit("target").alias("ref_end"), F.col("targetId").alias("key"))))
    r = relationships.select("id", "reason", "observedAt", F.col("ingestedAt").alias("at"), ends.alias("e")).where("e.key is not null")
    return r.select("id", F.col("e.ref_end").alias("ref_end"), F.col("e.key").alias("key"), table_of(F.col("e.key"), F.col("reason")).alias("ref_table"), F.date_format("observedAt", "yyyy-MM").alias("month"), "at")


def parents(nodes: DataFrame, fixed: list[DataFrame], deletions: DataFrame) -> DataFrame:
    """Index entries with the time they came in; fixed tables are there from the start."""
    null = F.lit(None).cast("timestamp_ntz")
    out = nodes.select(F.col("id").alias("key"), F.lit(False).alias("fixed"), F.col("indexedAt").alias("arrived"), null.alias("deleted"), F.col("indexedAt").alias("at"))
    out = out.unionByName(deletions.select(F.col("nodeId").alias("key"), F.lit(False).alias("fixed"), null.alias("arrived"), F.col("deletedAt").alias("deleted"), F.col("deletedAt").alias("at")))
    for t in fixed:
        out = out.unionByName(t.select(F.col("id").alias("key"), F.lit(True).alias("fixed"), null.alias("arrived"), null.alias("deleted"), null.alias("at")))
    return out.where("key is not null").select("key", "fixed", "arrived", "deleted", "at")


def replay(refs: DataFrame, entries: DataFrame, cuts: list[str]) -> list[tuple[str, State]]:
    """The states after each cut of time and at the end; rows without a time come first."""
    spark = refs.sparkSession
    state, out, low = empty(spark), [], None
    for cut in [*cuts, None]:
        def part(df, low=low, cut=cut):
            at = F.col("at")
            cond = F.lit(True)
            if low is not None:
                cond = cond & (at >= F.lit(low).cast("timestamp_ntz"))
            if cut is not None:
                cond = cond & ((at < F.lit(cut).cast("timestamp_ntz")) | (F.lit(low is None) & at.isNull()))
            elif low is None:
                cond = F.lit(True)
            return df.where(cond).drop("at")

        state = advance(state, part(refs), part(entries))
        out.append((cut or "end", state))
        low = cut
    return out
