"""A keyed table in a shared folder that is changed bucket by bucket.

Rows lie in Parquet files under ``v=<version>/bucket=<hash of key>``. A step writes new files for the buckets it touches and a
manifest that says which versions hold each bucket; buckets it doesn't touch are neither read nor written. A step that is
run again overwrites its own version only, so it may be repeated after a failure. What the driver holds is the
manifest: a short list of versions per bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import ensure_checkpoints

#: Buckets of a table; so many that one bucket of the state is a small read.
BUCKETS = 64


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, folder: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    return hadoop, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, deleted when the application ends."""
    folder = f"{ensure_checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _, path, fs = _files(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Latest change and length of a file or folder of files; (0, 0) where there is none."""
    hadoop, p, fs = _files(spark, path)
    if not fs.exists(p):
        return 0, 0
    files = [s for s in fs.listStatus(p) if not s.isDirectory()]
    return max([s.getModificationTime() for s in files], default=0), sum(s.getLen() for s in files)


class Store:
    """Tables by name under one folder, with their manifests up to a version."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, before: int | None = None):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.schemas: dict[str, str] = {}
        self.held: dict[str, dict[int, list[int]]] = {}
        hadoop, path, fs = _files(spark, f"{folder}/manifest")
        have = sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []
        have = [v for v in have if before is None or v < before]
        if have:
            text = "".join(r[0] for r in spark.read.text(f"{folder}/manifest/{have[-1]}").collect())
            m = json.loads(text)
            self.buckets, self.schemas = m["buckets"], m["schemas"]
            self.held = {t: {int(b): v for b, v in x.items()} for t, x in m["held"].items()}

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets of a table of rows: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(bucket_of(key, self.buckets).alias("b")).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None, schema: str | None = None, below: int | None = None, of: int | None = None) -> DataFrame:
        """The rows of some buckets, or all; only versions and buckets of the manifest are read, if asked only those below a
        version or of one."""
        held = self.held.get(table, {})
        by: dict[int, list[int]] = {}
        for b in held if buckets is None else buckets:
            for v in held.get(b, ()):
                if (below is None or v < below) and (of is None or v == of):
                    by.setdefault(v, []).append(b)
        if not by:
            return self.spark.createDataFrame([], schema or self.schemas[table])
        cond = None
        for v, bs in by.items():
            c = (F.col("v") == v) & F.col("bucket").isin(bs)
            cond = c if cond is None else cond | c
        base = f"{self.folder}/{table}"
        df = self.spark.read.option("basePath", base).schema(self.schemas[table] + ", v int, bucket int").parquet(*[f"{base}/v={v}" for v in sorted(by)])
        return df.where(cond).drop("v", "bucket")

    def write(self, table: str, rows: DataFrame, key: str, version: int, touched: list[int] | None, replace: bool) -> list[int]:
        """Writes the rows of the touched buckets (None: those that rows have): instead of what they held, or besides it.
        A large bucket is split over several files and tasks, small ones share a task. Gives the buckets."""
        return self.put(table, rows.withColumn("bucket", bucket_of(key, self.buckets)).hint("rebalance", "bucket"), version, touched, replace)

    def put(self, table: str, rows: DataFrame, version: int, touched: list[int] | None, replace: bool = True) -> list[int]:
        """The same for rows that have their bucket and lie together by it."""
        self.schemas[table] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "bucket")
        folder = f"{self.folder}/{table}/v={version}"
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)
        if touched is None:
            _, path, fs = _files(self.spark, folder)
            touched = sorted(int(name[7:]) for s in fs.listStatus(path) if (name := s.getPath().getName()).startswith("bucket="))
        if replace:
            self.held.setdefault(table, {}).update({b: [version] for b in touched})
        else:
            self.keep(table, touched, version)
        return touched

    def keep(self, table: str, touched: list[int], version: int) -> None:
        """Lets the touched buckets hold the rows of a version besides what they hold."""
        held = self.held.setdefault(table, {})
        for b in touched:
            held[b] = [*[v for v in held.get(b, []) if v != version], version]

    def copy(self) -> Store:
        """The same files under a manifest of its own, for the next step."""
        out = Store.__new__(Store)
        out.spark, out.folder, out.buckets = self.spark, self.folder, self.buckets
        out.schemas, out.held = dict(self.schemas), {t: dict(h) for t, h in self.held.items()}
        return out

    def commit(self, version: int) -> None:
        text = json.dumps({"buckets": self.buckets, "schemas": self.schemas, "held": self.held})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/{version}")
