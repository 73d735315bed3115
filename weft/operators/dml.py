"""Loading and changing graph tables; every operation returns the new table, writers put it down partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import label_of


def upsert(table: DataFrame, changes: DataFrame, key: str, version: Column | None = None) -> DataFrame:
    """Rows of ``changes`` replace those of ``table`` with the same key; of several changes the one of the greatest version."""
    cols = table.columns
    c = changes
    if version is not None:
        c = changes.withColumn("__v", version).groupBy(key).agg(F.max_by(F.struct(*cols), "__v").alias("r")).select("r.*")
    return table.join(c.select(key).distinct(), key, "left_anti").select(*cols).unionByName(c.select(*cols))


def update_columns(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets columns by key; null in ``changes`` keeps the old value."""
    c = changes.select(key, *[F.col(x).alias(f"__{x}") for x in columns])
    out = table.join(c, key, "left")
    return out.select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in table.columns])


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, deleted nodes) after the nodes of some files (column filePath) are deleted with all their edges."""
    gone = nodes.join(paths.select("filePath").distinct(), "filePath", "left_semi").select("id").distinct()
    kept = nodes.join(gone, "id", "left_anti")
    e = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return kept, e, gone


def referential(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def validated(edges: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether both ends carry a known label."""
    ok = label_of(F.col("src")).isin(*labels) & label_of(F.col("dst")).isin(*labels)
    return edges.where(ok), edges.where(~ok)


#: Line ends are "\n" only, so that others stay as they are within quotes; blanks at the edges of a value are kept.
_CSV = {"header": True, "quoteAll": True, "escape": '"', "lineSep": "\n", "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _by_type(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, folder: str) -> None:
    """RFC 4180 text: every string quoted, quotes doubled; null is ``\\N``, and a value that reads so gets one more backslash."""
    _by_type(df, lambda c: F.when(c.rlike(r"\A\\+N\z"), F.concat(F.lit("\\"), c)).otherwise(c)).write.mode("overwrite").options(emptyValue='""', **_CSV).csv(folder)


def read_csv(spark, folder: str, schema: str) -> DataFrame:
    """What ``write_csv`` wrote, value by value."""
    return _by_type(spark.read.schema(schema).options(multiLine=True, emptyValue="", **_CSV).csv(folder), lambda c: F.when(c.rlike(r"\A\\{2,}N\z"), F.substring(c, 2, 2**31 - 1)).otherwise(c))
