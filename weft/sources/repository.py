"""Files of a repository, ZIP archives and their configuration as tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import ignored

#: Bytes of a file beyond which it isn't read as one value (a value of Spark has less than 2 GiB).
MOST_BYTES = 1 << 30


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files under a folder that a scan keeps, path relative to it; contents that are no UTF-8 have
    replacement characters. Ignored paths are dropped before any content is read, files are packed into tasks by size.
    A file of more than ``MOST_BYTES`` has a row with null content; it can be read by ranges."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.replace(".", r"\.") + "/", "")
    kept = files.select(clean.alias("path"), "length", "content").where(~ignored(F.col("path")))
    giant = kept.where(F.col("length") > MOST_BYTES).select("path", F.lit(None).cast("string").alias("content"))
    return kept.where(F.col("length") <= MOST_BYTES).mapInPandas(_decode, "path string, content string").unionByName(giant)


def _decode(batches):
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "content": [bytes(b).decode("utf-8", "replace") for b in pdf["content"]]})


def unzip(archives: DataFrame) -> DataFrame:
    """(archive, path, content) of the text members of ZIP files given as (path, content binary); a single common top folder
    is cut off, broken archives give no row."""

    def run(batches):
        for pdf in batches:
            rows = []
            for a, blob in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(bytes(blob)))
                except zipfile.BadZipFile:
                    continue
                names = [n for n in z.namelist() if not n.endswith("/")]
                tops = {n.split("/", 1)[0] for n in names}
                cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in n for n in names) else 0
                rows.extend((a, n[cut:], z.read(n).decode("utf-8", "replace")) for n in names)
            yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, content string").where(~ignored(F.col("path")))


def path_aliases(content: Column) -> Column:
    """map alias -> first target of a compiler configuration with comments; '*' ends are cut off."""
    bare = F.regexp_replace(content, r'("(?:[^"\\]|\\.)*")|/\*[\s\S]*?\*/|//[^\n]*', "$1")
    bare = F.regexp_replace(bare, r",(\s*[}\]])", "$1")
    paths = F.from_json(bare, "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")["compilerOptions"]["paths"]
    pairs = F.transform(F.map_entries(paths), lambda e: F.struct(F.regexp_replace(e["key"], r"\*$", "").alias("k"), F.regexp_replace(F.element_at(e["value"], 1), r"\*$", "").alias("v")))
    return F.map_from_entries(pairs)


def go_module(content: Column) -> Column:
    """The module path of a go.mod file, '' if there is none."""
    return F.regexp_extract(content, r"(?m)^module\s+(\S+)", 1)
