"""Lookups with an order of preference: calls to definitions, imports to files, paths to repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends that are tried on an import path, in this order (fixed values of the data model).
CANDIDATES = ("", ".tsx", ".ts", ".jsx", ".js", "/index.tsx", "/index.ts", "/index.jsx", "/index.js", ".py", "/__init__.py", ".java", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".hh", ".cs", ".go", ".rs", "/mod.rs")
#: Confidence by the way a call was resolved (fixed values of the data model).
IMPORTED, SAME_FILE, UNIQUE, AMBIGUOUS = 0.9, 0.85, 0.5, 0.3


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, called, target, confidence, reason) of calls that have a definition.

    ``calls`` (file, called), ``symbols`` (seq, file, name, id), ``imports`` (file, imported). A definition of the same file
    wins (the last one of a name), then the first one of an imported file, then the first one anywhere. Definitions are
    brought to one row per name and file before they are joined, and calls to distinct pairs, so hot names stay small.
    """
    asked = calls.select("file", "called").distinct()
    local = symbols.groupBy("file", F.col("name").alias("called")).agg(F.max_by("id", "seq").alias("local"))
    by_file = symbols.groupBy(F.col("file").alias("imported"), F.col("name").alias("called")).agg(F.min(F.struct("seq", "id")).alias("first"))
    via = asked.join(imports.select("file", "imported").distinct(), "file").join(by_file, ["imported", "called"]).groupBy("file", "called").agg(F.min("first").alias("v"))
    anywhere = symbols.groupBy(F.col("name").alias("called")).agg(F.min(F.struct("seq", "id")).alias("w"), F.count("*").alias("n"))
    j = asked.join(local, ["file", "called"], "left").join(via, ["file", "called"], "left").join(anywhere, "called", "left")
    target = F.coalesce("local", "v.id", "w.id")
    conf = F.when(F.col("local").isNotNull(), SAME_FILE).when(F.col("v").isNotNull(), IMPORTED).when(F.col("n") == 1, UNIQUE).otherwise(AMBIGUOUS)
    why = F.when(F.col("local").isNotNull(), "same-file").when(F.col("v").isNotNull(), "import-resolved").otherwise("fuzzy-global")
    return j.where(target.isNotNull()).select("file", "called", target.alias("target"), conf.alias("confidence"), why.alias("reason"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(file, raw, resolved) of imports that name a file.

    ``imports`` (file, raw), ``files`` (path, seq). An alias prefix is rewritten; './' and '../' are taken from the importing
    file; everything else is looked up by the longest suffix of the path that is the end of a file, exact before case-blind.
    Candidates are exploded with their preference and joined by equality; the least preference wins.
    """
    from weft.functions.text import directory, normal_path

    raw = F.col("raw")
    target = raw
    for a, b in aliases:
        target = F.when(raw.startswith(a), F.concat(F.lit(b), F.substring(raw, len(a) + 1, 10_000))).otherwise(target)
    relative = raw.startswith(".")
    base = F.when(relative, normal_path(F.concat_ws("/", directory(F.col("file")), raw))).otherwise(target)
    ends = F.array(*[F.struct(F.lit(i).alias("e"), F.lit(x).alias("end")) for i, x in enumerate(CANDIDATES)])
    asked = imports.select("file", "raw").distinct().select("file", "raw", relative.alias("relative"), base.alias("base"))
    parts = F.split("base", "/")
    suffixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("s"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("suffix")))
    whole = F.array(F.struct(F.lit(-1).alias("s"), F.col("base").alias("suffix")))
    tried = asked.select("file", "raw", "relative", F.explode(F.when(F.col("relative"), whole).otherwise(F.concat(whole, suffixes))).alias("x")).select("file", "raw", F.col("x.s").alias("s"), "x.suffix", F.explode(ends).alias("y"))
    tried = tried.select("file", "raw", "s", F.col("y.e").alias("e"), F.concat("suffix", "y.end").alias("probe"))
    fparts = F.split("path", "/")
    index = files.select("path", "seq", F.explode(F.transform(F.sequence(F.lit(0), F.size(fparts) - 1), lambda i: F.struct((i == 0).alias("whole"), F.array_join(F.slice(fparts, i + 1, F.size(fparts)), "/").alias("suffix")))).alias("z"))
    exact = index.groupBy(F.col("z.suffix").alias("probe")).agg(F.min(F.struct("seq", "path")).alias("hit"), F.max(F.when(F.col("z.whole"), F.col("path"))).alias("whole"))
    blind = index.groupBy(F.lower("z.suffix").alias("low")).agg(F.min(F.struct("seq", "path")).alias("near"))
    j = tried.join(exact, "probe", "left").join(blind, F.lower("probe") == F.col("low"), "left")
    path = F.when(F.col("s") < 0, F.col("whole")).otherwise(F.coalesce("hit.path", "near.path"))
    rank = F.struct(F.col("s"), F.col("e"), F.col("hit").isNull().alias("blind"), path.alias("path"))
    return j.where(path.isNotNull()).groupBy("file", "raw").agg(F.min(rank).alias("r")).select("file", "raw", F.col("r.path").alias("resolved"))


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root that is the path or a folder above it; both normalised, trailing slashes dropped.

    The folders of every path are exploded and joined by equality, so no pair of path and root is compared.
    """
    p = F.regexp_replace("path", "/+$", "")
    parts = F.split("p", "/")
    above = paths.select("path", p.alias("p")).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    r = roots.select(F.regexp_replace("root", "/+$", "").alias("root")).distinct()
    return above.join(r, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
