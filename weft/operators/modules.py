"""Modules of a code base: language-specific imports, module trees, what a change touches, and fuzzy paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.fixed import NOISE

from weft.functions.text import directory
from weft.plans.graphview import first_rows



def resolve_heritage(heritage: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, kind, child, parent) edges of (file, name, kind, parentName): the child is the definition of its file,
    else the first of its name, else a made id; the parent the first of its name, else a made id; no class extends itself."""
    own = symbols.groupBy("file", "name").agg(F.max_by("id", "seq").alias("own"))
    first = symbols.groupBy("name").agg(F.min_by("id", "seq").alias("first"))
    j = heritage.select("file", "name", "kind", "parentName").distinct().join(own, ["file", "name"], "left").join(first.withColumnRenamed("first", "near"), "name", "left")
    j = j.join(first.select(F.col("name").alias("parentName"), F.col("first").alias("up")), "parentName", "left")
    out = j.select("file", "name", "kind", F.coalesce("own", "near", F.concat(F.lit("Class:"), "file", F.lit(":"), "name")).alias("child"), F.coalesce("up", F.concat(F.lit("Class:"), "parentName")).alias("parent"))
    return out.where("kind <> 'extends' or child <> parent")


def rust_module(raw: Column, path: Column) -> Column:
    """Path without extension that a ``crate::``, ``self::`` or ``super::`` import points at, null for another import.

    The crate's root is the folder ``src`` of the importing file, or the first folder where there is none.
    """
    root = F.when(path.contains("/src/"), F.concat(F.substring_index(path, "/src/", 1), F.lit("/src"))).otherwise(F.substring_index(path, "/", 1))
    rest = F.regexp_replace(F.regexp_replace(raw, r"^(crate|self|super)::", ""), "::", "/")
    here = directory(path)
    return F.when(raw.startswith("crate::"), F.concat_ws("/", root, rest)).when(raw.startswith("self::"), F.concat_ws("/", here, rest)).when(raw.startswith("super::"), F.concat_ws("/", directory(here), rest))


def package_files(imports: DataFrame, files: DataFrame, extension: str, tests: str | None = None) -> DataFrame:
    """(file, package, imported): every file right in a folder whose path ends with the package (slashes for dots)."""
    want = imports.select("file", "package").distinct()
    f = files.where(F.col("path").endswith(extension))
    if tests:
        f = f.where(~F.col("path").endswith(tests))
    parts = F.split(directory(F.col("path")), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    by_end = f.select(F.col("path").alias("imported"), F.explode(ends).alias("package")).where("package <> ''")
    return want.join(by_end, "package").where("imported <> file").select("file", "package", "imported").distinct()


def java_static_owner(name: Column) -> Column:
    """The class of a static import: the last segment goes if it is '*', starts small or is all capitals."""
    return F.regexp_replace(name, r"\.(?:\*|[a-z]\w*|[A-Z][A-Z0-9_]*)$", "")


def fuzzy_path_score(path: Column, wanted: str) -> Column:
    """1000 for the path itself, more than 100 for an end of it, else 10 for each segment that is found in order."""
    w = wanted.lower()
    p = F.lower(path)
    parts = [x for x in w.split("/") if x]
    state = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"))
    for s in parts:
        at = F.locate(s, p.substr(state["at"], F.length(p)))
        state = F.when(at > 0, F.struct((state["at"] + at + len(s) - 1).cast("int").alias("at"), (state["n"] + 1).cast("int").alias("n"))).otherwise(state)
    score = F.when(state["n"] * 10 >= 5 * len(parts), state["n"] * 10).otherwise(0)
    return F.when(p == w, 1000).when(p.endswith(w), 100 + F.greatest(F.lit(0), 200 - F.length(p))).otherwise(score)


def module_tree(files: DataFrame, most_tokens: int = 30_000, least_files: int = 3) -> DataFrame:
    """(module, path): the top folder of each file, or two segments where the top holds too many tokens and files.

    ``files`` has path and tokens.
    """
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("Root")
    f = files.select("path", "tokens", top.alias("top"))
    big = f.groupBy("top").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).select("top", ((F.col("t") > most_tokens) & (F.col("n") > least_files)).alias("split"))
    two = F.substring_index("path", "/", 2)
    deep = F.size(F.split("path", "/")) > 2
    return f.join(big, "top").select(F.when(F.col("split") & deep, two).otherwise(F.col("top")).alias("module"), "path")


def affected_modules(modules: DataFrame, changed: DataFrame) -> DataFrame:
    """(module, files, added): changed files by the module they belong to; files of no module are added to 'Other'."""
    j = changed.select("path").distinct().join(modules.select("module", "path"), "path", "left")
    return j.groupBy(F.coalesce("module", F.lit("Other")).alias("module")).agg(F.count("*").alias("files"), F.count_if(F.col("module").isNull()).alias("added"))


def first_claims(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module): each file goes to the first module (by seq) that claims it, unclaimed ones to 'Other'."""
    won = first_rows(claims.select("path", "seq", "module"), "path", "seq", "module").select("path", "module")
    return files.select("path").distinct().join(won, "path", "left").select("path", F.coalesce("module", F.lit("Other")).alias("module"))


def fenced_json(text: Column) -> Column:
    """The JSON in a text: of the first fenced block, else from the first '{' to the last '}'; '' if there is none."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    return F.when(fenced != "", F.trim(fenced)).otherwise(F.regexp_extract(text, r"(\{[\s\S]*\})", 1))


def graph_views(nodes: DataFrame, edges: DataFrame) -> None:
    """Registers nodes and edges for ``spark.sql``."""
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")


def rust_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, raw, target, imported): the file that a module path of a Rust import stands for: ``.rs``, ``/mod.rs``, ``/lib.rs``,
    else the same for the path without its last segment; null where none is a file. ``imports`` has path, raw, target."""
    ends = ((".rs", 0), ("/mod.rs", 1), ("/lib.rs", 2))
    up = directory(F.col("target"))
    tries = F.array(*[F.struct(F.lit(n).alias("n"), F.concat("target", F.lit(e)).alias("p")) for e, n in ends], *[F.struct(F.lit(n + 3).alias("n"), F.concat(up, F.lit(e)).alias("p")) for e, n in ends])
    i = imports.select("path", "raw", "target").distinct()
    cand = i.select("path", "raw", "target", F.explode(tries).alias("c")).select("path", "raw", "target", "c.n", "c.p")
    hit = cand.join(files.select(F.col("path").alias("p")).distinct(), "p").groupBy("path", "raw", "target").agg(F.min(F.struct("n", "p")).alias("b"))
    return i.join(hit, ["path", "raw", "target"], "left").select("path", "raw", "target", F.col("b.p").alias("imported"))


def tree_nodes(tree: DataFrame) -> DataFrame:
    """(module, kind, files): leaves of a module tree and their parents (the first segment of modules of two), whose files are
    the union of their children's. ``tree`` has module, path."""
    leaves = tree.select("module", "path").distinct()
    parents = leaves.where(F.instr("module", "/") > 0).select(F.substring_index("module", "/", 1).alias("module"), "path").distinct()
    own = leaves.join(parents.select("module").distinct(), "module", "left_anti")
    both = leaves.join(parents.select("module").distinct(), "module", "left_semi").unionByName(parents).distinct()
    return own.groupBy("module").agg(F.count("*").alias("files")).select("module", F.lit("leaf").alias("kind"), "files").unionByName(both.groupBy("module").agg(F.count("*").alias("files")).select("module", F.lit("parent").alias("kind"), "files"))


def renewal(modules: DataFrame, changed: DataFrame, most_new: int = 5) -> DataFrame:
    """(way, modules, added): 'all' where more than ``most_new`` changed files are of no module, else 'some' with the number of
    modules to renew, 'Other' for the new files among them."""
    a = affected_modules(modules, changed)
    return a.agg(F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.count("*").alias("n")).select(F.when(F.col("added") > most_new, "all").otherwise("some").alias("way"), F.col("n").alias("modules"), "added")


__all__ = [
    "NOISE", "affected_modules", "fenced_json", "first_claims", "fuzzy_path_score", "graph_views", "java_static_owner", "module_tree", "package_files", "resolve_heritage", "rust_module", "renewal", "rust_files", "tree_nodes",
]
