"""Source files that do not parse: errors per file, and rates per repository and language."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexing import language_of
from .parsing_more import check_syntax

#: First error of the parser -> cause.
_CAUSES = (
    ("conflict", "merge conflict marker"),
    ("truncated", "unexpected end of file"),
    ("truncated", "unclosed"),
    ("bad token", "no token of the language"),
    ("layout", "ind"),
)


def cause_of(errors: list[tuple[int, str]]) -> str:
    """The first cause: a conflict marker anywhere, else the kind of the first error."""
    if any(m == "merge conflict marker" for _, m in errors):
        return "conflict"
    first = errors[0][1]
    for cause, start in _CAUSES:
        if first.startswith(start):
            return cause
    return "grammar"


def _refuted(text: str, lang: str) -> bool:
    """Whether the language's own parser, where this Python has it, accepts a file that the parser here rejected."""
    if lang != "python":
        return False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _check(batches):
    for pdf in batches:
        rows = []
        for q, i, r, c in zip(pdf["seq"], pdf["id"], pdf["repo"], pdf["content"]):
            lang = language_of(i)
            if lang is None or c is None:
                continue
            errors = check_syntax(c, lang)
            if errors and not _refuted(c, lang):
                rows.append((q, i, r, lang, len(errors), errors[0][0], errors[0][1], cause_of(errors), [f"{n}: {m}" for n, m in errors]))
            else:
                rows.append((q, i, r, lang, 0, None, None, None, []))
        yield pd.DataFrame(rows, columns=["seq", "id", "repo", "lang", "errors", "line", "message", "cause", "all_errors"]).astype({"line": "Int64"})


CHECKED = "seq long, id string, repo string, lang string, errors int, line long, message string, cause string, all_errors array<string>"


def check_files(files: DataFrame) -> DataFrame:
    """One row per source file: errors (0 if it parses), line and message of the first, its cause, and all of them.

    ``files`` has seq, id, repo, content; rows with another extension or null content give none. Empty files parse,
    in Go they don't (a package clause is needed).
    """
    return files.select("seq", "id", "repo", "content").mapInPandas(_check, CHECKED)


def acceptance(checked: DataFrame) -> DataFrame:
    """(repo, lang, files, broken, rate, truncated, conflicts) over distinct ids; a null repository is a group of its own."""
    per = checked.groupBy("id", "repo", "lang").agg(F.max("errors").alias("errors"), F.min("cause").alias("cause"))
    return per.groupBy("repo", "lang").agg(
        F.count("*").alias("files"),
        F.sum((F.col("errors") > 0).cast("int")).cast("long").alias("broken"),
        F.round(F.avg((F.col("errors") > 0).cast("int")), 6).alias("rate"),
        F.sum((F.col("cause") == "truncated").cast("int")).alias("truncated"),
        F.sum((F.col("cause") == "conflict").cast("int")).alias("conflicts"),
    )
