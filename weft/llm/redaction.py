"""Credentials of files as a table, and the files with the secret characters masked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexing import language_of
from .secrets import find_secrets, lines_of, redact
from .tokenizing import TOKENIZERS


def find_credentials(files: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(id, line_no, start, end, kind) of each credential; offsets in code points, end of its last part.

    ``files`` has id and content; null, empty and blank contents give no row. Repeated rows of an id give repeated rows.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for i, c in zip(pdf["id"], pdf["content"]):
                if not c:
                    continue
                found = find_secrets(c, folder, config=language_of(i) is None)
                rows.extend((i, n, p[0][0], p[-1][1], k) for (k, p), n in zip(found, lines_of(c, found)))
            yield pd.DataFrame(rows, columns=["id", "line_no", "start", "end", "kind"])

    return files.select("id", "content").mapInPandas(run, "id string, line_no long, start long, end long, kind string")


def redact_files(files: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(seq, id, content, secrets): each file with its secret characters masked, of the same length, and their number."""

    def run(batches):
        for pdf in batches:
            texts, counts = [], []
            for i, c in zip(pdf["id"], pdf["content"]):
                found = find_secrets(c, folder, config=language_of(i) is None) if c else []
                texts.append(redact(c, found) if found else c)
                counts.append(len(found))
            yield pd.DataFrame({"seq": pdf["seq"], "id": pdf["id"], "content": texts, "secrets": counts})

    return files.select("seq", "id", "content").mapInPandas(run, "seq long, id string, content string, secrets int")


def lines(found: DataFrame) -> DataFrame:
    """Distinct (id, line_no)."""
    return found.groupBy("id", "line_no").agg(F.lit(1).alias("one")).select("id", "line_no")
