"""Text of nodes for embedding, and a deterministic embedding by hashed tokens where no model file is at hand."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import cleaned, directory, file_name, truncated

LABELS = ("Function", "Class", "Method", "Interface", "File")


def embedding_text(nodes: DataFrame, most: int = 500, most_file: int = 300) -> DataFrame:
    """(id, text) of embeddable nodes: label and name, file, folder, and the cleaned start of the content."""
    n = nodes.where(F.col("label").isin(*LABELS) & F.col("id").isNotNull())
    body = F.when(F.col("label") == "File", truncated(cleaned(F.col("content")), most_file)).otherwise(truncated(cleaned(F.col("content")), most))
    head = F.concat_ws(": ", "label", "name")
    return n.select("id", F.concat_ws("\n", head, F.concat(F.lit("File: "), file_name(F.col("filePath"))), F.concat(F.lit("Directory: "), directory(F.col("filePath"))), F.coalesce(body, F.lit(""))).alias("text"))


def embed(texts: DataFrame, known: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """(id, embedding) of texts whose id is not in ``known``; unit vectors of hashed words, zero for an empty text."""
    todo = texts if known is None else texts.join(known.select("id").distinct(), "id", "left_anti")

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                v = np.zeros(dim, np.float32)
                for w in (t or "").lower().split():
                    h = crc32(w.encode("utf-8", "replace"))
                    v[h % dim] += 1.0 if h & 0x80000000 else -1.0
                n = float(np.linalg.norm(v))
                out.append((v / n if n else v).tolist())
            yield pd.DataFrame({"id": pdf["id"], "embedding": out})

    return todo.select("id", "text").mapInPandas(run, "id string, embedding array<float>")
