"""Session defaults and the places where intermediate tables are kept."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "weft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; settings of a running session stay."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=base | conf).getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: the shared one that the cluster names, a temporary one only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"weft-{os.getuid()}", "checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()
