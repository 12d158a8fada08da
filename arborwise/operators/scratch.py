"""Cutting lineage: checkpoints and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(df: DataFrame) -> str:
    """The checkpoint folder that the session names; a temporary one only where all runs on this machine."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="arborwise-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df from a checkpoint."""
    folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the same folder: computed once, and only the columns that are asked for are read."""
    path = f"{folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
