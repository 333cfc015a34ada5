"""Lineage cuts for loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a level that are sent to all tasks; more are joined by a shuffle, so what passes the driver stays small.
FEW_ROWS = 50_000


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints into the folder the cluster names in spark.checkpoint.dir; a temporary one only under a local master."""
    shared_dir(df)
    return df.checkpoint(eager=True)


def shared_dir(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Written once as Parquet beside the checkpoints and read from there: computed once and smaller than a checkpoint."""
    path = f"{shared_dir(df)}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sided(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has so many rows: broadcast if they are few, else kept from being broadcast."""
    return F.broadcast(df) if rows <= FEW_ROWS else df.hint("merge")
