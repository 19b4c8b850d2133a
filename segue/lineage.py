"""Cutting lineage in iterative jobs so that lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session inside one process may go without the setting; it gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="segue-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps do not depend on how the rows came about."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for inputs that several steps read: built once, scanned by column."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of a spread table holds.
SPREAD_ROWS = 250_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows dealt out by ``key`` to so many tasks that each has about ``SPREAD_ROWS`` of the ``rows``.

    Windows over ``key`` keep that layout; a table that the session's number of shuffle
    partitions serves as well is left alone.
    """
    tasks = -(-rows // SPREAD_ROWS)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, key)
