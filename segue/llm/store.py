"""Intermediate tables in the folder that the cluster shares, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words and around lines: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only a session inside one process (``local[n]``) may go without the setting; it
    gets a temporary folder, as in tests.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="segue-shared-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/segue-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder.

    Cuts the lineage: lost executors cost no recomputation of what lies before.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """64 bits that tell apart rows of one id with different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.large_binary()).to_pylist()
