"""One text file per key in a local or shared folder, written by the tasks."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

#: Folder value of a missing key, and the characters that stand as %XX in folder names, as ``partitionBy`` has them.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{}\[\]^]""")


def local_folder(path: str) -> str | None:
    """The folder of a ``file:`` address; None for any other, which may name another store."""
    found = re.fullmatch(r"file:(?://)?(/[^/].*)", path, re.DOTALL)
    return found and found[1].rstrip("/")


def _folder_value(key: str | None) -> str:
    return ESCAPED.sub(lambda x: f"%{ord(x[0]):02X}", key) if key else NO_KEY


def _writer(root: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes runs of equal keys as files.  A file gets its name when it is whole, and every attempt at a task gives it the same one."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = out = part = None
        n = 0

        def close() -> None:
            out.close()
            os.replace(part, f"{os.path.dirname(part)}/part-{current[1] & (1 << 64) - 1:016x}.txt")

        try:
            for batch in batches:
                keys, numbers, lines = (column.to_pylist() for column in batch.columns)
                at = 0
                for file, run in groupby(zip(keys, numbers, strict=True)):
                    end = at + sum(1 for _ in run)
                    if file != current:
                        if out is not None:
                            close()
                        folder = f"{root}/{name}={_folder_value(file[0])}"
                        os.makedirs(folder, exist_ok=True)
                        part = f"{folder}/_{uuid.uuid4().hex}"
                        current, out, n = file, open(part, "wb"), n + 1
                    out.write(b"".join([(line or b"") + b"\n" for line in lines[at:end]]))
                    at = end
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out.close()
                if os.path.exists(part):
                    os.remove(part)
            raise
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
    return write


def write_texts(rows: DataFrame, key: str, line: str, folder: str) -> int:
    """The lines of every key as a file ``key=value/part-*.txt`` below ``folder``, whose former content goes; the number of files.

    ``rows`` are dealt by ``key``, and those of a key stand together in the order of their lines.
    Files come into a folder beside, which takes the name when all are there.
    """
    new = f"{os.path.dirname(folder)}/.{os.path.basename(folder)}-{uuid.uuid4().hex}"
    os.makedirs(new)
    try:
        placed = rows.select(c(key).cast("string").alias("k"), F.xxhash64(key).alias("h"), c(line).cast("binary").alias("line"))
        n = placed.mapInArrow(_writer(new, key), "n long").agg(F.sum("n")).first()[0] or 0
        open(f"{new}/_SUCCESS", "wb").close()
        if os.path.lexists(folder):
            shutil.rmtree(folder)
        os.rename(new, folder)
    except BaseException:
        shutil.rmtree(new, ignore_errors=True)
        raise
    return n
