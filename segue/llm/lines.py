"""Line deduplication: range-partitioned hashes, streamed in order; keep bitmaps per document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segue.llm.store import raw, saved, text_key

#: Shortest key in code points, and number of documents that a repeated key must be in.
MIN_POINTS, MIN_DOCS = 40, 5
STRIP = b" \t\n\x0b\x0c\r"
LINES = "h1 long, h2 long, doc_id long, text_key long, line int, n_lines int"
FOUND = "h1 long, h2 long, doc_id long, text_key long, line int, n_lines int, docs int, keeper long"
_LOWEST = np.iinfo(np.int64).min


def _hashed_lines(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, keys, numbers, counts = [], [], [], [], []
            ids, text_keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, key, text in zip(ids, text_keys, raw(batch.column(2))):
                lines = (text or b"").split(b"\n")
                for number, line in enumerate(lines):
                    line = line.strip(STRIP)
                    if len(line) >= min_points and (line.isascii() or len(line.decode()) >= min_points):
                        digests.append(xxhash.xxh3_128_digest(line.lower()))
                        docs.append(doc)
                        keys.append(key)
                        numbers.append(number)
                        counts.append(len(lines))
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs, pa.int64()), pa.array(keys, pa.int64()),
                                   pa.array(numbers, pa.int32()), pa.array(counts, pa.int32())],
                                  names=["h1", "h2", "doc_id", "text_key", "line", "n_lines"])
    return run


def _stream(min_docs: int):
    """Runs of equal hashes in one sorted range.

    A run inside the range is decided at once and gives its lines outside the first
    document.  The first and last run may go on in a neighbouring range: they give all
    their lines, each with the run's number of documents in this range and its first
    document, to be added up later.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        first = True

        def decide(table: pa.Table, at_start: bool, at_end: bool) -> Iterator[pa.RecordBatch]:
            h1, h2 = table["h1"].to_numpy(), table["h2"].to_numpy()
            doc = table["doc_id"].fill_null(_LOWEST).to_numpy()
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            sizes = np.diff(np.r_[starts, len(h1)])
            new_doc = np.r_[True, doc[1:] != doc[:-1]]
            new_doc[starts] = True
            docs = np.repeat(np.add.reduceat(new_doc.astype(np.int32), starts), sizes)
            keeper = np.repeat(doc[starts], sizes)
            open_ = np.zeros(len(starts), dtype=bool)
            open_[0] |= at_start
            open_[-1] |= at_end
            open_ = np.repeat(open_, sizes)
            out = open_ | ((docs >= min_docs) & (doc != keeper))
            if out.any():
                chosen = table.filter(pa.array(out))
                chosen = chosen.append_column("docs", pa.array(np.where(open_, docs, -1)[out].astype(np.int32)))
                chosen = chosen.append_column("keeper", pa.array(keeper[out]))
                yield from chosen.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = len(a)
            differs = np.flatnonzero((a != a[-1]) | (b != b[-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if waiting and (cut or waiting[-1]["h1"][0].as_py() != a[0] or waiting[-1]["h2"][0].as_py() != b[0]):
                waiting.append(pa.Table.from_batches([batch.slice(0, cut)]))
                yield from decide(pa.concat_tables(waiting), first, False)
                first, waiting = False, []
            elif cut:
                yield from decide(pa.Table.from_batches([batch.slice(0, cut)]), first, False)
                first = False
            waiting.append(pa.Table.from_batches([batch.slice(cut)]))
        if waiting:
            yield from decide(pa.concat_tables(waiting), first, True)
    return run


@F.pandas_udf(T.BinaryType())
def _bitmap(numbers: pd.Series, n_lines: pd.Series) -> pd.Series:
    """Compressed bitmap of the lines that stay, one bit a line."""
    def one(dropped, n):
        keep = np.ones(n, dtype=np.uint8)
        keep[np.asarray(dropped, dtype=np.int64)] = 0
        return zlib.compress(np.packbits(keep).tobytes())
    return pd.Series([one(d, int(n)) for d, n in zip(numbers, n_lines)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text_key, n_lines, n_dropped, keep`` of every document that loses lines.

    A line's key is the line without blanks at its ends, A-Z lower-cased.  A key of at
    least ``min_points`` code points in at least ``min_docs`` documents stays only in
    the largest ``doc_id`` that holds it, with all its lines there.  Hashes have 128
    bits.  A frequent line spreads over many ranges, as ranges are cut by hash and
    document; what crosses a cut is added up from one row per range.

    Null ids count as one document, smaller than all others; null text is one empty
    line; repeated rows are the same document.
    """
    texts = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    lines = saved(texts.mapInArrow(_hashed_lines(min_points), LINES))
    ordered = (lines.repartitionByRange(F.col("h1"), F.col("h2"), F.desc_nulls_last("doc_id"))
               .sortWithinPartitions("h1", "h2", F.desc_nulls_last("doc_id"), "line"))
    found = saved(ordered.mapInArrow(_stream(min_docs), FOUND).withColumn("part", F.spark_partition_id()))
    open_ = found.where("docs >= 0")
    runs = (open_.groupBy("h1", "h2", "part").agg(F.max("docs").alias("docs"), F.max("keeper").alias("keeper"))
            .groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("keeper").alias("last"))
            .where(F.col("all_docs") >= min_docs))
    # at most two runs a range: as many rows as ranges, whatever the lines
    crossing = open_.join(F.broadcast(runs), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")) & ~(F.col("doc_id").isNull() & (F.col("last") == _LOWEST)))
    columns = ["doc_id", "text_key", "line", "n_lines"]
    dropped = found.where("docs < 0").select(*columns).unionByName(crossing.select(*columns))
    return (dropped.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("numbers"), F.max("n_lines").alias("n_lines"))
            .select("doc_id", "text_key", "n_lines", F.size("numbers").cast("long").alias("n_dropped"),
                    _bitmap("numbers", "n_lines").alias("keep")))


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines whose bit is set, joined by line feeds; the whole text where there is no bitmap."""
    def one(t, k):
        lines = (t or "").split("\n")
        if k is not None:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(k), dtype=np.uint8), count=len(lines))
            lines = [line for line, bit in zip(lines, bits) if bit]
        return "\n".join(lines)
    return pd.Series([one(t, k) for t, k in zip(text, keep)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept_digest(text: pd.Series, keep: pd.Series) -> pd.Series:
    return kept_text.func(text, keep).map(lambda t: hashlib.sha256(t.encode()).hexdigest())


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_dropped`` and ``keep`` (null where nothing is dropped)."""
    side = bitmaps.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), "n_dropped", "keep")
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("whole"))
    on = F.col("whole.doc_id").eqNullSafe(F.col("of_doc")) & (text_key(F.col("whole.text")) == F.col("of_text"))
    return whole.join(side, on, "left").select("whole", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: ``n_lines`` before dropping, ``n_dropped`` and SHA-256 of the lines that stay."""
    narrow = docs.select("doc_id", "text")
    judged = with_bitmaps(narrow, keep_bitmaps(narrow))
    text = F.coalesce("whole.text", F.lit(""))
    return judged.select(
        F.col("whole.doc_id").alias("doc_id"), (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"), "n_dropped",
        F.when(F.col("keep").isNull(), F.sha2(text, 256)).otherwise(_kept_digest(F.when(F.col("keep").isNotNull(), text), "keep")).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines; ``n_chars`` follows the text, other columns stay.

    Null texts stay null; null ids count as one document, and of equal ids all rows keep
    their lines; an empty table gives no rows; columns may have any names.
    """
    judged = with_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text")))
    cut = F.col("keep").isNotNull()
    text = F.when(cut, kept_text(F.when(cut, F.col("whole.text")), "keep")).otherwise(F.col("whole.text"))
    rows = judged.select("whole", text.alias("cut"))     # two columns of our own, whatever the table's are called
    columns = []
    for name in docs.columns:
        kept = F.col(f"whole.`{name}`")
        if name == "text":
            kept = F.col("cut")
        elif name == "n_chars":
            kept = (F.when(F.col("cut").eqNullSafe(F.col("whole.text")), kept)
                    .otherwise(F.length("cut").cast(docs.schema["n_chars"].dataType)))
        columns.append(kept.alias(name))
    return rows.select(*columns)
