"""Incremental jobs that keep the track store and the rating table current."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segue.operators import quality, ratings
from segue.sources import library
from segue.sources.store import BucketStore

RECORD_SCHEMA = "key string, version int, ingest_ts timestamp, data string"
RATING_SCHEMA = "pair_id string, rating int, rated_at timestamp"
SHEET_SCHEMA = "pair_id string, rating string"


def _current(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, int]:
    """Newest complete version of a versioned table folder, and its number (-1 if none)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [-1]
    if fs.exists(path):
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("v=") and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
                versions.append(int(name[2:]))
    newest = max(versions)
    if newest < 0:
        return spark.createDataFrame([], schema), newest
    return spark.read.schema(schema).parquet(f"{root}/v={newest}"), newest


def current_table(spark: SparkSession, root: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """The rows of a bucket store or of the newest version of a versioned table."""
    buckets = BucketStore(spark, root, schema)
    return buckets.read() if buckets.exists() else _current(spark, root, schema)[0]


def ingest_tracks(spark: SparkSession, source: str, store: str, rejects: str, checkpoint: str, version: int) -> StreamingQuery:
    """New JSON record files into the bucket store: validate, split, keep the newest per key.

    A batch rewrites the buckets of its keys only.  The newest record per key wins, so a
    batch that is retried after its manifest was written changes nothing.
    """
    stream = spark.readStream.schema(RECORD_SCHEMA).json(source)

    def apply(batch: DataFrame, batch_id: int) -> None:
        valid, bad = quality.validate_tracks(batch)
        bad.drop("reasons").write.mode("overwrite").parquet(f"{rejects}/query={_folder(checkpoint)}/batch={batch_id}")
        BucketStore(batch.sparkSession, store, RECORD_SCHEMA).update(
            valid.select("key", "version", "ingest_ts", "data"), lambda old, new: library.upsert_tracks(old, new, version))

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _folder(checkpoint: str) -> str:
    """Short name of a query, from its checkpoint: batches are numbered anew in each."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def merge_rating_stream(spark: SparkSession, source: str, sheet: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Ratings as they arrive, however late: the last one per pair wins, the higher of two at the same time.

    ``sheet`` is the table of known pairs (pair_id, rating).  The state store keeps the
    winner of every pair by event time, so a batch hands on only the pairs it met.  They
    go into two bucket stores, whose touched buckets alone are written again:
    ``target/ratings`` (the winner of every pair, known or not) and ``target/sheet``.
    Both compare event times once more, so repeats, retried batches and a new checkpoint
    over an old target change nothing.  A start rebuilds the sheet from ``sheet`` and the
    ratings kept, which brings in pairs that have become known since.

    Ratings without a pair are left out; one without a time loses against any other.  The
    state has one row per pair; large sheets should keep it in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    stream = spark.readStream.schema(RATING_SCHEMA).json(source)
    winner = F.max(F.struct("rated_at", "rating")).alias("r")

    def winners(rows: DataFrame) -> DataFrame:
        return rows.groupBy("pair_id").agg(winner).select("pair_id", "r.rating", "r.rated_at")

    def stores(session: SparkSession) -> tuple[BucketStore, BucketStore]:
        return (BucketStore(session, f"{target}/ratings", RATING_SCHEMA, "pair_id"),
                BucketStore(session, f"{target}/sheet", SHEET_SCHEMA, "pair_id"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        kept, shown = stores(batch.sparkSession)
        batch = batch.where("pair_id IS NOT NULL")
        touched = kept.update(batch, lambda old, new: winners(old.unionByName(new)))
        if touched:
            shown.update(kept.read(buckets=touched).join(batch.select("pair_id"), "pair_id", "left_semi"), ratings.merge_ratings)

    kept, shown = stores(spark)
    shown.replace(ratings.merge_ratings(sheet.select("pair_id", "rating"), kept.read()))
    return (winners(stream).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
