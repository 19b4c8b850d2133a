"""Substring deduplication: a De Bruijn graph of word windows, compacted to repeated paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.store import raw, saved, text_key
from segue.llm.windows import by_bucket, grams, lists_by, smallest, to_buckets, winnow, word_hashes

#: Words of a window (an edge between its first and last twelve words); words of an anchor; text bytes for each bucket of hashes.
WINDOW, ANCHOR, BUCKET_BYTES = 13, 7, 24 << 20
#: Null ids come after all others.
LAST_ID = (1 << 63) - 1
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _joined(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = [(t or b"").split() for t in raw(batch.column(3))]
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array([len(w) for w in split], pa.int64()),
                               pa.array([sum(map(len, w)) for w in split], pa.int64()), pa.array([_joined(w) for w in split], pa.binary())],
                              names=["id", "text_key", "second_key", "n_words", "bytes", "digest"])


def _anchors(buckets: int):
    """The smallest k-gram of every window, each once a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, docs, texts = [], [], []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2))):
                hashes = word_hashes((text or b"").split())
                if len(hashes) >= WINDOW:
                    own = np.unique(winnow(hashes, WINDOW, ANCHOR)[1])
                    marks.append(own)
                    docs.append(np.full(len(own), doc, dtype=np.int64))
                    texts.append(np.full(len(own), key, dtype=np.int64))
            if marks:
                all_marks = np.concatenate(marks)
                yield to_buckets(all_marks, [all_marks, np.concatenate(docs), np.concatenate(texts)], buckets)
    return run


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each text that stand in a text of another id too, a row each."""
    for marks, docs, texts in by_bucket(batches, ["<u8", "<i8", "<i8"]):
        order = np.lexsort((docs, marks))
        marks, docs, texts = marks[order], docs[order], texts[order]
        starts = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
        sizes = np.diff(np.r_[starts, len(marks)])
        shared = np.repeat(docs[starts] != docs[starts + sizes - 1], sizes)
        yield pa.record_batch([pa.array(docs[shared]), pa.array(texts[shared]), pa.array(marks[shared].view(np.int64))], names=["id", "text_key", "anchor"])


def _edges(buckets: int):
    """Windows whose anchor is shared: 128-bit hash, document, position and text of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            anchors = batch.column(3)
            for row, (doc, key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)))):
                hashes = word_hashes((text or b"").split())
                if len(hashes) < WINDOW:
                    continue
                marks = grams(hashes, ANCHOR)
                known = np.asarray(anchors[row].values).view(np.uint64)
                at = np.flatnonzero(np.isin(marks[smallest(marks, WINDOW - ANCHOR + 1)], known))
                if len(at):
                    columns[0].append(grams(hashes, WINDOW)[at])
                    columns[1].append(grams(hashes ^ _SECOND, WINDOW)[at])
                    columns[2].append(np.full(len(at), doc, dtype=np.int64))
                    columns[3].append(at.astype(np.int32))
                    columns[4].append(np.full(len(at), key, dtype=np.int64))
            if columns[0]:
                flat = [np.concatenate(c) for c in columns]
                yield to_buckets(flat[0], flat, buckets)
    return run


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in several documents: each occurrence with the edge's source, its first place in one text of the smallest id."""
    for h1, h2, docs, at, texts in by_bucket(batches, ["<u8", "<u8", "<i8", "<i4", "<i8"]):
        order = np.lexsort((at, texts, docs, h2, h1))
        h1, h2, docs, at, texts = h1[order], h2[order], docs[order], at[order], texts[order]
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        sizes = np.diff(np.r_[starts, len(h1)])
        shared = np.repeat(docs[starts] != docs[starts + sizes - 1], sizes)
        owner, owner_text, owner_at = (np.repeat(c[starts], sizes)[shared] for c in (docs, texts, at))
        keys, lists = lists_by(texts[shared], [at[shared], owner, owner_text, owner_at])       # a text has one id: its copies are out
        ids = docs[shared][np.unique(texts[shared], return_index=True)[1]]
        yield pa.record_batch([pa.array(ids), pa.array(keys), *lists], names=["id", "text_key", "at", "owner", "owner_text", "owner_at"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins edges that follow each other both here and in their source; positions belong to one text."""
    names = ["id", "text_key", "first", "edges", "owner", "owner_text", "owner_first"]
    for batch in batches:
        out: list[list[np.ndarray]] = [[] for _ in names]
        flat = [batch.column(i) for i in range(2, 6)]
        for row, (doc, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            at, owner, text, owner_at = (np.concatenate([np.asarray(x.values) for x in c[row]]).astype(np.int64) for c in flat)
            order = np.lexsort((owner_at, text, owner, at))
            at, owner, text, owner_at = at[order], owner[order], text[order], owner_at[order]
            other = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
            new = np.r_[True, (at[1:] != at[:-1]) | other | (owner_at[1:] != owner_at[:-1])]   # repeated rows
            at, owner, text, owner_at = at[new], owner[new], text[new], owner_at[new]
            other = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | other | (owner_at[1:] != owner_at[:-1] + 1)])
            for values, v in zip(out, (np.full(len(starts), doc, dtype=np.int64), np.full(len(starts), key, dtype=np.int64), at[starts],
                                       np.diff(np.r_[starts, len(at)]), owner[starts], text[starts], owner_at[starts])):
                values.append(v)
        yield pa.record_batch([pa.array(np.concatenate(o) if o else np.zeros(0, dtype=np.int64), pa.int64()) for o in out], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, digests = [], []
        for text, spans in zip(raw(batch.column(2)), batch.column(3).to_pylist()):
            words = (text or b"").split()
            keep = np.ones(len(words), dtype=bool)
            for span in spans:
                keep[span["first"]:span["first"] + span["edges"] + WINDOW - 1] = False
            removed.append(int((~keep).sum()))
            digests.append(_joined([w for w, k in zip(words, keep.tolist()) if k]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.binary())],
                              names=["id", "text_key", "n_removed", "cut_digest"])


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_key(F.col("text")).alias("text_key"),
                       F.xxhash64(F.lit(WINDOW), text).alias("second_key"), text.alias("text"))


class Repeats:
    """The stored tables of one run over ``docs``.

    ``rows``: ids, number of words, digest of all words.  ``copies``: the smallest id of
    each text that several rows have; the other rows lose every window, so only the
    first goes on.  ``candidates``: texts with an anchor that stands elsewhere too;
    windows that two documents share have the same anchor, so no other text can lose
    words.  ``paths``: runs of repeated windows per text with their source; positions belong to one text,
    ids only say which text is first.
    ``spans``: the paths outside their source, each joined to the source's own path.
    """

    def __init__(self, docs: DataFrame) -> None:
        known = _identified(docs)
        self.rows = saved(known.select("id", "text_key", "second_key", "text")
                          .mapInArrow(_stats, "id long, text_key long, second_key long, n_words long, bytes long, digest binary"))
        self.copies = saved(self.rows.groupBy("text_key", "second_key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
                            .where("n > 1").drop("n"))
        size = self.rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        buckets = max(16, -(-size // BUCKET_BYTES))
        texts = (known.join(self.copies, ["text_key", "second_key"], "left")
                 .where(F.col("first_id").isNull() | (F.col("id") == F.col("first_id"))).select("id", "text_key", "text"))
        packed = "bucket long, c0 binary, c1 binary"
        anchors = texts.select("id", "text_key", "text").mapInArrow(_anchors(buckets), packed + ", c2 binary")
        shared = (anchors.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_anchors, "id long, text_key long, anchor long")
                  .groupBy("id", "text_key").agg(F.collect_list("anchor").alias("anchors")))
        self.candidates = saved(texts.join(shared, ["id", "text_key"]).select("id", "text_key", "text", "anchors"))
        edges = self.candidates.mapInArrow(_edges(buckets), packed + ", c2 binary, c3 binary, c4 binary")
        occurrences = edges.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
            _owned, "id long, text_key long, at array<int>, owner array<long>, owner_text array<long>, owner_at array<int>")
        self.paths = saved(occurrences.groupBy("id", "text_key").agg(*[F.collect_list(c).alias(c) for c in ("at", "owner", "owner_text", "owner_at")])
                           .mapInArrow(_paths, "id long, text_key long, first long, edges long, owner long, owner_text long, owner_first long"))
        sources = (self.paths.where("id = owner AND text_key = owner_text AND first = owner_first")
                   .select("owner", "owner_text", F.col("first").alias("path_first"), F.col("edges").alias("path_edges")).distinct())
        inside = ((F.col("owner_first") >= F.col("path_first"))
                  & (F.col("owner_first") + F.col("edges") <= F.col("path_first") + F.col("path_edges")))
        self.spans = saved(self.paths.where("id <> owner").join(sources, ["owner", "owner_text"]).where(inside).drop("path_edges"))

    def cut(self) -> DataFrame:
        """``id, text_key, n_removed, cut_digest`` of the candidates that lose words."""
        lost = self.spans.groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "edges")).alias("spans"))
        return self.candidates.select("id", "text_key", "text").join(lost, ["id", "text_key"]).select("id", "text_key", "text", "spans").mapInArrow(
            _cut, "id long, text_key long, n_removed long, cut_digest binary").groupBy("id", "text_key").agg(
            F.first("n_removed").alias("n_removed"), F.first("cut_digest").alias("cut_digest"))   # repeated rows are cut alike


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, first_word, n_words, source_doc, source_word, path_word`` of every repeated span outside its source."""
    return Repeats(docs).spans.select(
        F.col("id").alias("doc_id"), F.col("first").alias("first_word"), (F.col("edges") + WINDOW - 1).alias("n_words"),
        F.col("owner").alias("source_doc"), F.col("owner_first").alias("source_word"), F.col("path_first").alias("path_word"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed`` and SHA-256 of the words that stay.

    A window goes if its words also stand in a document with a smaller id; null ids are
    larger than all others and repeated ids are one document.  Null text has no words;
    texts shorter than a window lose nothing.
    """
    found = Repeats(docs)
    rows = found.rows.join(found.copies, ["text_key", "second_key"], "left").join(found.cut(), ["id", "text_key"], "left")
    whole_copy = (F.col("id") > F.coalesce("first_id", "id")) & (F.col("n_words") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        F.when(F.col("id") < LAST_ID, F.col("id")).alias("doc_id"), "n_words",
        F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole_copy, F.lit(nothing)).otherwise(F.lower(F.hex(F.coalesce("cut_digest", "digest")))).alias("kept_sha256"))
