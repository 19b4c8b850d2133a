"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segue.llm.store import raw, saved, text_key
from segue.llm.windows import winnow, word_hashes

#: Words of a window; words of a fingerprinted k-gram (fewer in shorter items); bits of the filter, whatever the benchmark's size.
WINDOW, GRAM, FILTER_BITS = 10, 5, 1 << 22
_SPACE = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 0x20 for c in range(256))
_FOLD = bytes(_SPACE[c + 32] if "A" <= chr(c) <= "Z" else _SPACE[c] for c in range(256))
_FINAL = np.uint64(0xFF51AFD7ED558CCD)


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


def gram_size(n: int) -> int:
    return min(GRAM, n)


def _slots(hashes: np.ndarray, n: int) -> np.ndarray:
    """Place of a fingerprint in the filter; window lengths have places of their own."""
    return ((hashes ^ np.uint64(n * 0x1000193)) * _FINAL >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


_ITEM = pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("slot", pa.int64()), ("gram", pa.int64()), ("at", pa.int32()),
                   ("words", pa.list_(pa.int64()))])
_ITEM_DDL = "item_id string, n int, slot long, gram long, at int, words array<long>"
_DOC_DDL = "doc_id long, text_key long, n_words long, hits array<struct<n:int,gram:long,at:int,skip:int,words:array<long>>>"


def _context(hashes: np.ndarray, at: np.ndarray, n: int, k: int) -> Iterator[tuple[int, list[int]]]:
    """Per fingerprint: how many words stand before it, and all words that share a window with it."""
    signed = hashes.view(np.int64)
    for p in at.tolist():
        first = max(0, p - (n - k))
        yield p - first, signed[first:p + n].tolist()


def _item_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            hashes = word_hashes(words(text))
            if not len(hashes):
                continue
            n = min(WINDOW, len(hashes))
            k = gram_size(n)
            at, marks = winnow(hashes, n, k)
            for p, gram, slot, (skip, around) in zip(at.tolist(), marks.view(np.int64).tolist(), _slots(marks, n).tolist(), _context(hashes, at, n, k)):
                rows.append({"item_id": item, "n": n, "slot": slot, "gram": gram, "at": skip, "words": around})
        yield pa.RecordBatch.from_pylist(rows, schema=_ITEM)


def _doc_marks(bits: bytes, lengths: list[int]):
    kind = pa.list_(pa.struct([("n", pa.int32()), ("gram", pa.int64()), ("at", pa.int32()), ("skip", pa.int32()), ("words", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").view(bool)
        for batch in batches:
            counts, hits = [], []
            for text in raw(batch.column(2)):
                hashes, own = word_hashes(words(text)), []
                for n in lengths:
                    k = gram_size(n)
                    at, marks = winnow(hashes, n, k)
                    maybe = known[_slots(marks, n)]
                    if maybe.any():
                        at, marks = at[maybe], marks[maybe]
                        own += [{"n": n, "gram": g, "at": p, "skip": skip, "words": around} for p, g, (skip, around)
                                in zip(at.tolist(), marks.view(np.int64).tolist(), _context(hashes, at, n, k))]
                counts.append(len(hashes))
                hits.append(own)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, kind)], names=["doc_id", "text_key", "n_words", "hits"])
    return run


_SPAN_DDL = "row_id long, item_id string, first int, last int"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grows each shared fingerprint to both sides; the words in common are a hit if they fill a window."""
    for batch in batches:
        row = {name: batch.column(name).to_pylist() for name in ("row_id", "item_id", "n", "at", "skip", "words", "item_at", "item_words")}
        out: tuple[list, list, list, list] = ([], [], [], [])
        for r, item, n, p, skip, mine, other_skip, other in zip(*row.values()):
            k = gram_size(n)
            left = 0
            while left < min(skip, other_skip) and mine[skip - left - 1] == other[other_skip - left - 1]:
                left += 1
            right, room = 0, min(len(mine) - skip, len(other) - other_skip)
            while right < room and mine[skip + right] == other[other_skip + right]:
                right += 1
            if right >= k and left + right >= n:
                for values, v in zip(out, (r, item, p - left, p + right)):
                    values.append(v)
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())],
                              names=["row_id", "item_id", "first", "last"])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, n_hit, items``.

    Winnowing keeps the smallest word k-gram of each window of ``WINDOW`` words, so a
    document and an item that share a window share a kept k-gram inside it.  Kept
    k-grams of the documents first pass a bit filter of fixed size made from the
    items' (it only saves shuffling: what it lets through is joined), then are joined
    with the items' k-grams and extended over the neighbouring words.  Words are
    compared by 64-bit hash.  Items of fewer words than a window are windows of
    their own length.

    Null texts have no words; items without words are left out; the windows of items
    without an id count as hits, but such items are not named in ``items``; repeated
    items and rows each count; empty tables give no hits.
    """
    items = saved(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_item_marks, _ITEM_DDL))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())          # at most WINDOW rows
    filled = (items.select(F.expr("slot div 64").alias("at"), F.expr("shiftleft(1L, int(pmod(slot, 64)))").alias("bit"))
              .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect())             # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in filled:
        table[r["at"]] = r["bits"]
    marked = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
                   .mapInArrow(_doc_marks(table.tobytes(), lengths), _DOC_DDL)
                   .withColumn("row_id", F.monotonically_increasing_id()))
    hits = marked.select("row_id", F.explode("hits").alias("hit")).select("row_id", "hit.*")
    pairs = hits.join(items.select("item_id", "n", "gram", F.col("at").alias("item_at"), F.col("words").alias("item_words")), ["n", "gram"])
    spans = saved(pairs.select("row_id", "item_id", "n", "at", "skip", "words", "item_at", "item_words").mapInArrow(_extend, _SPAN_DDL).distinct())
    order = Window.partitionBy("row_id").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    cover = (spans.select("row_id", "first", "last").distinct().withColumn("reached", F.coalesce(F.max("last").over(order), F.lit(0)))
             .groupBy("row_id").agg(F.sum(F.greatest(F.col("last") - F.greatest("first", "reached"), F.lit(0))).cast("long").alias("n_hit")))
    of_items = spans.select("row_id", "item_id").distinct().groupBy("row_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return (marked.select("row_id", "doc_id", "text_key", "n_words").join(cover.join(of_items, "row_id"), "row_id", "left")
            .select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminated(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with the columns they came with.

    Whether a row is clean follows from its id and text, so rows are matched by both.
    """
    hit = (decontaminated(docs.select("doc_id", "text"), benchmark).where("n_hit > 0")
           .select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text")))
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("whole"))
    on = F.col("whole.doc_id").eqNullSafe(F.col("of_doc")) & (text_key(F.col("whole.text")) == F.col("of_text"))
    return whole.join(hit, on, "left_anti").select("whole.*")
