"""SimHash near-duplicates: bit planes compared many at a time with carry-save counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.components import components
from segue.llm.store import raw, saved, text_key

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints side by side in a block; rows of a text hashed at a time.
LANES, CHUNK = 1024, 4096
#: One band more than the radius: fingerprints within the radius agree in at least one band.
BANDS = ((0, 22), (22, 21), (43, 21))
#: Planes between two looks whether a row of comparisons can be abandoned.
LOOK = 8


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64 majority bits over the hashes of all word shingles; 0 without words."""
    words = (text or b"").lower().split()          # bytes: A-Z only, and exactly the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > size:
        starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(majority.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint(t) for t in raw(batch.column(2))], pa.int64())
        yield pa.record_batch([batch.column(0), batch.column(1), prints], names=["doc_id", "text_key", "print"])


def close_pairs(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of fingerprints that differ in at most ``radius`` (0 to 2) bits.

    The block is turned into 64 bit planes, a word holding one bit of 64 fingerprints.
    Every fingerprint is compared with the whole block: plane by plane the differing
    lanes are added to carry-save counters (ones, twos, and lanes that have overflowed
    past the radius).  A row is given up as soon as all its lanes have overflowed.
    """
    n = len(prints)
    width = -(-n // 64) * 64
    bits = np.zeros((64, width), dtype=np.uint8)
    bits[:, :n] = np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    query = (np.uint64(0) - bits[:, :n].astype(np.uint64))                     # all ones where the bit is set
    rows = np.arange(n)
    ones = np.zeros((n, width // 64), dtype=np.uint64)
    twos, over = ones.copy(), ones.copy()
    lane = np.arange(width)
    fresh = np.packbits(lane[None, :] <= rows[:, None], axis=1, bitorder="little").view("<u8")
    over |= fresh                                                              # each pair once
    if width > n:
        over |= np.packbits(lane >= n, bitorder="little").view("<u8")[None, :]
    limit = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(64):
        differs = planes[p][None, :] ^ query[p][rows][:, None]
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if p % LOOK == LOOK - 1 or p == 63:
            past = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones)
            alive = (past != limit).any(axis=1)
            if not alive.all():
                rows, ones, twos, over, past = rows[alive], ones[alive], twos[alive], over[alive], past[alive]
            if not len(rows):
                return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = np.unpackbits((~past).view(np.uint8), axis=1, bitorder="little").astype(bool)
    i, j = np.nonzero(found)
    return rows[i], j


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: as few links as keep everything connected that they connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[y] = x
            kept.append((a, b))
    return kept


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares sorted rows in blocks that never cut a cell, and gives links that span what is close."""
    def links(prints: np.ndarray) -> pa.RecordBatch:
        prints = np.unique(prints)
        chosen = forest(len(prints), *close_pairs(prints))
        return pa.record_batch([pa.array([int(prints[a]) for a, _ in chosen], pa.int64()),
                                pa.array([int(prints[b]) for _, b in chosen], pa.int64())], names=["a", "b"])

    prints, cells = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        cells = np.r_[cells, batch.column(0).to_numpy()]
        prints = np.r_[prints, batch.column(1).to_numpy()]
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        done = 0
        for here, following in zip(starts[1:].tolist(), [*starts[2:].tolist(), None]):
            if here - done >= LANES // 2 or (following is None or following - done > LANES) and here > done:
                yield links(prints[done:here])
                done = here
        prints, cells = prints[done:], cells[done:]
    if len(prints):
        yield links(prints)


def near_links(prints: DataFrame, lanes: int = LANES) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that connect all those within the radius.

    Fingerprints meet in the cells of three bands (22, 21, 21 bits) of which close ones
    share at least one.  A full cell is dealt by hash to parts of about half a block;
    each pair of parts is a cell of its own, so no task holds a whole cell and nothing
    is left out.
    """
    half = lanes // 2
    banded = prints.select("print", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("print", start).bitwiseAND(F.lit((1 << size) - 1)).alias("key"))
        for i, (start, size) in enumerate(BANDS)])).alias("cell")).select("print", "cell.*")
    filled = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / half)
    own = (banded.join(filled, ["band", "key"]).withColumn("parts", parts)
           .withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")))
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    cell = F.xxhash64("band", "key", F.least("part", "other"), F.greatest("part", "other"))
    placed = own.select(cell.alias("cell"), "print")
    return placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_blocks, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, print, root, component_id`` of every document.

    ``component_id`` is the smallest id that can be reached over links of at most two
    differing bits; equal fingerprints are one node.  Null text and text without words
    have fingerprint 0, which links like any other.  Null ids are in groups but never
    name one, unless the group has no other; repeated rows are in the same group; an
    empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    printed = saved(texts.mapInArrow(_fingerprints, "doc_id long, text_key long, print long"))
    nodes = saved(printed.groupBy("print").agg(F.min("doc_id").alias("first_doc")))
    roots = components(near_links(nodes.select("print")))
    rooted = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first_doc", F.coalesce("root", "print").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "root").select("print", "root", "component_id")
    return printed.join(named, "print").select("doc_id", "text_key", "print", "root", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One document of each group, with the columns it came with: the row whose id names the group.

    ``groups`` has ``doc_id, text_key, root, component_id`` of every row; ``grouped`` by
    default.  An id that is repeated with different texts may name several groups and
    stays once in each.  Of repeated rows of a group with that id the one with the smallest
    text hash stays; of groups without any id, one row by text hash.
    """
    groups = grouped(docs.select("doc_id", "text")) if groups is None else groups
    first = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("copies"))
             .groupBy("root").agg(F.min(F.struct("text_key", "copies", "doc_id")).alias("first"))
             .select(F.col("first.doc_id").alias("of_doc"), F.col("first.text_key").alias("of_text"), "first.copies"))
    first = saved(first)
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("whole"))
    on = F.col("whole.doc_id").eqNullSafe(F.col("of_doc")) & (text_key(F.col("whole.text")) == F.col("of_text"))
    single = whole.join(first.where("copies = 1"), on, "left_semi")
    several = (whole.join(first.where("copies > 1"), on).groupBy("of_doc", "of_text").agg(F.first("whole").alias("whole")))
    return single.unionByName(several.select("whole")).select("whole.*")
