"""Packing of token pieces into sequences: bounded-space online best fit, then merged leftovers."""

from __future__ import annotations

import re
import struct
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.store import saved

TOKENIZER, END, LENGTH = "word_bpe_49k.json", 1, 2048
#: Windows that a task keeps open; tokens below which a window is padded rather than topped up; partitions merged at once.
OPEN, LEAST_CUT, FAN = 64, 16, 32
#: Distinct chunks of text whose ids a worker remembers in each of two generations, and the longest chunk remembered.
REMEMBERED, LONGEST_REMEMBERED = 1 << 19, 64
#: Distinct runs of punctuation behind words whose ids a worker remembers.
TAILS = 1 << 12
#: Punctuation, and letters beyond a-z, that normalization leaves alone but for the case; chunks for a trial that hold them all.
MARKS, LATIN = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+")
TRIAL = ["the", "Theon.", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", f"a{MARKS}", "".join(filter(LATIN.fullmatch, map(chr, range(128, 256))))]
ID_BYTES = 4
_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, slot long"
_NAMES = [field.split()[0] for field in _PIECE.split(", ")]
_ROUND, _PART = 1 << 52, 1 << 30


class Memory(dict):
    """Values made when their key is first asked for.

    When as many as may be are remembered, they become the older generation, from which
    those still in use come back.
    """

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Ids:
    """Token ids of texts, four little-endian bytes each, put together from the ids of their chunks between blanks.

    The tokenizer drops white space and none of its rules reaches across it, so a text's
    ids are those of its chunks one after the other; most chunks of a corpus occur
    again and again.  A new chunk of Latin letters, with or without punctuation behind
    it, is one word or two: these go to the tokenizer's model in the form that its
    normalizer and pre-tokenizer give them, if a trial shows that they come out the
    same.  Any other chunk is encoded as a text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {ord(x): byte_level.pre_tokenize_str(x)[0][0] for x in map(chr, range(128, 256)) if LATIN.fullmatch(x)}
        self.tails: dict[str, list[int]] = {}
        self.direct = all(self._words(chunk) == self._encode(chunk) for chunk in TRIAL)
        self.known = Memory(self._new)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _words(self, chunk: str) -> list[int] | None:
        letters = chunk.rstrip(MARKS)
        if letters.isascii():
            if not letters.isalpha():
                return None
            word = letters.lower()
        elif LATIN.fullmatch(letters):
            word = letters.lower().translate(self.signs)
        else:
            return None
        ids = [token.id for token in self.model.tokenize(word)]
        return ids if len(letters) == len(chunk) else ids + self._tail(chunk[len(letters):])

    def _tail(self, marks: str) -> list[int]:
        ids = self.tails.get(marks)
        if ids is None:
            ids = [token.id for token in self.model.tokenize(marks)]
            if len(self.tails) < TAILS:
                self.tails[marks] = ids
        return ids

    def _new(self, chunk: str) -> bytes:
        ids = self._words(chunk) if self.direct else None
        return _packed_ids(self._encode(chunk) if ids is None else ids)

    @property
    def older(self) -> dict[str, bytes]:
        return self.known.older

    def of(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.known.__getitem__, chunks))


def _packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: One memory per worker process and vocabulary: tasks that run there one after the other share it.
_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


class Windows:
    """A fixed number of open windows; rows leave when their window does."""

    def __init__(self, number: int, stage: int, length: int, most: int, least_cut: int):
        self.length, self.most, self.least_cut, self.number = length, most, least_cut, number
        self.next_id = stage * _ROUND + number * _PART
        self.gaps: list[tuple[int, int]] = []          # (free tokens, slot), ascending: the fullest first
        self.held: dict[int, list[tuple]] = {}
        self.slots = 0

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // ID_BYTES
            yield doc, start, n, ids, total, self.next_id, at, None, None
            at += n
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        """Place one piece: whole windows of it leave at once, the rest goes where it fits best."""
        while len(ids) >= self.length * ID_BYTES:
            yield from self._sequence([(doc, start, ids[:self.length * ID_BYTES], total)])
            start, ids = start + self.length, ids[self.length * ID_BYTES:]
        while ids:
            n = len(ids) // ID_BYTES
            at = bisect_left(self.gaps, (n, -1))
            if at < len(self.gaps):
                gap, slot = self.gaps.pop(at)
            elif len(self.gaps) < self.most:
                gap, slot, self.slots = self.length, self.slots, self.slots + 1
                self.held[slot] = []
            else:
                gap, slot = self.gaps.pop(0)
                if gap >= self.least_cut:
                    self.held[slot].append((doc, start, ids[:gap * ID_BYTES], total))
                    start, ids = start + gap, ids[gap * ID_BYTES:]
                yield from self._sequence(self.held.pop(slot))
                continue
            self.held[slot].append((doc, start, ids, total))
            ids = b""
            if gap > n:
                insort(self.gaps, (gap - n, slot))
            else:
                yield from self._sequence(self.held.pop(slot))

    def leftovers(self) -> Iterator[tuple]:
        """The pieces of windows still open, for the next merge."""
        for _, slot in self.gaps:
            for at, (doc, start, ids, total) in enumerate(self.held[slot]):
                yield doc, start, len(ids) // ID_BYTES, ids, total, None, at, self.number, slot

    def last(self) -> Iterator[tuple]:
        """The last open windows: the emptiest fill up the fullest, the one that remains is cut to powers of two."""
        order = [self.held[slot] for _, slot in self.gaps]
        while order:
            head = order.pop(0)
            room = self.length - sum(len(piece[2]) for piece in head) // ID_BYTES
            while room and order:
                doc, start, ids, total = order[-1].pop()
                head.append((doc, start, ids[:room * ID_BYTES], total))
                if len(ids) > room * ID_BYTES:
                    order[-1].append((doc, start + room, ids[room * ID_BYTES:], total))
                if not order[-1]:
                    order.pop()
                room -= len(head[-1][2]) // ID_BYTES
            sizes = [self.length] if not room else [1 << b for b in reversed(range(self.length.bit_length())) if (self.length - room) >> b & 1]
            for size in sizes:
                taken = []
                while size:
                    doc, start, ids, total = head.pop(0)
                    taken.append((doc, start, ids[:size * ID_BYTES], total))
                    if len(ids) > size * ID_BYTES:
                        head.insert(0, (doc, start + size, ids[size * ID_BYTES:], total))
                    size -= len(taken[-1][2]) // ID_BYTES
                yield from self._sequence(taken)


def _batches(rows: Iterator[tuple], size: int = 1024) -> Iterator[pa.RecordBatch]:
    types = [pa.int64() if name != "ids" else pa.binary() for name in _NAMES]
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=_NAMES)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=_NAMES)


def packed(docs: DataFrame, tokenizer: str, end: int = END, length: int = LENGTH, open_windows: int = OPEN, least_cut: int = LEAST_CUT,
           fan: int = FAN) -> DataFrame:
    """Pieces of documents with their place in sequences of at most ``length`` tokens.

    ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ``ids`` holds four
    little-endian bytes per token, ``tokenizer`` is the path of a vocabulary file that every
    executor has.  A document is its text's ids and then ``end``.  Every partition of the
    scan packs what it reads, without a shuffle: a piece goes to the open window that it
    fills best; when it fits none and ``open_windows`` are open, the fullest leaves, topped
    up with the piece's head where at least ``least_cut`` tokens are free.  The windows
    still open at the end are merged the same way, ``fan`` partitions at a time, until one
    partition is left, whose rest is cut to powers of two.  So padding is below
    ``least_cut`` tokens a sequence; a task holds at most ``open_windows`` windows and one
    document.

    Null and empty texts are documents of the one token ``end``; null ids and repeated
    rows are documents like any other; very long texts fill whole windows; an empty table
    gives no rows.  Only ``doc_id`` and ``text`` are read, so further columns cannot clash.
    Sequence ids are unique, not gapless; they follow the partitions of the scan.
    """
    closing = end.to_bytes(ID_BYTES, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            windows = Windows(TaskContext.get().partitionId(), 0, length, open_windows, least_cut)
            ids = ids_of(tokenizer)
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = ids.of(text or "") + closing
                    yield from windows.add(doc, 0, found, len(found) // ID_BYTES)
            yield from windows.leftovers()
        return _batches(rows())

    result = saved(docs.select("doc_id", "text").mapInArrow(first, _PIECE))
    done, stage = [result.where("sequence_id IS NOT NULL")], 0
    while True:
        open_ = result.where("sequence_id IS NULL")
        parts = open_.agg(F.max("part")).first()[0]
        if parts is None:
            break
        stage += 1
        result = saved(_merge(open_, stage, parts < fan, parts // fan + 1, length, open_windows, least_cut, fan))
        done.append(result.where("sequence_id IS NOT NULL"))
    pieces = done[0]
    for more in done[1:]:
        pieces = pieces.unionByName(more)
    return pieces.drop("part", "slot")


def _merge(open_: DataFrame, stage: int, is_last: bool, groups: int, length: int, open_windows: int, least_cut: int, fan: int) -> DataFrame:
    """Leftovers of ``fan`` partitions at a time packed again, longest pieces first."""
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            windows = None
            for batch in batches:
                for group, doc, start, ids, total in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    if windows is None or windows.number != group:
                        if windows is not None:
                            yield from windows.last() if is_last else windows.leftovers()
                        windows = Windows(group, stage, length, open_windows, least_cut)
                    yield from windows.add(doc, start, ids, total)
            if windows is not None:
                yield from windows.last() if is_last else windows.leftovers()
        return _batches(rows())

    grouped = open_.withColumn("group", F.expr(f"part div {fan}"))
    return (grouped.repartition(groups, "group").sortWithinPartitions("group", F.desc("length"), "part", "slot", "offset")
            .select("group", "doc_id", "start", "ids", "doc_tokens").mapInArrow(again, _PIECE))


def sequences(pieces: DataFrame, pad: int = 0, length: int = LENGTH) -> DataFrame:
    """``sequence_id, tokens, ids, doc_ids, starts, lengths``: a row per sequence, ids padded to ``length`` except at a power of two."""
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.sum("length").alias("tokens"))   # at most one piece a token
    missing = F.when(F.bit_count("tokens") == 1, 0).otherwise(length - F.col("tokens")).cast("int")
    padding = F.unhex(F.repeat(F.lit(pad.to_bytes(ID_BYTES, "little").hex()), missing))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", "tokens", F.concat(joined, padding).alias("ids"), F.col("p.doc_id").alias("doc_ids"),
                       F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"))


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: ``sequences, tokens, padded, cuts`` of a packing."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_if(F.col("start") > 0).alias("cuts"))
    missing = F.when(F.bit_count("n") == 1, 0).otherwise(length - F.col("n"))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(missing).alias("padded"), F.sum("cuts").alias("cuts"))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
