"""Language identification by compression with one dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sample: languages (the most frequent), documents of a language, code points taken of each, bytes of a dictionary; level, bytes compressed at a time, narrow margin.
MAX_LANGS, DOCS_PER_LANG, POINTS_PER_DOC, DICTIONARY_BYTES = 500, 400, 600, 112_000
LEVEL, PIECE_BYTES, MIN_MARGIN = 3, 4096, 0.01
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_OUT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def letters(text: str) -> bytes:
    """Lower-cased letters with single spaces between words."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def held_out() -> Column:
    """One third of the documents by id, never learned from; false without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary for each of the ``MAX_LANGS`` most frequent languages, from at most ``DOCS_PER_LANG`` documents each.

    The documents with the smallest hashes of their id are taken: a share of each
    language is kept by hash that holds about four times as many, so that ranking them is
    small work for any corpus.  ``POINTS_PER_DOC``
    code points of each from a digest-chosen place.  Rows without text, language or id
    are not learned from.  What reaches the driver is at most ``DOCS_PER_LANG *
    POINTS_PER_DOC`` code points a language.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 53))
    learnable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    shares = (learnable.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(MAX_LANGS)
              .select("lang", (F.lit(4.0 * DOCS_PER_LANG) * (1 << 53) / F.col("docs")).alias("below")))
    first = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    start = F.pmod(F.col("place"), F.greatest(F.length("text") - POINTS_PER_DOC, F.lit(1))) + 1
    sample = (learnable.withColumn("place", place).join(F.broadcast(shares), "lang").where("place < below")
              .select("doc_id", "lang", "place", F.substring("text", start.cast("int"), F.lit(POINTS_PER_DOC)).alias("text"))
              .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= DOCS_PER_LANG))
    parts: dict[str, list[bytes]] = {}
    for row in sample.orderBy("lang", "rank").toLocalIterator():
        parts.setdefault(row["lang"], []).append(letters(row["text"]))
    return {lang: b" ".join(texts)[:DICTIONARY_BYTES] for lang, texts in sorted(parts.items()) if any(texts)}


class Classifier:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, known: dict[str, bytes], level: int = LEVEL) -> None:
        self.langs, self.coders = list(known), []
        for content in known.values():
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parameters = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), source_size=PIECE_BYTES,
                                                                        write_content_size=0, write_checksum=0, write_dict_id=0)
            self.coders.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))

    def sizes(self, body: bytes) -> list[int]:
        """The whole text in pieces, so that the dictionary counts in every part of a long one."""
        view = memoryview(body)
        pieces = [view[i:i + PIECE_BYTES] for i in range(0, len(body), PIECE_BYTES)]
        return [sum(len(coder.compress(piece)) for piece in pieces) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin to the next best (0 to 1), whether the margin is too narrow."""
        body = letters(text) if text else b""
        if not body or not self.langs:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(body)
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        ranked = sorted(zip(sizes, self.langs))
        score = 1 - ranked[0][0] / ranked[1][0]
        return ranked[0][1], score, score < MIN_MARGIN


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document, by its whole text.

    The language whose dictionary compresses the text best; equally good ones go to the
    smaller name.  ``rejected`` marks narrow margins.  ``und`` for null text, text
    without letters, or when nothing could be learned.  Only the text is an input.
    """
    known = dictionaries(docs.select("doc_id", "lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(known)
        for batch in batches:
            found = [classifier.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                                   pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                                  names=["doc_id", "held_out", "lang_pred", "score", "rejected"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, _OUT)
