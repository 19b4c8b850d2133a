"""WARC archives: writing, rewriting whole-file gzip into one member a record, reading by index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.llm.store import saved, shared_dir

MIN_PAYLOAD, ARCHIVE_BYTES, LEVEL, READ_BYTES = 0, 64 << 20, 4, 1 << 20
DATE = "1970-01-01T00:00:00Z"   # pages carry no time of capture
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_OUT = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, target_uri string")
_INDEX = "archive string, offset long, length long, page_id long, record_type string, record_id string"
_CUT = "truncated"   # type of the rest of an archive that ends inside a record
_URI_SAFE = "".join(map(chr, range(0x21, 0x7F)))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address, whichever store the shared folder lies in."""
    return fs.FileSystem.from_uri(path)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, origin_url: str | None = None,
           date: str = DATE) -> bytes:
    """One WARC 1.1 record under an id of its own; a revisit has no block but names digest, length and origin of its payload.

    Page numbers are extension fields (``Page-Id``, ``Refers-To-Page-Id``), so that repeated
    and missing ones still make valid records.
    """
    digest = _sha1(payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
    if page_id is not None:
        head.append(("Page-Id", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=_URI_SAFE)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Payload-Length", str(len(payload)))]
    block = b"" if kind == "revisit" else payload
    if kind == "revisit":
        head += [("WARC-Profile", _REVISIT), ("Refers-To-Page-Id", str(refers_to))]
        if origin_url is not None:
            head.append(("WARC-Refers-To-Target-URI", quote(origin_url, safe=_URI_SAFE)))
    else:
        head += [("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, as any writer may put them: no blank after the colon, folded lines, odd bytes.

    Of a repeated field the first counts; lines without a colon are passed over.
    """
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    found: dict[str, str] = {}
    for name, colon, value in (line.partition(":") for line in lines):
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    return fields, rest[:int(fields["content-length"])]


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """Cuts a stream into records with their fields, holding no more than one record and one chunk.

    Line ends between records are passed over, however many.  If the stream ends inside a
    record, its rest comes last, with None for the fields.
    """
    held, at, fields, need = bytearray(), 0, None, 0
    for chunk in chunks:
        del held[:at]
        at = 0
        held += chunk
        while True:
            if fields is None:
                while at < len(held) and held[at] in b"\r\n":
                    at += 1
                if len(held) - at >= 5 and held[at:at + 5] != b"WARC/":
                    raise ValueError(f"no WARC record starts with {bytes(held[at:at + 40])!r}")
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields = fields_of(bytes(held[at:end]))
                if not fields.get("content-length", "").isdecimal():
                    raise ValueError(f"a record without a length: {bytes(held[at:at + 40])!r}")
                need = end + 4 - at + int(fields["content-length"])
            if len(held) - at < need:
                break
            yield fields, bytes(held[at:at + need]) + b"\r\n\r\n"
            at, fields = at + need, None
    if rest := bytes(held[at:]).strip(b"\r\n"):
        yield None, rest


def _inflated(source) -> Iterator[bytes]:
    """One pass over a gzip stream of one or more members, a chunk at a time."""
    engine = zlib.decompressobj(wbits=31)
    while data := source.read(READ_BYTES):
        while data:
            out = engine.decompress(data, READ_BYTES)
            if out:
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                engine = zlib.decompressobj(wbits=31)
    if tail := engine.flush():
        yield tail


def _number(digits: str | None) -> int | None:
    try:
        return int(digits) if digits else None
    except ValueError:
        return None


def _write(folder: str, archive_bytes: int, level: int, date: str):
    """Archives that are one gzip stream each.  A file's name is new for each attempt; only those of finished tasks are listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        out = engine = name = None
        written = 0

        def close() -> pa.RecordBatch:
            out.write(engine.flush())
            out.close()
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([written], pa.int64())], names=["archive", "bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, written = f"{uuid.uuid4().hex}.warc.gz", 0
                    out, engine = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, wbits=31)
                data = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["record_type"], row["refers_to"],
                              row["origin_url"], date)
                out.write(engine.compress(data))
                written += len(data)
                if written >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()
    return run


def _normalise(folder: str, level: int):
    """Inflates an archive once and writes every record as a member of its own, with a sidecar index beside the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                store, root = _open(folder)
                store.create_dir(root, recursive=True)
                from_store, path = _open(source)
                name, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with from_store.open_input_stream(path, compression=None) as stream, store.open_output_stream(f"{root}/{name}", compression=None) as out, \
                        store.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    for fields, data in records(_inflated(stream)):
                        member = gzip.compress(data, level, mtime=0)
                        out.write(member)
                        known = {"warc-type": _CUT} if fields is None else fields
                        row = {"archive": f"{folder}/{name}", "offset": at, "length": len(member), "page_id": _number(known.get("page-id")),
                               "record_type": known.get("warc-type"), "record_id": known.get("warc-record-id")}
                        index.write((json.dumps(row) + "\n").encode())
                        rows.append(row)
                        at += len(member)
                        if len(rows) == 10_000:
                            yield _index_batch(rows)
                            rows = []
                yield _index_batch(rows)
    return run


def _index_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                                                              ("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string())]))


def _checked(fields: dict[str, str], block: bytes, path: str) -> tuple[int, str]:
    """Length and bare SHA-1 of a record's payload; a block that does not fit its own digest is an error.

    An HTTP response's payload follows its own header.  A payload digest in another form
    (hexadecimal, other function) is worked out anew.
    """
    algorithm, _, stated = fields.get("warc-block-digest", "").partition(":")
    own = None
    if algorithm.lower() == "sha1":
        own = _sha1(block)
        if stated.strip().upper() not in (own, hashlib.sha1(block).hexdigest().upper()):
            raise ValueError(f"digest of {fields.get('warc-record-id')} in {path} does not fit its block")
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    algorithm, _, stated = fields.get("warc-payload-digest", "").partition(":")
    if algorithm.lower() == "sha1" and len(stated.strip()) == 32:
        digest = stated.strip().upper()
    else:
        digest = own if own and payload is block else _sha1(payload)
    length = _number(fields.get("payload-length"))
    return (len(payload) if length is None else length), digest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads single records at their offsets."""
    source = archive = None
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string())])
    for batch in batches:
        rows = []
        for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if path != archive:
                if source:
                    source.close()
                store, inside = _open(path)
                source, archive = store.open_input_file(inside), path
            fields, block = parse(gzip.decompress(source.read_at(length, offset)))
            size, digest = _checked(fields, block, path)
            rows.append({"page_id": _number(fields.get("page-id")), "payload_bytes": size, "payload_digest": digest,
                         "record_type": fields.get("warc-type"), "refers_to": _number(fields.get("refers-to-page-id")),
                         "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri")})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if source:
        source.close()


def with_origin(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``page_id, url, html, record_type, refers_to, origin_url``: equal payloads of at least ``min_payload`` bytes refer to the smallest id.

    Only digests that occur more than once are joined, each as one row.
    """
    html = F.coalesce("html", F.lit(""))
    digest = F.when(F.octet_length(html) >= min_payload, F.sha1(html.cast("binary")))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("digest"))
    shared = (known.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
              .where("n > 1 AND first IS NOT NULL").select("digest", F.col("first.page_id").alias("origin"), F.col("first.url").alias("origin_url")))
    joined = known.join(shared, "digest", "left")
    revisit = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("origin")).alias("refers_to"), F.when(revisit, F.col("origin_url")).alias("origin_url"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Writes whole-stream archives below ``folder``; a stored list of ``archive, bytes``.  All records carry ``date``."""
    return saved(with_origin(pages).mapInArrow(_write(folder, archive_bytes, level, date), "archive string, bytes long"))


def normalise(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites gzip archives of any writer with one member a record; a stored index of all records.

    ``archives``: addresses in a column ``archive``.  Records of every type are kept.  The rest
    of an archive that ends inside a record becomes a member of the type ``truncated``; a
    stream that holds something else than records is an error.
    """
    tasks = max(1, archives.count())
    dealt = archives.select("archive").repartition(min(tasks, 100_000))
    return saved(dealt.mapInArrow(_normalise(folder, level), _INDEX))


def sidecar_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all records below a folder, from the sidecar files beside its archives."""
    return spark.read.schema(_INDEX).json(f"{folder}/*.idx")


def read_records(index: DataFrame) -> DataFrame:
    """Whole records of an index, each read on its own; fields that a record lacks are NULL, its digest is worked out."""
    whole = index.where(F.coalesce(F.col("record_type"), F.lit("")) != _CUT)
    return whole.select("archive", "offset", "length").mapInArrow(_read, _OUT)


def archived(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back one record per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null html is an empty payload, equal to other empty ones; a null id is never named
    by others and is a response only if no row with an id has its payload; rows that
    repeat the smallest id are responses too.  An empty table writes no archive.  Very long
    payloads are held one at a time; other columns, whatever their names, are not read.
    """
    folder = shared_dir(pages.sparkSession)
    records = read_records(normalise(write_archives(pages, f"{folder}/whole"), f"{folder}/members"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
