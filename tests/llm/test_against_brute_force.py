"""Every operator on odd rows, against a plain version."""

import brute
import pytest
from pyspark.sql import functions as F

from segue.llm import components, decontaminate, lines, quality, simhash, spans, warc


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_quality_base(make_docs, odd_rows):
    got = rows_of(quality.verdicts(make_docs(odd_rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(brute.quality_base(odd_rows), key=str)


def test_line_dedup(make_docs, odd_rows):
    assert rows_of(lines.digests(make_docs(odd_rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.line_dedup(odd_rows), key=str)


def test_line_runs_that_cross_ranges(spark, make_docs):
    """One line in all documents: its hash fills many ranges, which are added up."""
    rows = [(i, f"{'the same long line for everybody in here ' * 2}\nown {i}") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = rows_of(lines.digests(make_docs(rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == sorted(brute.line_dedup(rows), key=str)


def test_kept_lines(make_docs, odd_rows):
    got = lines.drop_repeated_lines(make_docs(odd_rows))
    assert got.columns == make_docs(odd_rows).columns
    want = {d: s for d, _, _, s in brute.line_dedup([r for r in odd_rows if r[0] is not None])}
    for row in got.where("doc_id BETWEEN 20 AND 30").collect():
        assert brute.sha(row["text"]) == want[row["doc_id"]] and row["n_chars"] == len(row["text"])


def test_simhash(make_docs, odd_rows):
    assert rows_of(simhash.digests(make_docs(odd_rows)), "doc_id", "fingerprint", "component_id") == sorted(brute.near_groups(odd_rows), key=str)


def test_one_document_of_each_group(make_docs, odd_rows):
    got = sorted(((r["doc_id"], r["text"] or "") for r in simhash.one_of_each(make_docs(odd_rows)).collect()), key=str)
    assert got == sorted(((d, t or "") for d, t in brute.survivors(odd_rows, brute.near_roots(odd_rows))), key=str)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
def test_close_pairs(n):
    import numpy as np
    rng = np.random.default_rng(n)
    prints = rng.integers(-2**63, 2**63, n, dtype=np.int64)
    for i in range(0, n - 3, 4):
        prints[i + 1] = prints[i] ^ (1 << int(rng.integers(63)))
        prints[i + 2] = prints[i + 1] ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63)))
    got = set(zip(*(x.tolist() for x in simhash.close_pairs(prints))))
    want = {(i, j) for j in range(n) for i in range(j) if ((int(prints[i]) ^ int(prints[j])) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_full_cells_are_split(spark):
    """Thousands of fingerprints in one cell, compared in parts, give the groups of a direct comparison."""
    import numpy as np
    rng = np.random.default_rng(1)
    prints = np.unique(np.r_[[(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(30, 63, (300, 2))], rng.integers(0, 2**20, 500) << 40]).astype(np.int64)
    table = spark.createDataFrame([(int(p),) for p in prints], "print long")
    links = simhash.near_links(table, lanes=64)
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    parent = {int(p): int(p) for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, p in enumerate(prints.tolist()):
        for q in prints[:i].tolist():
            if (p ^ q).bit_count() <= 2:
                a, b = find(p), find(q)
                parent[max(a, b)] = min(a, b)
    assert {p: root.get(p, p) for p in parent} == {p: find(p) for p in parent}


def test_components_of_a_long_chain(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components.components(edges).collect()} == {0}


def test_substring_dedup(make_docs, odd_rows):
    assert rows_of(spans.digests(make_docs(odd_rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(odd_rows), key=str)


def test_spans_name_equal_words(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (None, 8, 12, 70)]
    text = {d: brute.words(t) for d, t in rows}
    found = spans.repeated_spans(make_docs(rows)).collect()
    assert found
    for s in found:
        here = text[s["doc_id"]][s["first_word"]:s["first_word"] + s["n_words"]]
        assert here == text[s["source_doc"]][s["source_word"]:s["source_word"] + s["n_words"]] and len(here) >= 13


def test_decontamination(spark, make_docs, odd_rows):
    texts = [t for _, t in odd_rows if t and len(t.split()) > 40]
    items = [(1, " ".join(texts[0].split()[5:25]).upper()), (2, "one TWO"), (3, None), (4, "!!!"), (5, " ".join(texts[1].split()[10:20])),
             (5, " ".join(texts[1].split()[10:20])), (None, texts[0]), (11, " ".join(texts[0].split()[5:14]) + " zz"), (12, "word5")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("slot", F.lit(1)).withColumn("n", F.lit(1))
    got = rows_of(decontaminate.digests(make_docs(odd_rows), bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.decontamination(odd_rows, items), key=str)
    assert got == want
    clean = decontaminate.clean_documents(make_docs(odd_rows), bench)
    assert sorted(str(r["doc_id"]) for r in clean.select("doc_id").collect()) == sorted(str(w[0]) for w in want if not w[-1])


def test_warc(spark):
    pages = [(1, "http://a", "x"), (2, None, "x"), (3, "u", None), (4, "v", ""), (5, "http://b\r\nContent-Length: 9", "ä\r\n\r\nWARC/1.1\r\n"),
             (None, "n", "x"), (None, "n", "only"), (7, "w", "y" * 3_000_000), (7, "w", "y" * 3_000_000), (8, "w", "y" * 3_000_000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("archive", F.lit("a"))
    got = rows_of(warc.archived(table), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(brute.warc([(p, h) for p, _, h in pages]), key=str)


def test_whole_stream_archives_are_rewritten(spark, tmp_path):
    """Small archives: many files, each one gzip stream before and one member a record after."""
    import gzip
    import zlib
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, str(tmp_path / "whole"), archive_bytes=2000)
    index = warc.normalise(archives, str(tmp_path / "members"))
    assert archives.count() > 5 and index.count() == 40
    for path in [r["archive"] for r in archives.collect()]:
        engine = zlib.decompressobj(wbits=31)
        engine.decompress(open(path, "rb").read())
        assert engine.eof and not engine.unused_data
    row = index.where("page_id = 17").first()
    data = gzip.decompress(open(row["archive"], "rb").read()[row["offset"]:row["offset"] + row["length"]])
    assert warc.parse(data)[1] == b"page 17 " * 50 and open(row["archive"] + ".idx").read().count("\n") == index.where(F.col("archive") == row["archive"]).count()


def test_items_without_an_id_are_hits(spark, make_docs):
    """Their passages count and make a document go; only their name is missing."""
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:30])), (2, " ".join(w[30:])), (3, "clean text"), (None, " ".join(w[3:20]))]
    items = [(None, " ".join(w[5:17])), (7, " ".join(w[8:19])), (None, " ".join(w[40:52])), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontaminate.digests(make_docs(rows), bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.decontamination(rows, items), key=str)
    assert [r["doc_id"] for r in decontaminate.clean_documents(make_docs(rows), bench).collect()] == [3]


def test_archives_of_other_writers(spark, tmp_path):
    """A crawler's monolith: warcinfo first, folded and blank-free headers, odd bytes, HTTP payloads, a cut end; every record kept."""
    import base64
    import gzip
    import hashlib
    body = b"<html>caf\xc3\xa9</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1 = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()

    def one(head, block):
        return b"WARC/1.0\r\n" + b"\r\n".join([*head, b"Content-Length:%d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"

    info = one([b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:1>", b"WARC-Filename: a.warc.gz"], b"software: crawler\r\n")
    page = one([b"warc-type:response", b"WARC-Record-ID:<urn:uuid:2>", b"WARC-Target-URI: http://a/\r\n  x", b"Content-Type: application/http; msgtype=response",
                b"WARC-Block-Digest: sha1:" + sha1(http).encode(), b"WARC-Concurrent-To: <urn:uuid:8>", b"WARC-Concurrent-To: <urn:uuid:9>"], http)
    odd = one([b"WARC-Type: metadata", b"WARC-Record-ID: <urn:uuid:3>", b"X-Odd: \xff\xfe", b"WARC-Payload-Digest: md5:00"], b"")
    cut = one([b"WARC-Type: resource", b"WARC-Record-ID: <urn:uuid:4>"], b"z" * 500)[:-300]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(b"\r\n" + info + page + b"\r\n" + odd + cut))
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page))   # already one member a record
    (tmp_path / "in" / "c.warc.gz").write_bytes(gzip.compress(page)[:-12])                    # the stream itself is cut
    (tmp_path / "in" / "d.warc.gz").write_bytes(gzip.compress(b""))
    archives = spark.createDataFrame([(str(tmp_path / "in" / f"{x}.warc.gz"),) for x in "abcd"], "archive string")
    index = warc.normalise(archives, str(tmp_path / "out"))
    types = sorted(r["record_type"] for r in index.collect())
    assert types in (["metadata", "response", "response", "response", "truncated", "warcinfo", "warcinfo"],
                     ["metadata", "response", "response", "truncated", "truncated", "warcinfo", "warcinfo"])   # whether c's last bytes came out
    side = warc.sidecar_index(spark, str(tmp_path / "out"))
    assert sorted(map(str, side.collect())) == sorted(map(str, index.collect()))
    got = {r["record_id"]: r for r in warc.read_records(side).collect()}
    assert set(got) == {"<urn:uuid:1>", "<urn:uuid:2>", "<urn:uuid:3>"}
    assert (got["<urn:uuid:2>"]["payload_bytes"], got["<urn:uuid:2>"]["payload_digest"], got["<urn:uuid:2>"]["target_uri"]) == (len(body), sha1(body), "http://a/ x")
    assert got["<urn:uuid:3>"]["payload_digest"] == sha1(b"") and got["<urn:uuid:1>"]["page_id"] is None
    for row in index.collect():
        with open(row["archive"], "rb") as f:
            f.seek(row["offset"])
            assert gzip.decompress(f.read(row["length"])).startswith(b"WARC/1.0\r\n")


def test_written_records_are_valid(spark, tmp_path):
    """Every record has an id of its own, a date and a URI without blanks or line ends, also for repeated and null page ids."""
    pages = [(1, 'http://a/"q" \u00e9', "x"), (1, "http://a", "x"), (None, "n\r\nm", "y"), (2, None, "x")]
    folder = str(tmp_path / "members")
    index = warc.normalise(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "whole")), folder)
    rows = warc.read_records(warc.sidecar_index(spark, folder)).collect()
    assert len({r["record_id"] for r in rows}) == 4 and index.count() == 4
    assert sorted(str(r["target_uri"]) for r in rows) == ["None", 'http://a', 'http://a/"q"%20%C3%A9', "n%0D%0Am"]
    assert [r["refers_to"] for r in rows if r["record_type"] == "revisit"] == [1]
