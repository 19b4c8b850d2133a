"""Centroids, packing and manifest on odd rows, against plain versions."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segue.llm import centroids, merkle, packing, sql

PATH = public_tokenizers.path(packing.TOKENIZER)


# ------------------------------------------------------------------ centroids
def brute_centroids(rows, count=16, rounds=3):
    whole = [(i, tuple(math.floor(float(x) * 64) for x in v)) for i, v in rows
             if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(float(x) * 64) < 2**27 for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted((r for r in whole if r[0] is not None), key=key)[:count]]
    if not centres:
        return []
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        found = [min((away(v, c), k) for k, c in enumerate(centres)) for _, v in whole]
        if step < rounds:
            for k in range(len(centres)):
                mine = [v for (_, v), (_, j) in zip(whole, found) if j == k]
                if mine:
                    centres[k] = tuple(sum(x) // len(mine) for x in zip(*mine))
    total = sum(d for d, _ in found)
    per = {k: sum(d for d, j in found if j == k) for k in range(len(centres))}
    return [(i, k, d, per[k], total, hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(whole, found)]


def vectors():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(5, 64))
    rows = [(i, [float(x) for x in middle[i % 5] + rng.normal(size=64) * 0.2]) for i in range(120)]
    hot = rows[7][1]
    rows += [(200 + i, hot) for i in range(60)] + [rows[3], rows[3], (3, rows[4][1])]
    rows += [(None, rows[9][1]), (301, None), (302, []), (303, [1.0] * 63), (304, [1.0] * 65), (305, [None] + [1.0] * 63), (306, [float("nan")] * 64),
             (307, [float("inf")] + [0.0] * 63), (308, [3e30] * 64), (309, [2_000_000.0] * 64), (310, [-2_000_000.0] * 64), (311, [0.0] * 64), (312, [-1e-9] * 64)]
    return rows


def clusters_of(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows],
                               "vec_id long, embedding array<double>, cluster int, distance long, v int, to_pivots string")
    return sorted((tuple(r) for r in centroids.digests(df).collect()), key=str)


def test_centroids(spark):
    assert clusters_of(spark, vectors()) == sorted(brute_centroids(vectors()), key=str)


@pytest.mark.parametrize("rows", [[], [(None, [1.0] * 64)], [(1, [1.0] * 64)], [(1, [1.0] * 64), (1, [1.0] * 64), (2, [0.5] * 64)]])
def test_few_vectors(spark, rows):
    assert clusters_of(spark, rows) == sorted(brute_centroids(rows), key=str)


def test_pivots_save_distances(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(16, 64)) * 10
    df = spark.createDataFrame([(i, [float(x) for x in middle[i % 16] + rng.normal(size=64) * 0.1]) for i in range(800)], "vec_id long, embedding array<double>")
    _, centres, formed = centroids.clustered(df)
    assert len(formed) == 3 and all(800 <= n < 800 * len(centres) // 3 for n in formed)


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(11)
    for size in (3, 2**20, 2**26):
        points, centres = rng.integers(-size, size, (300, 64)), rng.integers(-size, size, (16, 64))
        centres[5] = centres[4]     # a tie
        points[:16] = centres
        pivots = points[:7]
        table = np.stack([((points - p) ** 2).sum(axis=1) for p in pivots], axis=1)
        best, distance, _ = centroids.nearest(points, table, centres, pivots)
        every = np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)
        assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


# -------------------------------------------------------------------- packing
def check_packing(pieces, rows, length=2048):
    """Every id in one piece, sequences gapless and short enough; returns sequence lengths."""
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((d is not None, d or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["crc"] and len(p["ids"]) == 4 * p["length"] > 0
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc in {d for d, _ in rows}:
        expected = [ids for known, d, ids in want if (d if known else None) == doc]
        assert sum(p["length"] for p in by_doc[doc]) == sum(map(len, expected))
        if len(expected) == 1:
            parts = sorted(by_doc[doc], key=lambda p: p["start"])
            assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:i]) for i in range(len(parts))]
            assert np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist() == expected[0]
            assert {p["doc_tokens"] for p in parts} == {len(expected[0])}
    sizes = []
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == [sum(q["length"] for q in parts[:i]) for i in range(len(parts))]
        sizes.append(sum(p["length"] for p in parts))
    assert all(n <= length for n in sizes)
    return sizes


def test_packing(make_docs, odd_rows):
    rows = [*odd_rows, (80, "It's  naïvé é\x1c  Ünï ＡＢ 12345 don't<|endoftext|> ΣΑΣ Σ"), (81, "x" * 300)] + [(100 + i, f"kurz {i} " * (i % 97)) for i in range(900)]
    pieces = packing.packed(make_docs(rows).repartition(40), PATH)
    sizes = check_packing(pieces.withColumn("crc", F.crc32("ids")).collect(), rows)
    open_ = [n for n in sizes if n < 2048]
    padded = sum(2048 - n for n in open_ if n & (n - 1))
    assert padded < packing.LEAST_CUT * len(sizes) and sum(n & (n - 1) == 0 for n in open_) <= 11
    row = packing.padding(pieces).first()
    assert (row["sequences"], row["tokens"], row["padded"]) == (len(sizes), sum(sizes), padded)
    made = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    for n, r in ((r["tokens"], r) for r in made.values()):
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 2048) and sum(r["lengths"]) == n


def test_packing_few_windows(make_docs):
    """Two open windows, three partitions merged at a time: several rounds of merging."""
    rng = random.Random(1)
    rows = [(i, "a " * rng.randint(0, 90)) for i in range(400)]
    pieces = packing.packed(make_docs(rows).repartition(20), PATH, length=64, open_windows=2, least_cut=4, fan=3)
    sizes = check_packing(pieces.withColumn("crc", F.crc32("ids")).collect(), rows, 64)
    assert sum(64 - n for n in sizes if n & (n - 1)) < 4 * len(sizes)


def test_packing_of_nothing(make_docs):
    assert packing.packed(make_docs([(1, "a")]).where("doc_id > 1"), PATH).count() == 0
    assert [tuple(r) for r in packing.digests(make_docs([(1, None)]), PATH).collect()] == [(1, 0, 1, zlib.crc32(b"\1\0\0\0"), 1, packing._ROUND, 0)]


def test_best_fit():
    """A piece goes where the least room is left; the fullest window leaves topped up."""
    windows = packing.Windows(0, 0, 100, 2, 16)
    put = lambda doc, n: [r[:3] + (r[5],) for r in windows.add(doc, 0, bytes(4 * n), n)]
    assert put(1, 60) == [] and put(2, 50) == [] and put(3, 40) == [(1, 0, 60, 0), (3, 0, 40, 0)]
    assert put(4, 90) == []
    assert put(5, 60) == [(4, 0, 90, 1)] and windows.gaps == [(40, 3), (50, 1)]
    assert put(6, 70) == [(5, 0, 60, 2), (6, 0, 40, 2)] and windows.gaps == [(20, 1)]


# ------------------------------------------------------------------- manifest
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Root and the siblings of every leaf as (list of (is the leaf's side right, sibling))."""
    paths = [[] for _ in leaves]
    nodes, owners = list(leaves), [[k] for k in range(len(leaves))]
    while len(nodes) > 1:
        new, new_owners = [], []
        for i in range(0, len(nodes), 2):
            for k in owners[i]:
                paths[k].append((False, nodes[i + 1] if i + 1 < len(nodes) else ""))
            if i + 1 < len(nodes):
                for k in owners[i + 1]:
                    paths[k].append((True, nodes[i]))
            new.append(sha(*nodes[i:i + 2]))
            new_owners.append([k for o in owners[i:i + 2] for k in o])
        nodes, owners = new, new_owners
    return nodes[0], paths


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: sha(*map(field, (d, s, lang, n, t)))
    by_lang = {}
    for d, t, lang, s, n in rows:
        wrong = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        by_lang.setdefault((lang is not None, (lang or "").encode()), []).append((d is not None, d or 0, leaf(d, t, lang, s, n), leaf(d, t, lang, s, n + wrong if wrong else n)))
    trees = {k: (sorted(v), *brute_tree([x[2] for x in sorted(v)])) for k, v in sorted(by_lang.items())}
    if not trees:
        return []
    root, tops = brute_tree([t[1] for t in trees.values()])
    out = []
    for (found, subroot, paths), top in zip(trees.values(), tops):
        for (known, d, h, changed), path in zip(found, paths):
            fold = changed
            for right, sibling in path + top:
                fold = sha(sibling, fold) if right else sha(fold, sibling)
            out.append((d if known else None, h, subroot, root, sha(*[x for _, x in path + top]), fold, fold == root))
    return sorted(out, key=str)


def documents(spark, rows):
    full = [(d, t, lang, s, n, -1, "x", "x", "x", -1) for d, t, lang, s, n in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, i long, root string, rest string, block string, label long")


def manifest_rows(odd_rows):
    langs = ["en", "", None, "é", "zz", "a"]
    rows = [(d, t, langs[k % 6] if k % 3 else "en", None if k % 5 == 0 else f"s{k % 2}", None if k % 4 == 0 else len(t or "")) for k, (d, t) in enumerate(odd_rows)]
    return rows + [(d, "same", "en", "hot", 4) for d in range(1000, 1150)] + [(7777, "same", "en", "hot", 4)] * 5 + [(2**63 - 1, "x", "en", "s", 2**63 - 1), (5, "alone", "only", "s", 5)]


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest(spark, odd_rows, monkeypatch, height):
    rows = manifest_rows(odd_rows)
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda docs, tampered: whole(docs, tampered, height))
    got = sorted((tuple(r) for r in merkle.digests(documents(spark, rows)).collect()), key=str)
    assert got == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "", None, "s", None)]])
def test_small_manifests(spark, rows):
    got = sorted((tuple(r) for r in merkle.digests(documents(spark, rows)).collect()), key=str)
    assert got == brute_manifest(rows)


def test_proofs_lead_to_the_root(spark, odd_rows):
    for r in merkle.manifest(documents(spark, manifest_rows(odd_rows)), height=3).collect():
        path = merkle.steps(r["proof"])
        assert r["leaf"] == r["changed"] and merkle.folded(r["leaf"], path) == r["root"] == r["folded_root"]
        assert sha(*[sibling for _, sibling in path]) == r["proof_sha256"]


def test_queue_stays_small():
    sweep, most = merkle.Forward(12), 0
    for i in range(4096):
        for _ in sweep.leaf(i, "x"):
            most = max(most, len(sweep.queue))
    assert most <= 2 * 12


def test_sql_twin_on_odd_rows(spark, odd_rows):
    import pyarrow as pa
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    rows = manifest_rows(odd_rows)
    documents_ = pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), zip(*rows))})  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM documents_")
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    got = con.execute(f"SELECT {columns} FROM ({sql.MANIFEST})").fetchall()
    assert sorted(got, key=str) == brute_manifest(rows)


def test_ids_of_two_generations(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 6)
    ids, whole = packing.Ids(PATH), Tokenizer.from_file(PATH)
    texts = ("a b c d e a b", "b a x y z", "it's a\tb\nc  d\r", "", " ", "İstanbul ist ǅ ﬁn ª e\u0301t\u0301 ok.,! ?? Straße,", "İ", "a, b. c!", "日本 語。 ไทย " + "y" * 99,
             "don't stop'll '' ''s x's", "<|endoftext|> x<|startoftext|>y", "a\u0300b \u0300c \xa0 \x85x \u2003y \x1cz")
    for text in texts * 2:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
        assert len(ids.known) <= 16 and len(ids.older) <= 16 and all(len(c) <= packing.LONGEST_REMEMBERED for c in ids.known)


def test_words_of_letters_go_to_the_model(monkeypatch):
    """New words of Latin letters cost no run of the whole tokenizer; every other chunk still has one, and all ids are its ids."""
    ids = packing.Ids(PATH)
    whole, asked = ids.tokenizer.encode, []
    monkeypatch.setattr(ids, "_encode", lambda text: asked.append(text) or whole(text, add_special_tokens=False).ids)
    plain = ["The", "ÉTÉ.", "straße,%%%", "ª", "aµ!?", "don'", "ÿÞ_", "theatre" * 40, f"x{packing.MARKS}"]
    odd = ["don't", "Kelvin", "été", "ΟΔΟΣ", "İstanbul", "a1", "(the", "the of", "a̸=", "<|endoftext|>", "the<|endoftext|>", "a\x0bb",
           "ﬁn", "the…", "≠", "中文", "×", "a÷", "...", "a\x00"]
    for chunk in plain + odd + ["", *map(chr, range(33, 0x250))]:
        for text in (chunk, f"{chunk} of", f"of{chunk}", f"{chunk}.'S"):
            assert ids.of(text) == packing._packed_ids(whole(text, add_special_tokens=False).ids), text
    assert not set(asked) & {*plain, "of"} and set(odd) <= set(asked)
