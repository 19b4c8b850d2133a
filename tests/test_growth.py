"""Work that must not grow faster than the input: plans and results on rows made here."""

import hashlib
import json
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogue import frames, learning, sets
from segue import lineage
from segue.operators import mining, quality, sequence
from segue.sources import collection, exports


def test_records_are_parsed_once(spark):
    """Every check reads the value parsed once; odd values get the reasons of the contract."""
    good = {"filePath": "a.mp3", "fileName": "a", "duration": 10, "bpm": 1.5, "sections": []}
    texts = [json.dumps(x) for x in (good, good | {"bpm": "fast"}, good | {"sections": None}, good | {"filePath": "", "duration": -1},
                                     good | {"key_confidence": 1.5}, good | {"mix_in_point": 5, "mix_out_point": 20}, {}, [good], 5)] + ["no json", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, data string")
    valid, rejects = quality.validate_tracks(rows)
    assert [r["id"] for r in valid.collect()] == [0] and valid.columns == rows.columns
    none, name = "Track-Record ist kein Dictionary", [f"Pflichtfeld {n} fehlt oder ist ungueltig" for n in ("filePath", "fileName")]
    assert {r["id"]: r["reasons"] for r in rejects.collect()} == {
        1: ["bpm muss numerisch sein"], 2: ["sections muss eine Liste sein"], 3: [name[0], "Dauer oder Mixpoint ist ungueltig negativ"],
        4: ["key_confidence liegt ausserhalb 0..1"], 5: ["Mix-Out liegt hinter dem Trackende"], 6: name, **{i: [none, *name] for i in (7, 8, 9, 10)}}
    for part in (valid, rejects):
        plan = part._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("parsejson(") + plan.count("parse_json(") == 1


def test_holdout_reads_stored_deltas(spark, tmp_path):
    """Scales, value bounds and ranks read one table of deltas instead of the vectors again."""
    rows = [(i, [((i * 7 + j * 3) % 11 - 5) / 5.0 for j in range(64)]) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = learning.holdout(spark, str(tmp_path))
    assert out.inputFiles() and not any("embeddings.parquet" in f for f in out.inputFiles())
    assert out.count() == 1


def test_sections_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    """A task of the section windows holds a bounded number of rows, with the same labels."""
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    rows = [(None if i % 50 == 9 else i // 4, i * 7, i, i % 4, float(i * 13 % 50), float(i), 0.1, 0.02) for i in range(200)]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = sorted(map(repr, frames.labels(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(lineage, "SPREAD_ROWS", 10)
    out = frames.labels(spark, str(tmp_path))
    assert sorted(map(repr, out.collect())) == want and len(want) == 200
    assert out.rdd.getNumPartitions() == 20


def test_a_playlist_is_one_xml_file(spark, tmp_path):
    """The parts of a document come in differently many tasks; a playlist still makes one whole file."""
    tracks = spark.range(4000).select(
        (F.col("id") % 40).alias("playlist_id"), F.col("id").alias("pos"), F.concat(F.lit("C:/m/"), "id", F.lit(".mp3")).alias("file_path"),
        F.repeat(F.lit("t"), 200).alias("title"), F.lit("a").alias("artist"), F.lit("House").alias("genre"), F.lit("House").alias("detected_genre"),
        F.lit(120.0).alias("bpm"), F.lit("A").alias("key_note"), F.lit("Minor").alias("key_mode"), F.lit(300.0).alias("duration"),
        F.lit(0.5).alias("first_downbeat"), F.lit(1.0).alias("downbeat_confidence"), F.lit(16.0).alias("mix_in_point"), F.lit(200.0).alias("mix_out_point"),
        F.lit(True).alias("outro_covered"), F.array().cast("array<struct<label:string,start_time:double>>").alias("sections"))
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
             "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        exports.write_xml(exports.xml_document(exports.deduplicated(tracks)), str(tmp_path / "xml"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    folders = sorted((tmp_path / "xml").glob("playlist_id=*"))
    assert len(folders) == 40
    for folder in folders:
        (file,) = folder.glob("*.txt")
        assert len(ElementTree.fromstring(file.read_text()).findall("COLLECTION/TRACK")) == 100
    assert collection.tracks(collection.read_entries(spark, str(tmp_path / "xml"))).count() == 4000


def test_playlists_are_ordered_once(spark, sf):
    """Counts and violations of the strategies come from one ordering; a lost track is still a violation."""
    plan = sets.invariants(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1


def test_lost_tracks_are_violations(spark, sf, monkeypatch):
    whole = sets.sequence.sequence
    monkeypatch.setattr(sets.sequence, "sequence", lambda *args: whole(*args).where("NOT (strategy = 'Warm-Up' AND playlist_id = 0 AND pos = 3)"))
    found = {r["strategy"]: r["violations"] for r in sets.invariants(spark, sf).collect()}
    assert found.pop("Warm-Up") == 1 and len(found) == 7 and set(found.values()) == {0}


def test_score_of_one_pair():
    """The score of one pair equals that of a row, also at the ends and for repeated and missing pairs."""
    edges = sequence.Edges(4, np.array([2, 0, 0, 2, 2]), np.array([3, 3, 1, 0, 0]), np.array([5, 7, 9, 4, 6]))
    assert [[edges.score(i, j) for j in range(4)] for i in range(4)] == [edges.of(i, range(4)).tolist() for i in range(4)]
    assert edges.score(0, 3) == 7 and edges.score(3, 3) == 0


def test_resampling_holds_tiles_only(spark, monkeypatch):
    """No row of the concordance or of the draws is as long as the clusters are many; intervals stay the same."""
    rows = [("f", float((m * 7 + k * 5) % 13), (m + k) % 3 > 0, m) for m in range(10) for k in range(6)] + [("g", 1.0, m < 9, m) for m in range(10)]
    scores = spark.createDataFrame(rows, "factor string, value double, positive boolean, mix_id int")
    want = sorted(map(repr, mining.auc_interval(scores, draws=20).collect()))
    monkeypatch.setattr(mining, "TILE", 3)
    monkeypatch.setattr(mining, "DRAW_BLOCK", 7)
    clusters = spark.createDataFrame([(m, m) for m in range(10)], "mix_id int, cluster_idx long")
    assert {len(r["won"]) for r in mining.concordance_tiles(scores, "factor", "mix_id", clusters).collect()} == {3, 1}
    assert max(len(r["clusters"]) for r in mining._draws(clusters.withColumnRenamed("mix_id", "x"), 20, 42).collect()) <= 3
    assert sorted(map(repr, mining.auc_interval(scores, draws=20).collect())) == want


def _drawn_bounds(rows, draws, seed=42):
    """Bounds per factor from every pair of every draw: the definition, on few rows."""
    number = lambda *parts: int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    clusters = sorted({m for *_, m in rows}, key=lambda m: (number(m), m))
    n, out = len(clusters), {}
    place = lambda v: float("nan") if v is None else v  # noqa: E731   a missing value wins and loses nothing
    picks = [[[clusters[number(seed, draw * 2 * n + 2 * k + side) % n] for k in range(n)] for side in (0, 1)] for draw in range(draws)]
    for factor in {f for f, *_ in rows}:
        found = []
        for drawn in picks:
            pos, neg = ([(place(v), drawn[side].count(m)) for f, v, p, m in rows if f == factor and p is (side == 0)] for side in (0, 1))
            total = sum(k for _, k in pos) * sum(k for _, k in neg)
            if total:
                found.append(sum(a * b * ((v > w) + (v == w) / 2) for v, a in pos for w, b in neg) / total)
        out[factor] = tuple(np.percentile(found, [2.5, 97.5])) if found else (0.0, 1.0)
    return out


@pytest.mark.parametrize("held, shard, picks", [(1 << 24, 500_000, 1 << 18), (200, 7, 50)])
def test_intervals_are_rank_sums(spark, monkeypatch, held, shard, picks):
    """No pairs of clusters are formed; every draw counts all its pairs, also with ties, missing values and draws that tasks share."""
    def refused(*args):
        raise AssertionError("pairs of clusters")

    monkeypatch.setattr(mining, "concordance_tiles", refused)
    for name, value in (("HELD", held), ("SHARD_ROWS", shard), ("PICKS", picks)):
        monkeypatch.setattr(mining, name, value, raising=False)
    rng = np.random.default_rng(4)
    rows = [("f", float(rng.integers(-3, 9)), bool(rng.integers(0, 2)), m) for m in range(9) for _ in range(8)]
    rows += [("g", float(rng.normal()), m % 3 > 0, m) for m in range(9) for _ in range(4)] + [("h", 1.0, True, 2)]
    rows += [("f", v, p, m) for v in (None, float("nan"), -0.0, 0.0) for p in (True, False) for m in (1, 5)]
    scores = spark.createDataFrame(rows, "factor string, value double, positive boolean, mix_id long").repartition(3)
    ranged = type(scores).repartitionByRange
    monkeypatch.setattr(type(scores), "repartitionByRange", lambda self, n, *by: ranged(self, n + 2, *by))   # a session may deal to more ranges than asked
    got = {r["factor"]: (r["lower"], r["upper"]) for r in mining.auc_interval(scores, draws=25).collect()}
    want = _drawn_bounds(rows, 25)
    assert set(got) == set(want) and all(np.allclose(got[f], want[f], rtol=0, atol=1e-12) for f in want)


@pytest.mark.parametrize("asked", [lambda rows: mining.mining_report(rows, draws=5), lambda rows: mining.mining_summary(rows, "Techno", 0, draws=5)])
def test_deltas_of_mined_mixes_are_built_once(spark, asked):
    """However many steps read the deltas, each row is built once."""
    built = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    values = [F.sin(F.col("id") * (k + 1)).alias(f) for k, f in enumerate(mining.DIRECTIONS)]
    rows = spark.range(0, 200, 1, 2).select((F.col("id") % 4).alias("mix_id"), F.col("id").alias("i"), F.col("id").alias("j"), *values, (F.col("id") % 3 > 0).alias("positive"))
    assert asked(rows.mapInArrow(count, rows.schema)).count() in (1, 5)
    assert built.value == 200


def test_the_tasks_write_playlist_files(spark, tmp_path):
    """Under a file: address the files equal those of Spark's writer, and no checksum file is written beside each."""
    key = F.element_at(F.array(F.lit("a/b=c%"), F.lit("x y"), F.lit("ü"), F.lit(None), F.lit("7")), (F.col("id") % 5 + 1).cast("int"))
    document = spark.range(5000).select(
        key.alias("playlist_id"), F.lit(1).alias("part"), F.col("id").alias("xml_id"), F.lit(0).alias("seq"),
        F.when(F.col("id") % 50 != 7, F.concat(F.lit("<ü "), "id", F.lit("/>"))).alias("line")).unionByName(
        spark.range(30_000).select(F.lit("long").alias("playlist_id"), F.lit(3).alias("part"), F.col("id").alias("xml_id"), F.lit(0).alias("seq"),
                                   F.col("id").cast("string").alias("line")))

    def files(folder):
        return {f.name: [p.read_bytes() for p in f.glob("part-*.txt")] for f in folder.glob("playlist_id=*")}

    exports.write_xml(document, str(tmp_path / "spark"))
    own = tmp_path / "own folder"
    (own / "playlist_id=old").mkdir(parents=True)
    exports.write_xml(document, f"file:{own}")
    want = files(tmp_path / "spark")
    assert files(own) == want and len(want) == 6 and all(len(x) == 1 for x in want.values())
    assert want["playlist_id=long"][0].split() == [str(i).encode() for i in range(30_000)]
    assert {p.name for p in own.rglob("*") if p.is_file()} == {"_SUCCESS", *(p.name for p in own.glob("*/part-*.txt"))}
    assert spark.read.text(str(own)).groupBy("playlist_id").count().count() == 6

    failing = document.withColumn("line", F.when(F.col("xml_id") == 29_999, F.raise_error(F.lit("no line")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no line"):
        exports.write_xml(failing, f"file://{own}")
    assert files(own) == want and sorted(p.name for p in tmp_path.iterdir()) == ["own folder", "spark"]

    exports.write_xml(document.where("playlist_id is null").unionByName(document.where("playlist_id = '7'").withColumn("playlist_id", F.lit(""))), f"file:{own}")
    assert sorted(files(own)["playlist_id=__HIVE_DEFAULT_PARTITION__"]) == sorted(
        want["playlist_id=__HIVE_DEFAULT_PARTITION__"] + want["playlist_id=7"])
