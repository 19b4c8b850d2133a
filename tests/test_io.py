"""Readers, writers and streams on temporary folders."""

import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from catalogue import library as lib_queries
from segue.sources import collection, exports, library
from segue.sources.store import BucketStore
from segue.streaming import ingest


def test_scan_library(spark, tmp_path):
    for name in ("a.mp3", "sub/b.WAV", "sub/c.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * 5)
    got = library.scan_library(spark, str(tmp_path)).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == ["a.mp3", "b.WAV"] and {r["length"] for r in got} == {5}


def test_m3u8_and_xml_round_trip(spark, sf, tmp_path):
    rows = lib_queries._exported(spark, sf).where("playlist_id < 2").cache()
    lines = exports.m3u8_lines(rows, "Set")
    exports.write_m3u8(lines, str(tmp_path / "m3u8"))
    parts = [p for p in (tmp_path / "m3u8" / "playlist_id=0").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 1
    want = [r["line"] for r in lines.where("playlist_id = 0").orderBy("line_no").collect()]
    assert parts[0].read_text().splitlines() == want and want[0] == "#EXTM3U"
    document = exports.xml_document(exports.deduplicated(rows), "My <Set>", "Folder")
    exports.write_xml(document, str(tmp_path / "xml"))
    for part in (tmp_path / "xml").glob("playlist_id=*"):
        (file,) = part.glob("*.txt")
        root = ElementTree.fromstring(file.read_text())
        ids = [t.get("TrackID") for t in root.findall("COLLECTION/TRACK")]
        assert len(ids) == len(set(ids)) == int(root.find("COLLECTION").get("Entries"))
        playlist = root.find("PLAYLISTS/NODE/NODE/NODE")
        assert playlist.get("Name") == "My <Set>" and [t.get("Key") for t in playlist] == ids
        assert all(t.get("Location").startswith("file://localhost/") for t in root.findall("COLLECTION/TRACK"))


def test_foreign_collection(spark, tmp_path):
    """A file of another writer: nested folders, attributes that are missing or no numbers, literal plus signs, several anchors."""
    (tmp_path / "c.xml").write_text("""<?xml version="1.0" encoding="UTF-8"?>
<DJ_PLAYLISTS Version="1.0.0"><PRODUCT Name="x"/><COLLECTION Entries="3">
<TRACK TrackID="7" Name=" A &amp; B " Artist="" TotalTime="300" AverageBpm="128.00" Tonality="8A" Location="file://localhost/C:/a%20+b.mp3" Extra="1">
 <TEMPO Inizio="0.025" Bpm="128.00" Metro="4/4" Battito="1"/><TEMPO Inizio="60.5" Bpm="129.00" Metro="4/4" Battito="3"/>
 <POSITION_MARK Name="Drop" Type="0" Start="60.500" Num="0"/><POSITION_MARK Name="" Type="0" Start="x" Num="-1"/></TRACK>
<TRACK TrackID="8" Name="N" AverageBpm="fast" Location="file://localhost/home/x%C3%BC.mp3"/>
<TRACK TrackID="9" Location="file:///D:/y.mp3"/></COLLECTION>
<PLAYLISTS><NODE Type="0" Name="ROOT" Count="2"><NODE Name="One" Type="1" KeyType="0" Entries="3"><TRACK Key="8"/><TRACK Key="7"/><TRACK Key="8"/></NODE>
<NODE Name="F" Type="0"><NODE Name="G" Type="0"><NODE Name="Two" Type="1"><TRACK Key="9"/></NODE><NODE Name="None" Type="1"></NODE></NODE></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>
""")
    rows = {r["track_key"]: r for r in collection.tracks(collection.read_entries(spark, str(tmp_path))).collect()}
    assert sorted(rows) == ["7", "8", "9"]
    a, b, d = rows["7"], rows["8"], rows["9"]
    assert (a["name"], a["artist"], a["bpm"], a["duration"], a["path"]) == (" A & B ", "", 128.0, 300.0, "C:/a +b.mp3")
    assert [tuple(t) for t in a["tempo"]] == [(0.025, 128.0, "4/4", 1), (60.5, 129.0, "4/4", 3)] and [tuple(m) for m in a["marks"]] == [("Drop", 60.5, 0, True)]
    assert (b["bpm"], b["artist"], b["tempo"], b["marks"], b["path"]) == (None, None, [], [], "/home/xü.mp3") and d["path"] == "D:/y.mp3"
    members = collection.read_playlists(spark, str(tmp_path)).collect()
    assert sorted((r["playlist"], r["position"], r["track_key"]) for r in members) == [
        ("ROOT/F/G/Two", 0, "9"), ("ROOT/One", 0, "8"), ("ROOT/One", 1, "7"), ("ROOT/One", 2, "8")]
    with pytest.raises(Exception, match="deeper than 3"):
        collection.read_playlists(spark, str(tmp_path), depth=3).collect()
    catalog = {r["path"]: r for r in library.read_catalog(collection.catalog_rows(collection.tracks(collection.read_entries(spark, str(tmp_path))))).collect()}
    assert (catalog["c:/a +b.mp3"]["bpm"], catalog["c:/a +b.mp3"]["camelot"], catalog["c:/a +b.mp3"]["cues"]) == (128.0, "8A", [60.5])


def test_locations_and_relative_paths(spark):
    df = spark.createDataFrame([("C:\\Music\\a b & ü.mp3",), ("/home/x/y.mp3",), ("\\\\server\\share\\z.mp3",)], "p string")
    got = [tuple(r) for r in df.select(exports.location(F.col("p")), exports.relative_path(exports._portable(F.col("p")), "/home/sets/one")).collect()]
    assert got == [("file://localhost/C:/Music/a%20b%20%26%20%C3%BC.mp3", "C:/Music/a b & ü.mp3"),
                   ("file://localhost/home/x/y.mp3", "../../x/y.mp3"),
                   ("file://localhost//server/share/z.mp3", "\\\\server\\share\\z.mp3")]


def test_all_track_fields_are_kept(spark):
    fields = {"filePath": "/a.mp3", "avg_mids": 0.5, "mix_in_bars": 8, "genre_source": "tag", "mfcc_fingerprint": [1.0, 2.0], "syncopation": 0.3,
              "analysis_mode": "full", "analysis_coverage": [[0, 60]], "lufs_status": "ok", "phrase_grid": [0.0, 8.0], "phrases": [{"start_s": 1.5}],
              "cue_points": [{"t": 2.0, "name": "x"}], "ai_metadata": {"moods": ["dark"]}, "mix_in_candidates": [{"t": 3.0}], "unknown": 1}
    store = spark.createDataFrame([("2024-01-01", json.dumps(fields))], "ingest_ts string, data string")
    row = library.read_tracks(store).first().asDict()
    for name, value in fields.items():
        if name == "unknown":
            assert name not in row
        else:
            assert (json.loads(row[name]) if isinstance(value, (list, dict)) and isinstance(row[name], str) else row[name]) == value, name


def test_ground_truth_and_predictions(spark, tmp_path):
    (tmp_path / "truth.csv").write_text(
        "track_id,audio_path,audio_sha256,label_status,label_source,annotator_1,annotator_2,adjudicator,truth_bpm,truth_key_note,"
        "truth_key_mode,truth_genre,truth_mix_in_seconds,truth_mix_out_seconds,truth_sections_json,notes\n"
        't1,p,aa,adjudicated,s,x,y,z,128.5,A,Minor,Techno,30,,"[{""start_time"": 12.5, ""end_time"": 20, ""label"": ""main""}]",\n')
    r = library.read_ground_truth(spark, str(tmp_path / "truth.csv")).collect()[0]
    assert r["truth_bpm"] == 128.5 and r["truth_mix_out_seconds"] is None and r["truth_sections"][0]["start_time"] == 12.5
    document = {"metadata": {"app_version": "1", "source_commit": "c", "config_sha256": "a" * 64, "created_at": "now"},
                "predictions": [{"track_id": "t1", "bpm": 64.0}]}
    (tmp_path / "pred.json").write_text(json.dumps(document))
    assert library.read_predictions(spark, str(tmp_path / "pred.json")).collect()[0]["bpm"] == 64.0
    document["metadata"]["config_sha256"] = "zz"
    (tmp_path / "bad.json").write_text(json.dumps(document))
    with pytest.raises(Exception, match="metadata incomplete"):
        library.read_predictions(spark, str(tmp_path / "bad.json")).collect()


def _record(key, bpm, version=2, ts="2024-01-01T00:00:00Z", **more):
    data = {"filePath": f"/m/{key}.mp3", "fileName": f"{key}.mp3", "duration": 300.0, "bpm": bpm, **more}
    return json.dumps({"key": key, "version": version, "ingest_ts": ts, "data": json.dumps(data)})


def test_incremental_ingest(spark, tmp_path):
    source, store, rejects, check = (str(tmp_path / n) for n in ("in", "store", "rejects", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join([
        _record("a", 120), _record("b", 121), _record("c", 122, version=1), _record("d", 123, key_confidence=3)]))
    ingest.ingest_tracks(spark, source, store, rejects, check, 2).awaitTermination()
    (tmp_path / "in" / "2.json").write_text("\n".join([
        _record("a", 140, ts="2024-02-01T00:00:00Z"), _record("b", 99, ts="2023-01-01T00:00:00Z")]))
    ingest.ingest_tracks(spark, source, store, rejects, check, 2).awaitTermination()
    now = ingest.current_table(spark, store).select("key", F.get_json_object("data", "$.bpm").cast("int").alias("bpm")).collect()
    assert sorted((r["key"], r["bpm"]) for r in now) == [("a", 140), ("b", 121)]
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "1.json").write_text(_record("e", 150))
    ingest.ingest_tracks(spark, str(tmp_path / "more"), store, rejects, str(tmp_path / "check2"), 2).awaitTermination()
    assert {r["key"] for r in ingest.current_table(spark, store).collect()} == {"a", "b", "e"}   # a fresh checkpoint keeps the store
    bad = spark.read.parquet(rejects).collect()
    assert [(r["key"], r["reason"]) for r in bad] == [("d", "key_confidence liegt ausserhalb 0..1")]


def test_rating_stream(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    sheet = spark.createDataFrame([("p1", ""), ("p2", "3")], "pair_id string, rating string")
    rows = [("p1", 2, "2024-01-01T10:00:00Z"), ("p1", 5, "2024-01-01T10:05:00Z"), ("p1", 5, "2024-01-01T10:05:00Z"), ("zz", 1, "2024-01-01T10:00:00Z")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(("pair_id", "rating", "rated_at"), r))) for r in rows))
    ingest.merge_rating_stream(spark, source, sheet, target, check).awaitTermination()
    got = {r["pair_id"]: r["rating"] for r in ingest.current_table(spark, f"{target}/sheet", "pair_id string, rating string").collect()}
    assert got == {"p1": "5", "p2": "3"}
    # a late rating in a later run, and a new checkpoint over the old log
    (tmp_path / "in" / "2.json").write_text(json.dumps({"pair_id": "p2", "rating": 1, "rated_at": "2023-12-31T10:00:00Z"}))
    for at in (check, str(tmp_path / "check2")):
        ingest.merge_rating_stream(spark, source, sheet, target, at).awaitTermination()
        got = {r["pair_id"]: r["rating"] for r in ingest.current_table(spark, f"{target}/sheet", "pair_id string, rating string").collect()}
        assert got == {"p1": "5", "p2": "1"}


def test_rating_state_over_restarts(spark, tmp_path):
    """Late, repeated and equal-time ratings after a restart; pairs that become known later; only touched buckets are written."""
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    known = [(f"p{i}", "") for i in range(200)]

    def run(name, rows, sheet=known, at=check):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("pair_id", "rating", "rated_at"), r))) for r in rows))
        ingest.merge_rating_stream(spark, source, spark.createDataFrame(sheet, ingest.SHEET_SCHEMA), target, at).awaitTermination()
        return {r["pair_id"]: r["rating"] for r in ingest.current_table(spark, f"{target}/sheet", ingest.SHEET_SCHEMA).collect() if r["rating"]}

    first = [(f"p{i}", 3, "2024-01-01T10:00:00Z") for i in range(3)]
    assert run("1.json", first + [("late", 4, "2024-01-01T10:00:00Z"), (None, 5, "2024-01-01T10:00:00Z")]) == {"p0": "3", "p1": "3", "p2": "3"}
    ratings = BucketStore(spark, f"{target}/ratings", ingest.RATING_SCHEMA, "pair_id")
    before = _data_folders(ratings)
    # older than the winner, as old and higher, newer and lower, without a time
    got = run("2.json", [("p0", 1, "2023-12-31T10:00:00Z"), ("p1", 5, "2024-01-01T10:00:00Z"), ("p2", 1, "2024-01-01T10:00:01Z"), ("p0", 2, None)])
    assert got == {"p0": "3", "p1": "5", "p2": "1"}
    assert 0 < len(_data_folders(ratings) - before) <= 3          # three pairs met, at most three buckets written
    # a pair known now, and a fresh checkpoint that reads everything again
    assert run("3.json", [("p0", 3, "2024-01-01T10:00:00Z")], known + [("late", "")]) == {"p0": "3", "p1": "5", "p2": "1", "late": "4"}
    assert run("4.json", [("p1", 2, "2024-01-01T09:00:00Z")], known, str(tmp_path / "check2")) == {"p0": "3", "p1": "5", "p2": "1"}


def test_typed_open_fields(spark):
    """Broken elements, lists and records go to the rejects, one by one; what is not measured is NULL."""
    fields = {"filePath": "/a", "phrases": [{"start_s": 1.5, "end_s": 3, "label": "x", "kind": 1}, {"start_s": "z", "end_s": 2}, 5, None, {"start_s": 1}],
              "cue_points": [{"t": 2.0, "name": "n", "hot_cue": None}, {"t": -1}], "ai_metadata": {"moods": ["d"], "sub_genre": "s"},
              "analysis_coverage": [[0, 60], [5], [9, 1]],
              "mix_in_candidates": [{"t": 3.0, "schema": ["a", "b"], "kick_aktiv": True, "mood": {"a": 1}, "lufs_lokal": None}, {"t": 4, "energy_lokal": "loud"}]}
    store = [(1, json.dumps(fields)), (1, json.dumps({"filePath": "/b", "phrases": "x", "cue_points": {"t": 1}, "mix_out_candidates": [], "ai_metadata": [1]})),
             (1, json.dumps({"filePath": "/c", "phrases": None})), (1, "[")]
    tracks = library.read_tracks(spark.createDataFrame(store, "ingest_ts int, data string"))
    rows = {r["filePath"]: r for r in library.typed_fields(tracks).collect()}
    a, b, none = rows["/a"], rows["/b"], rows["/c"]
    assert [tuple(p) for p in a["phrases"]] == [(1.5, 3.0, "x", None, 1, None)] and [tuple(q) for q in a["cue_points"]] == [(2.0, "n", None, None, None)]
    (found,) = a["mix_in_candidates"]
    assert (found["t"], found["schema"], found["kick_aktiv"], found["lufs_lokal"], found["mood"]) == (3.0, ["a", "b"], True, None, '{"a":1}')
    assert [tuple(x) for x in a["analysis_coverage"]] == [(0.0, 60.0)] and (a["ai_metadata"]["moods"], a["ai_metadata"]["mix_in_time"]) == (["d"], None)
    for row in (b, none):
        assert row["ai_metadata"] is None and all(row[f] == [] for f in (*library.OPEN_FIELDS, "analysis_coverage"))
    got = sorted((r["filePath"], r["field"], r["position"], r["reason"]) for r in library.rejected_elements(tracks).collect())
    assert got == [("/a", "cue_points", 1, "t is no time"), ("/a", "mix_in_candidates", 1, "value of another type"), ("/a", "phrases", 1, "value of another type"),
                   ("/a", "phrases", 2, "no record"), ("/a", "phrases", 3, "no record"), ("/a", "phrases", 4, "end_s is no time"),
                   ("/b", "cue_points", -1, "no list"), ("/b", "phrases", -1, "no list")]


def _merge(old, new):
    return library.upsert_tracks(old, new, 2)


def _data_folders(store):
    return set(store.manifest()["folders"].values())


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    rows = lambda *keys, ts="2024-01-01": spark.createDataFrame([(k, 2, ts, f"{k}{ts}") for k in keys], "key string, version int, ingest_ts string, data string") \
        .withColumn("ingest_ts", F.to_timestamp("ingest_ts"))
    store = BucketStore(spark, str(tmp_path / "store"), ingest.RECORD_SCHEMA, buckets=8)
    assert store.read().count() == 0 and not store.exists()
    assert len(store.update(rows(*[f"k{i}" for i in range(100)]), _merge)) == 8
    before = _data_folders(store)
    (touched,) = store.update(rows("k7", ts="2024-02-01"), _merge)
    after = _data_folders(store)
    assert len(after) == 8 and len(after - before) == 1 and store.read().count() == 100
    assert {r["data"] for r in store.read().where("key = 'k7'").collect()} == {"k72024-02-01"}
    assert store.read(0).where("key = 'k7'").first()["data"] == "k72024-01-01"     # an older version can still be read
    assert store.update(rows("k7").limit(0), _merge) == [] and store.versions() == [0, 1]
    store.rebucket(3)
    assert len(_data_folders(store)) == 3 and store.read().count() == 100
    assert store.vacuum() == 9 and store.versions() == [2] and store.read().count() == 100
    assert BucketStore(spark, str(tmp_path / "store"), ingest.RECORD_SCHEMA, buckets=99).manifest()["buckets"] == 3


def test_store_survives_a_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", 2, "x")], "key string, version int, data string").withColumn("ingest_ts", F.current_timestamp()).select("key", "version", "ingest_ts", "data")
    store = BucketStore(spark, str(tmp_path / "store"), ingest.RECORD_SCHEMA)
    store.update(rows, _merge)
    commit = BucketStore._commit
    monkeypatch.setattr(BucketStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.update(rows.withColumn("key", F.lit("b")), _merge)
    assert [r["key"] for r in store.read().collect()] == ["a"]
    monkeypatch.setattr(BucketStore, "_commit", commit)
    store.update(rows.withColumn("key", F.lit("b")), _merge)
    assert sorted(r["key"] for r in store.read().collect()) == ["a", "b"]
    with pytest.raises(RuntimeError, match="someone else"):
        store._commit(1, 64, {})
    assert store.vacuum() == 1


def test_export_report_counts_the_errors_it_lists(spark):
    rows = spark.createDataFrame(
        [(1, 0, None, "/a", 120.0, 1.0, 0.5, 300.0, True, 10.0, 200.0), (1, 1, None, "/b", None, None, None, 300.0, None, None, None),
         (1, 2, "skipped", "/c", None, None, None, None, None, None, None), (2, 0, None, "/d", 120.0, 1.0, None, None, True, 10.0, 200.0), (3, 0, "gone", "", 1.0, 1.0, 1.0, 1.0, True, 1.0, 1.0)],
        "playlist_id int, pos int, export_error string, file_path string, bpm double, downbeat_confidence double, first_downbeat double, duration double, "
        "outro_covered boolean, mix_in_point double, mix_out_point double").withColumn("sections", F.lit(None).cast("array<struct<label:string,start_time:double>>"))
    listed = {r["playlist_id"]: r["count"] for r in exports.export_errors(rows).groupBy("playlist_id").count().collect()}
    got = {r["playlist_id"]: r for r in exports.export_report(rows).collect()}
    assert {p: r["n_errors"] for p, r in got.items()} == {1: 3, 2: 2, 3: 1} == listed
    assert {p: (r["tracks_written"], r["beatgrids_written"], r["status"]) for p, r in got.items()} == {1: (2, 1, "partial"), 2: (1, 0, "partial"), 3: (0, 0, "failed")}
