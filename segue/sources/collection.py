"""Reading a collection file (XML) back: tracks, marks, playlists, and catalogue rows made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

#: Attributes of a collection entry as text: a value that is no number must not cost the whole entry.  Names are fixed values.
TRACK_FIELDS = ("TrackID", "Name", "Artist", "Genre", "TotalTime", "AverageBpm", "Tonality", "Location", "Key")
TEMPO_FIELDS = ("Inizio", "Bpm", "Metro", "Battito")
MARK_FIELDS = ("Name", "Type", "Start", "Num")
PLAYLIST = "1"


def _texts(*names: str) -> str:
    return ", ".join(f"_{n} string" for n in names)


ENTRY_SCHEMA = (f"{_texts(*TRACK_FIELDS)}, TEMPO array<struct<{_texts(*TEMPO_FIELDS)}>>, "
                f"POSITION_MARK array<struct<{_texts(*MARK_FIELDS)}>>")


def _node(depth: int) -> str:
    inner = f", NODE array<struct<{_node(depth - 1)}>>" if depth > 1 else ""
    return f"{_texts('Name', 'Type')}, TRACK array<struct<_Key string>>{inner}"


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of one tag with the file they stand in, and the folder's ``name=value`` parts as columns."""
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(path)
    return rows.withColumn("file", c("_metadata.file_path"))


def _number(name: str) -> Column:
    return F.expr(f"try_cast(trim({name}) AS double)")


def local_path(address: Column) -> Column:
    """Path of a file address: percent codes decoded, ``+`` kept, other addresses unchanged.

    Inverse of :func:`segue.sources.exports.location`, with ``/`` between folders.
    """
    rest = F.regexp_extract(address, r"(?i)^file://(?:localhost)?/(.*)$", 1)
    plain = F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    return (F.when(~F.coalesce(address.rlike(r"(?i)^file://(?:localhost)?/"), F.lit(False)), address)
            .when(plain.rlike("^[A-Za-z]:"), plain).otherwise(F.concat(F.lit("/"), plain)))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Collection entries as written: one row per ``TRACK`` element that has a number, attributes as text."""
    return _read(spark, path, "TRACK", ENTRY_SCHEMA).where(c("_TrackID").isNotNull())


def tracks(entries: DataFrame) -> DataFrame:
    """Typed collection entries.

    Values that are no numbers, or missing, are NULL.  ``tempo`` holds the tempo anchors
    in order (start, bpm, meter, beat), ``marks`` the cue marks (name, start, num, hot);
    a mark without a start is left out.  Entries are not made unique here.
    """
    def number(x: Column) -> Column:
        return F.trim(x).try_cast("double")

    anchors = F.transform("TEMPO", lambda t: F.struct(
        number(t["_Inizio"]).alias("start"), number(t["_Bpm"]).alias("bpm"), t["_Metro"].alias("meter"), number(t["_Battito"]).cast("int").alias("beat")))
    marks = F.transform("POSITION_MARK", lambda m: F.struct(
        F.coalesce(m["_Name"], F.lit("")).alias("name"), number(m["_Start"]).alias("start"), F.coalesce(number(m["_Num"]).cast("int"), F.lit(-1)).alias("num"),
        F.coalesce(number(m["_Num"]) >= 0, F.lit(False)).alias("hot")))
    given = [n for n in entries.columns if n not in {f"_{f}" for f in TRACK_FIELDS} | {"TEMPO", "POSITION_MARK"}]
    return entries.select(
        *[f"`{n}`" for n in given], c("_TrackID").alias("track_key"), c("_Name").alias("name"), c("_Artist").alias("artist"), c("_Genre").alias("genre"),
        _number("_TotalTime").alias("duration"), _number("_AverageBpm").alias("bpm"), c("_Tonality").alias("key_text"),
        local_path(c("_Location")).alias("path"), F.coalesce(anchors, F.array().cast("array<struct<start:double,bpm:double,meter:string,beat:int>>")).alias("tempo"),
        F.filter(F.coalesce(marks, F.array().cast("array<struct<name:string,start:double,num:int,hot:boolean>>")), lambda m: m["start"].isNotNull()).alias("marks"))


def read_playlists(spark: SparkSession, path: str, depth: int = 6) -> DataFrame:
    """Membership of the playlists of each file: file, playlist (its folders and name), position from 0, track_key.

    The tree of a file is one row, so it is bounded by that file's playlists, not by its
    collection; playlists below ``depth`` levels make the job fail instead of missing.
    """
    level = _read(spark, path, "NODE", _node(depth + 1)).withColumn("place", F.array().cast("array<string>"))
    given = [n for n in level.columns if n not in ("_Name", "_Type", "TRACK", "NODE", "place")]
    found = None
    for at in range(depth + 1):
        level = level.withColumn("place", F.concat("place", F.array(F.coalesce("_Name", F.lit("")))))
        lists = level.where(c("_Type") == PLAYLIST)
        if at == depth:
            level = level.where(F.when(F.size("place") > depth, F.raise_error(F.lit(f"playlists deeper than {depth} levels")).cast("boolean")))
            lists = level
        rows = lists.select(*given, F.array_join("place", "/").alias("playlist"), F.posexplode("TRACK").alias("position", "t")).select(
            *given, "playlist", "position", c("t._Key").alias("track_key"))
        found = rows if found is None else found.unionByName(rows)
        if at < depth:
            level = level.select(*given, "place", F.explode("NODE").alias("n")).select(*given, "place", "n.*")
    return found


def catalog_rows(tracks_: DataFrame) -> DataFrame:
    """Collection tracks as input of :func:`segue.sources.library.read_catalog` (tempo in hundredths, distinct cue seconds)."""
    return tracks_.select(
        c("track_key").alias("content_id"), "path", F.round(c("bpm") * 100).cast("int").alias("raw_bpm"), "key_text",
        c("duration").alias("length"), c("name").alias("title"), "artist", F.nullif("genre", F.lit("")).alias("genre"),
        F.array_sort(F.array_distinct(F.transform("marks", lambda m: m["start"]))).alias("cues"))
