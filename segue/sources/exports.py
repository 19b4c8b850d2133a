"""Playlists as M3U8 text and DJ-software XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import keys, text
from segue.operators import quality
from segue.sources import textfiles

c = F.col
REFERENCE_BEATGRID = 1.0


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def _portable(path: Column) -> Column:
    """Forward slashes, except for network paths; no line breaks."""
    flat = F.replace(F.replace(path, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))
    return F.when(flat.startswith("\\\\"), flat).otherwise(F.replace(flat, F.lit("\\"), F.lit("/")))


def relative_path(path: Column, folder: str) -> Column:
    """A portable path as seen from a folder; unchanged if they share no beginning (another drive, a network path)."""
    base = F.array(*[F.lit(part) for part in folder.replace("\\", "/").rstrip("/").split("/")])
    parts = F.split(path, "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size(base)), lambda k: F.slice(parts, F.lit(1), k) == F.slice(base, F.lit(1), k)))
    up = F.repeat(F.lit("../"), F.size(base) - shared)
    rest = F.array_join(F.slice(parts, shared + 1, F.greatest(F.size(parts) - shared, F.lit(0))), "/")
    return F.when((shared > 0) & ~path.startswith("\\\\"), F.concat(up, rest)).otherwise(path)


def m3u8_lines(ordered: DataFrame, name: str = "Playlist", relative_to: str | None = None) -> DataFrame:
    """Lines of one M3U8 file per playlist: (playlist_id, line_no, line).

    ``ordered``: playlist_id, pos, file_path, artist, title, duration.  Tracks
    without a path are left out.  With ``relative_to``, the folder that the files
    will lie in, paths are written as seen from there.
    """
    safe = name.replace("\r", " ").replace("\n", " ")
    head = ordered.select("playlist_id").distinct().select(
        "playlist_id", F.lit(-1).cast("long").alias("pos"),
        F.posexplode(F.array(*[F.lit(x) for x in ("#EXTM3U", "#EXTENC:UTF-8", f"#PLAYLIST:{safe}", "")])).alias("at", "line"))
    artist = F.coalesce(F.nullif(c("artist"), F.lit("")), F.lit("Unknown Artist"))
    title = F.coalesce(F.nullif(c("title"), F.lit("")), text.basename(c("file_path")))
    info = F.concat(F.lit("#EXTINF:"), F.coalesce("duration", F.lit(0.0)).cast("long").cast("string"), F.lit(","),
                    _one_line(artist), F.lit(" - "), _one_line(title))
    place = _portable(c("file_path"))
    if relative_to is not None:
        place = relative_path(place, relative_to)
    body = ordered.where(F.length("file_path") > 0).select(
        "playlist_id", c("pos").cast("long").alias("pos"),
        F.posexplode(F.array(info, place, F.lit(""))).alias("at", "line"))
    rows = head.unionByName(body)
    order = Window.partitionBy("playlist_id").orderBy("pos", "at")
    return rows.select("playlist_id", (F.row_number().over(order) - 1).alias("line_no"), "line")


def write_m3u8(lines: DataFrame, path: str) -> None:
    """One text file per playlist, in line order."""
    (lines.repartition("playlist_id").sortWithinPartitions("playlist_id", "line_no")
     .select("playlist_id", c("line").alias("value")).write.mode("overwrite").partitionBy("playlist_id").text(path))


def deduplicated(ordered: DataFrame) -> DataFrame:
    """Rows of a playlist with an ``export_error`` for missing paths and repeated locations.

    Kept rows (no error) are numbered ``xml_id`` from 1 in playlist order.
    """
    place = F.lower(c("file_path"))
    first = Window.partitionBy("playlist_id", place).orderBy("pos")
    label = F.coalesce(F.nullif(c("title"), F.lit("")), F.lit("?"))
    rows = ordered.withColumn("copy", F.row_number().over(first))
    error = (F.when(F.coalesce(F.length("file_path"), F.lit(0)) == 0,
                    F.concat(F.lit("Track uebersprungen (kein Dateipfad): "), label))
             .when(c("copy") > 1, F.concat(F.lit("Track uebersprungen (Duplikat): "), c("file_path"))))
    rows = rows.withColumn("export_error", error).drop("copy")
    running = Window.partitionBy("playlist_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.when(c("export_error").isNull(), 1).otherwise(0)).over(running)
    return rows.withColumn("xml_id", F.when(c("export_error").isNull(), number))


def xml_collection(rows: DataFrame) -> DataFrame:
    """Collection rows: one per kept track, attributes named as in the file.

    ``rows`` is the result of :func:`deduplicated`.  A tempo anchor is given
    only for a reference-grade beat grid.
    """
    detected = F.trim(F.coalesce("detected_genre", F.lit("")))
    anchored = ((c("bpm") > 0) & (c("downbeat_confidence") == REFERENCE_BEATGRID)
                & (c("first_downbeat") >= 0) & (c("first_downbeat") < c("duration")))
    code = keys.key_to_camelot(c("key_note"), c("key_mode"))
    return rows.where(c("export_error").isNull()).select(
        "playlist_id", c("xml_id").cast("string").alias("_TrackID"),
        F.coalesce(F.nullif("title", F.lit("")), text.basename(c("file_path"))).alias("_Name"),
        F.coalesce(F.nullif("artist", F.lit("")), F.lit("Unknown Artist")).alias("_Artist"),
        F.when((detected != "") & (F.lower(detected) != "unknown"), detected)
        .otherwise(F.trim(F.coalesce("genre", F.lit("")))).alias("_Genre"),
        F.when(c("duration") > 0, c("duration").cast("long").cast("string")).alias("_TotalTime"),
        F.when(c("bpm") > 0, F.format_string("%.2f", c("bpm"))).alias("_AverageBpm"),
        keys.camelot_to_text(code).alias("_Tonality"), c("file_path").alias("_Location"),
        F.when(anchored, F.struct(c("first_downbeat").alias("_Inizio"), c("bpm").alias("_Bpm"),
                                  F.lit("4/4").alias("_Metro"), F.lit(1).alias("_Battito"))).alias("TEMPO"))


def xml_marks(rows: DataFrame) -> DataFrame:
    """Cue marks per kept track: mix points twice (hot and memory), drops and breakdowns once."""
    ok = quality.cue_export_ok(c("outro_covered"), c("mix_in_point"), c("mix_out_point"), c("duration"))

    def mark(name: Column | str, start: Column, number: int) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), start.alias("start"),
                        F.lit(number).alias("num"))

    parts = F.transform(F.filter("sections", lambda s: s["label"].isin("drop", "breakdown") & (s["start_time"] > 0)),
                        lambda s: mark(F.upper(s["label"]), s["start_time"], -1))
    points = F.array(mark("MIX IN", c("mix_in_point"), 0), mark("MIX IN", c("mix_in_point"), -1),
                     mark("MIX OUT", c("mix_out_point"), 1), mark("MIX OUT", c("mix_out_point"), -1))
    return rows.where(c("export_error").isNull() & ok).select(
        "playlist_id", "xml_id", F.posexplode(F.concat(points, parts)).alias("mark_no", "m")).select(
        "playlist_id", "xml_id", "mark_no", "m.name", "m.start", "m.num")


def xml_playlist(rows: DataFrame) -> DataFrame:
    """Membership of playlists: position and collection number."""
    return rows.where(c("export_error").isNull()).select("playlist_id", "pos", "xml_id")


def location(path: Column) -> Column:
    """File address of a path: percent-encoded, separators and drive colon kept."""
    encoded = F.url_encode(F.replace(path, F.lit("\\"), F.lit("/")))
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit("file://localhost/"), F.regexp_replace(encoded, "^/", ""))


def _attributes(**values: Column) -> Column:
    """Attributes as XML text; those without a value are left out."""
    def one(name: str, value: Column) -> Column:
        text_ = value.cast("string")
        for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text_ = F.replace(text_, F.lit(sign), F.lit(code))
        return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), text_, F.lit('"'))).otherwise("")
    return F.concat(*[one(n, v) for n, v in values.items()])


def xml_document(rows: DataFrame, name: str = "Playlist", folder: str = "Playlists") -> DataFrame:
    """Lines of one XML file per playlist: (playlist_id, part, xml_id, seq, line), in that order.

    ``rows`` is the result of :func:`deduplicated`.  Part 1 holds the collection: each
    kept track with its tempo anchor and cue marks; part 3 the playlist tree with the
    track numbers, which are unique in the file.  Nothing is numbered over a whole
    playlist here, so a long one needs no single task before it is written.
    """
    lists = rows.groupBy("playlist_id").agg(F.count_if(c("export_error").isNull()).alias("n"))
    entry = F.concat(F.lit('<NODE Type="1" KeyType="0"'), _attributes(Name=F.lit(name), Entries=c("n")), F.lit(">"))
    frame = lists.select("playlist_id", F.explode(F.array(*[
        F.struct(F.lit(part).alias("part"), F.lit(at).alias("seq"), line.alias("line")) for part, at, line in (
            (0, 0, F.lit('<?xml version="1.0" encoding="UTF-8"?>')), (0, 1, F.lit('<DJ_PLAYLISTS Version="1.0.0">')),
            (0, 2, F.concat(F.lit("<COLLECTION"), _attributes(Entries=c("n")), F.lit(">"))),
            (2, 0, F.lit("</COLLECTION>")), (2, 1, F.lit('<PLAYLISTS><NODE Type="0" Name="ROOT" Count="1">')),
            (2, 2, F.concat(F.lit('<NODE Type="0" Count="1"'), _attributes(Name=F.lit(folder)), F.lit(">"))), (2, 3, entry),
            (4, 0, F.lit("</NODE></NODE></NODE></PLAYLISTS>")), (4, 1, F.lit("</DJ_PLAYLISTS>")))])).alias("x")).select(
        "playlist_id", "x.part", F.lit(0).cast("long").alias("xml_id"), "x.seq", "x.line")
    tracks = xml_collection(rows).withColumn("xml_id", c("_TrackID").cast("long"))
    head = F.concat(F.lit("<TRACK"), _attributes(
        TrackID=c("_TrackID"), Name=c("_Name"), Artist=c("_Artist"), Genre=c("_Genre"), TotalTime=c("_TotalTime"),
        AverageBpm=c("_AverageBpm"), Tonality=c("_Tonality"), Location=location(c("_Location"))), F.lit(">"))
    tempo_line = F.concat(F.lit("<TEMPO"), _attributes(Inizio=F.format_string("%.3f", F.rint(c("TEMPO._Inizio") * 1000.0) / 1000.0), Bpm=F.format_string("%.2f", c("TEMPO._Bpm")),
                                                       Metro=c("TEMPO._Metro"), Battito=c("TEMPO._Battito")), F.lit("/>"))
    outer = tracks.select("playlist_id", F.lit(1).alias("part"), "xml_id", F.explode(F.array_compact(F.array(
        F.struct(F.lit(-2).alias("seq"), head.alias("line")),
        F.when(c("TEMPO").isNotNull(), F.struct(F.lit(-1).alias("seq"), tempo_line.alias("line"))),
        F.struct(F.lit(1 << 30).alias("seq"), F.lit("</TRACK>").alias("line"))))).alias("x")).select("playlist_id", "part", "xml_id", "x.seq", "x.line")
    mark = F.concat(F.lit("<POSITION_MARK"), _attributes(Name=c("name"), Type=F.lit("0"), Start=F.format_string("%.3f", F.rint(c("start") * 1000.0) / 1000.0), Num=c("num")), F.lit("/>"))
    marks = xml_marks(rows).select("playlist_id", F.lit(1).alias("part"), c("xml_id").cast("long").alias("xml_id"), c("mark_no").cast("int").alias("seq"), mark.alias("line"))
    members = xml_playlist(rows).select("playlist_id", F.lit(3).alias("part"), c("xml_id").cast("long").alias("xml_id"), F.lit(0).alias("seq"),
                                        F.concat(F.lit("<TRACK"), _attributes(Key=c("xml_id")), F.lit("/>")).alias("line"))
    return frame.unionByName(outer).unionByName(marks).unionByName(members)


def write_xml(document: DataFrame, path: str) -> None:
    """One XML file per playlist from the lines of :func:`xml_document`.

    Dealt by a hash of the playlist: the parts of the document are each dealt by playlist, so Spark
    takes their union to be dealt that way and leaves out a plain ``repartition("playlist_id")``,
    after which every part would make a file of its own.

    Under a ``file:`` address the tasks write the files themselves, in the same folders: Hadoop's local
    file system starts processes to set the modes of every file, which takes longer than the file.
    """
    rows = document.repartition(F.xxhash64("playlist_id")).sortWithinPartitions("playlist_id", "part", "xml_id", "seq")
    folder = textfiles.local_folder(path)
    if folder:
        textfiles.write_texts(rows, "playlist_id", "line", folder)
    else:
        rows.select("playlist_id", c("line").alias("value")).write.mode("overwrite").partitionBy("playlist_id").text(path)


def _outcome() -> tuple[Column, Column, Column, Column]:
    """What an export does with a row: kept, cues written, beat grid written, and its problems.  The texts are fixed values."""
    kept = c("export_error").isNull()
    cues_ok = F.coalesce(quality.cue_export_ok(c("outro_covered"), c("mix_in_point"), c("mix_out_point"), c("duration")), F.lit(False))
    tempo_ok = F.coalesce(c("bpm") > 0, F.lit(False))
    grid_ok = tempo_ok & F.coalesce((c("downbeat_confidence") == REFERENCE_BEATGRID) & (c("first_downbeat") >= 0)
                                    & (c("first_downbeat") < c("duration")), F.lit(False))
    grid = (F.when(~tempo_ok, ": Beatgrid fehlt wegen ungueltiger BPM")
            .when(~grid_ok, ": Beatgrid ausgelassen (kein verlaesslicher Downbeat)"))
    problems = F.array_compact(F.array(
        c("export_error"), F.when(kept, F.concat(c("file_path"), grid)),
        F.when(kept & ~cues_ok, F.concat(c("file_path"), F.lit(": Cues ausgelassen (Coverage/Schema/Provenienz unzureichend)")))))
    return kept, cues_ok, grid_ok, problems


def export_errors(rows: DataFrame) -> DataFrame:
    """One row per problem of an export: (playlist_id, pos, error)."""
    return rows.select("playlist_id", "pos", F.explode(_outcome()[3]).alias("error"))


def export_report(rows: DataFrame) -> DataFrame:
    """Per playlist: status, tracks, cues and beat grids written, number of errors (the rows of :func:`export_errors`)."""
    kept, cues_ok, grid_ok, problems = _outcome()
    n_parts = F.coalesce(F.size(F.filter("sections", lambda s: s["label"].isin("drop", "breakdown") & (s["start_time"] > 0))), F.lit(0))
    out = rows.groupBy("playlist_id").agg(
        F.sum(kept.cast("int")).alias("tracks_written"),
        F.sum(F.when(kept & cues_ok, 4 + n_parts).otherwise(0)).alias("cues_written"),
        F.sum((kept & grid_ok).cast("int")).alias("beatgrids_written"), F.sum(F.size(problems)).alias("n_errors"))
    return out.withColumn("status", F.when(c("tracks_written") == 0, "failed").when(c("n_errors") > 0, "partial")
                          .otherwise("success"))
