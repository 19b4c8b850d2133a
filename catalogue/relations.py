"""Music relations derived from the driver tables, once for Spark and once as SQL.

Scalar columns share one expression text for both engines (``1e0`` is a DOUBLE
literal in both).  Only array handling is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segue import lineage
from segue import refdata as R

GENRE_LIST = list(R.CANONICAL_GENRES) + ["Unknown", "House", "techno"]
TAG_LIST = ["Psytrance", "House", "Unknown", "tech house", "Melodic House & Techno", "Deep House",
            "trance", "Drum & Bass", "", "progressive", "Ambient", "Minimal"]


def pick(values: list, index: str) -> str:
    """CASE that picks a list entry, readable by both engines."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


TRACK_COLUMNS = {
    "track_id": "k",
    "playlist_id": "CAST(floor(k / 50e0) AS BIGINT)",
    "input_pos": "k % 50",
    "file_path": "concat('C:/music/', p_brand, '/', CAST(k AS STRING), '.mp3')",
    "title": "p_name",
    "artist": "p_brand",
    "genre": pick(TAG_LIST, "(k * 5) % 12"),
    "detected_genre": pick(GENRE_LIST, "k % 12"),
    "bpm": "90e0 + floor((k * 37 % 900) / 10e0)",
    "key_note": "CASE WHEN k % 17 = 0 THEN '' ELSE " + pick(list(R.NOTES), "(k * 7) % 12") + " END",
    "key_mode": "CASE WHEN k % 17 = 0 THEN '' WHEN (k * 7) % 24 < 12 THEN 'Minor' ELSE 'Major' END",
    "key_confidence": "(k % 11) / 10e0",
    "energy": "CAST(k * 13 % 101 AS INT)",
    "bass_intensity": "CAST(k * 3 % 101 AS INT)",
    "duration": "180e0 + (k * 29 % 300)",
    "brightness": "CAST(k * 11 % 101 AS INT)",
    "flatness": "(k % 30) / 200e0",
    "sub_energy": "(k % 13) / 26e0",
    "bass_punch": "1e0 + (k % 15) / 10e0",
    "avg_bass": "(k * 3 % 101) * 1e0",
    "lufs": "CASE WHEN k % 21 = 0 THEN 0e0 ELSE -6e0 - (k % 80) / 10e0 END",
    "percussive_ratio": "(k * 17 % 100) / 100e0",
    "vocal_instrumental": pick(["vocal", "instrumental", "unknown"], "k % 3"),
    "first_downbeat": "(k % 8) / 16e0",
    "downbeat_confidence": "(k % 4) / 4e0",
    "first_phrase": "CASE WHEN k % 5 = 0 THEN -1e0 ELSE (k % 8) / 16e0 + (k % 3) * 2e0 END",
    "phrase_confidence": "(k % 7) / 7e0",
    "mix_in_point": "CASE WHEN k % 10 = 0 THEN -1e0 ELSE 16e0 + (k * 7 % 40) END",
    "mix_out_point": "CASE WHEN k % 9 = 0 THEN -1e0 ELSE 160e0 + (k * 29 % 300) - (k * 3 % 50) END",
    "phrase_unit": "CAST(CASE WHEN k % 2 = 0 THEN 8 ELSE 16 END AS INT)",
    "outro_covered": "k % 6 <> 0",
    "ai_current": "k % 4 <> 3",
    "ai_sub_genre": pick(["Deep Tech", "Tech", "Peak Time", "Dub"], "(k * 3) % 4"),
    "ai_mood_1": pick(["Dark", "warm", "driving"], "k % 3"),
    "ai_mood_2": pick(["hypnotic", "dark ", "uplifting", "raw"], "(k * 5) % 4"),
}
# SQL types that the two engines spell differently
_TO_DUCK = (("AS STRING)", "AS VARCHAR)"), ("AS INT)", "AS INTEGER)"))

SECTION_COLUMNS = {
    "label": ("CASE WHEN section_idx = 0 AND track_id % 4 <> 0 THEN 'intro' "
              "WHEN section_idx = n_sections - 1 AND track_id % 5 <> 0 THEN 'outro' "
              "WHEN section_idx = 1 AND track_id % 23 = 0 THEN 'unanalysed' "
              "ELSE " + pick(["main", "build", "drop", "breakdown"], "(l_linenumber + track_id) % 4") + " END"),
    "avg_energy": "l_quantity * 2e0",
    "avg_bass": "l_quantity * 2e0",
    "sub_energy": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 5e0 END",
    "bass_punch": "1e0 + l_tax * 10e0",
    "section_bpm": "100e0 + track_id % 60",
}


def duck(expr: str) -> str:
    for spark_type, duck_type in _TO_DUCK:
        expr = expr.replace(spark_type, duck_type)
    return expr


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def sections(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Long form: one row per section of a track, ordered by ``section_idx``.

    ``of`` (one ``l_orderkey`` column) keeps only those tracks, before any window.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    whole = Window.partitionBy("l_orderkey")
    items = read(spark, sf, "lineitem")
    rows = items.count()   # from the footers
    items = lineage.spread(items if of is None else items.join(of, "l_orderkey", "left_semi"), "l_orderkey", rows)
    lines = items.select(
        F.col("l_orderkey").alias("track_id"), "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax",
        (F.row_number().over(order) - 1).alias("section_idx"),
        F.count("*").over(whole).alias("n_sections"),
        F.sum(F.col("l_quantity") + 16.0).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end_time"),
        F.sum(F.col("l_quantity") + 16.0).over(whole).alias("duration"))
    return lines.select(
        "track_id", F.col("section_idx").cast("long"), "n_sections", "l_partkey",
        (F.col("end_time") - F.col("l_quantity") - 16.0).alias("start_time"), "end_time", "duration",
        *[F.expr(e).alias(c) for c, e in SECTION_COLUMNS.items()])


SECTIONS_SQL = f"""
SELECT track_id, section_idx, n_sections, l_partkey, end_time - l_quantity - 16e0 AS start_time, end_time, duration,
       {', '.join(f'{duck(e)} AS {c}' for c, e in SECTION_COLUMNS.items())}
FROM (SELECT l_orderkey AS track_id, l_linenumber, l_partkey, l_quantity, l_discount, l_tax,
             row_number() OVER o - 1 AS section_idx, count(*) OVER w AS n_sections,
             sum(l_quantity + 16e0) OVER (o ROWS UNBOUNDED PRECEDING) AS end_time,
             sum(l_quantity + 16e0) OVER w AS duration
      FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey),
             o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    positive = F.transform(e, F.abs)
    return read(spark, sf, "embeddings").select(
        F.col("vec_id"), e.alias("raw"), F.slice(positive, 1, 16).alias("groove_pattern"),
        F.slice(positive, 17, 16).alias("bass_pattern"), F.slice(positive, 33, 13).alias("timbre"))


VECTORS_SQL = """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS raw,
       list_transform(CAST(embedding[1:16] AS DOUBLE[]), lambda x: abs(x)) AS groove_pattern,
       list_transform(CAST(embedding[17:32] AS DOUBLE[]), lambda x: abs(x)) AS bass_pattern,
       list_transform(CAST(embedding[33:45] AS DOUBLE[]), lambda x: abs(x)) AS timbre
FROM embeddings"""


def track_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections stretched to the duration of the track with the same number."""
    dur = F.expr(TRACK_COLUMNS["duration"].replace("k ", "track_id "))
    s = sections(spark, sf, read(spark, sf, "part").select(F.col("p_partkey").alias("l_orderkey")))
    return s.select(
        "track_id", "section_idx", "n_sections", "label",
        (F.col("start_time") / F.col("duration") * dur).alias("start_time"),
        (F.col("end_time") / F.col("duration") * dur).alias("end_time"),
        "avg_energy", "avg_bass", "sub_energy", "bass_punch")


TRACK_SECTIONS_SQL = f"""
SELECT track_id, section_idx, n_sections, label,
       start_time / duration * ({TRACK_COLUMNS['duration'].replace('k ', 'track_id ')}) AS start_time,
       end_time / duration * ({TRACK_COLUMNS['duration'].replace('k ', 'track_id ')}) AS end_time,
       avg_energy, avg_bass, sub_energy, bass_punch
FROM sections WHERE track_id < (SELECT max(p_partkey) + 1 FROM part)"""

VECTOR_COLUMNS = ("groove_pattern", "bass_pattern", "timbre")


VECTORS = "(SELECT count(*) FROM embeddings)"


def vector_number(spark: SparkSession, sf: str, key: str):
    """The vector of a key: keys go round all rows of ``embeddings``."""
    return F.pmod(F.col(key), read(spark, sf, "embeddings").agg(F.count("*")).scalar())


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Track records: scalars from ``part``, vectors from ``embeddings``, sections from ``lineitem``."""
    part = read(spark, sf, "part").withColumnRenamed("p_partkey", "k").withColumn("vec_id", vector_number(spark, sf, "k"))
    arrays = track_sections(spark, sf).groupBy("track_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "section_idx", "label", "start_time", "end_time", "avg_energy", "avg_bass",
            "sub_energy", "bass_punch"))).alias("sections")).withColumnRenamed("track_id", "k")
    joined = part.join(vectors(spark, sf).drop("raw"), "vec_id").join(arrays, "k", "left")
    empty = F.array().cast("array<double>")
    scalars = {c: F.expr(e) for c, e in TRACK_COLUMNS.items() if not c.startswith("ai_")}
    return lineage.stored(joined.select(
        *[e.alias(c) for c, e in scalars.items()],
        *[F.when(F.expr("k % 19 = 0"), empty).otherwise(F.col(c)).alias(c) for c in VECTOR_COLUMNS],
        F.coalesce("sections", F.array().cast(arrays.schema["sections"].dataType)).alias("sections"),
        F.struct(F.expr(TRACK_COLUMNS["ai_current"]).alias("current"),
                 F.array(F.expr(TRACK_COLUMNS["ai_mood_1"]), F.expr(TRACK_COLUMNS["ai_mood_2"])).alias("moods"),
                 F.expr(TRACK_COLUMNS["ai_sub_genre"]).alias("sub_genre")).alias("ai")))


TRACKS_SQL = f"""
SELECT {', '.join(f'{duck(e)} AS {c}' for c, e in TRACK_COLUMNS.items())},
       {', '.join(f"CASE WHEN k % 19 = 0 THEN [] ELSE {c} END AS {c}" for c in VECTOR_COLUMNS)}
FROM (SELECT *, p_partkey AS k FROM part) JOIN vectors ON vec_id = k % {VECTORS}"""


def _values(rows: list[tuple]) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{float(v)!r}e0"
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


CTES: dict[str, str] = {
    "sections": SECTIONS_SQL,
    "vectors": VECTORS_SQL,
    "track_sections": TRACK_SECTIONS_SQL,
    "tracks": TRACKS_SQL,
    "affinity": f"SELECT * FROM ({_values(R.affinity_rows())}) AS t(g_lo, g_hi, affinity)",
    "wheel": "SELECT * FROM (" + _values([(n, m, c) for (n, m), c in R.wheel_codes().items()]) + ") AS t(note, mode, code)",
    "mix_profiles": f"SELECT * FROM ({_values(R.mix_profile_rows())}) AS t(genre_key, outro_min, outro_max, "
                    "trans_min, trans_max, phrase_bars, eq, technique)",
    "genre_tags": f"SELECT * FROM ({_values(R.tag_rows())}) AS t(tag, canonical)",
}
