"""Pairs of tracks: tempo range join, genre affinity, weight and profile lookups.

Pairs are flat rows with ``a_`` and ``b_`` columns.  Everything that depends on
one track alone (wheel number, vector lengths, values at the mix points) is
computed once per track by :func:`pair_features` before any pair exists, so the
join carries few, narrow columns and sections never travel through it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import refdata as R
from segue.functions import keys, sections, tempo, text, vectors

# vectors as single columns: a pair's cosine is then a short sum of products in generated code
VECTORS = {"groove": ("groove_pattern", 16), "bass": ("bass_pattern", 16), "timbre": ("timbre", 13)}
VECTOR_COLUMNS = tuple(x for name, (_, n) in VECTORS.items() for x in (f"has_{name}", *[f"{name}_{i}" for i in range(n)]))
FEATURES = ("bpm", "num", "letter", "key_mode", "energy", "genre", "genre_id", "brightness", "flatness",
            "sub_energy", "out_sub", "out_punch", "in_sub", "in_punch", "vocal",
            *VECTOR_COLUMNS,
            "ai_moods", "ai_sub_genre")


def genre_id(genre: Column) -> Column:
    """Index of a canonical genre (any letter case), NULL for every other name."""
    return R.lookup({g.lower(): i for i, g in enumerate(R.CANONICAL_GENRES)}, F.lower(genre))


def pair_features(tracks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The per-track columns that pair scoring needs, one row per playlist slot."""
    code = keys.key_to_camelot(F.col("key_note"), F.col("key_mode"))
    genre = text.resolved_genre(F.col("detected_genre"), F.col("genre"))

    def at_seam(point: str) -> tuple[Column, Column]:
        found = sections.section_at(F.col("sections"), F.col(point))
        usable = found["sub_energy"].isNotNull() & found["bass_punch"].isNotNull()
        return (F.when(usable, found["sub_energy"]).otherwise(F.col("sub_energy")),
                F.when(usable, found["bass_punch"]).otherwise(F.col("bass_punch")))

    out_sub, out_punch = at_seam("mix_out_point")
    in_sub, in_punch = at_seam("mix_in_point")
    ai = F.col("ai")
    moods = F.array_distinct(F.transform(F.filter(ai["moods"], lambda m: m != ""), lambda m: F.lower(F.trim(m))))
    measured = tracks.withColumns({f"len_{name}": vectors.norm(F.col(vector), n) for name, (vector, n) in VECTORS.items()})
    return measured.select(
        "playlist_id", "input_pos", "track_id", *keep,
        "bpm", keys.camelot_number(code).alias("num"), keys.camelot_letter(code).alias("letter"),
        "key_mode", "energy", genre.alias("genre"), genre_id(genre).alias("genre_id"),
        "brightness", "flatness", "sub_energy",
        out_sub.alias("out_sub"), out_punch.alias("out_punch"),
        in_sub.alias("in_sub"), in_punch.alias("in_punch"),
        (F.col("vocal_instrumental") == "vocal").alias("vocal"),
        *[x for name, (vector, n) in VECTORS.items() for x in (
            F.col(f"len_{name}").isNotNull().alias(f"has_{name}"),
            *[F.coalesce(F.get(vector, F.lit(i)) / F.col(f"len_{name}"), F.lit(0.0)).alias(f"{name}_{i}") for i in range(n)])],
        F.when(ai["current"], moods).alias("ai_moods"),
        F.when(ai["current"], F.lower(F.trim(ai["sub_genre"]))).alias("ai_sub_genre"))


def prefixed(df: DataFrame, prefix: str, shared: Sequence[str] = ("playlist_id",)) -> DataFrame:
    return df.select(*shared, *[F.col(c).alias(prefix + c) for c in df.columns if c not in shared])


def candidate_pairs(features: DataFrame, tol: float | str) -> DataFrame:
    """All ordered slot pairs of a playlist within ``tol`` BPM, half and double time included.

    A range join on buckets.  The B side appears as its three tempo images (as
    is, doubled, halved); a pair is emitted only for the image that is nearest
    in A's tempo space, so no later de-duplication is needed.  The A side visits
    its own bucket and both neighbours.  The bucket is part of the join key: a
    large playlist is spread over its tempo buckets.  The result has every pair, so
    it grows with the square of the tracks that share a playlist and a tempo;
    :func:`top_partners` cuts it to k a track.  ``tol`` is a number or the name of a
    feature that is the same for all tracks of a playlist.
    """
    def tolerance(side: str) -> Column:
        return F.col(side + tol) if isinstance(tol, str) else F.lit(float(tol))

    def bucket(value: Column, side: str) -> Column:
        return F.floor(value / F.when(tolerance(side) > 0, tolerance(side) * 1.01).otherwise(1e-6))

    a = prefixed(features, "a_").withColumn(
        "bucket", F.explode(F.array(*[bucket(F.col("a_bpm"), "a_") + d for d in (-1, 0, 1)])))
    b = (prefixed(features, "b_")
         .withColumn("image", F.explode(F.array(
             F.struct(F.lit("direct").alias("relation"), F.col("b_bpm").alias("bpm")),
             F.struct(F.lit("half").alias("relation"), (F.col("b_bpm") * 2.0).alias("bpm")),
             F.struct(F.lit("double").alias("relation"), (F.col("b_bpm") / 2.0).alias("bpm")))))
         .select("*", F.col("image.relation").alias("bpm_relation"), bucket(F.col("image.bpm"), "b_").alias("bucket"))
         .drop("image"))
    diff = tempo.effective_bpm_diff(F.col("a_bpm"), F.col("b_bpm"))
    relation = tempo.bpm_relation(F.col("a_bpm"), F.col("b_bpm"))
    return (a.join(b, ["playlist_id", "bucket"])
            .where((F.col("a_input_pos") != F.col("b_input_pos"))
                   & (F.col("bpm_relation") == relation) & (diff <= tolerance("a_")))
            .withColumn("bpm_diff", diff)
            .drop("bucket"))


def genre_affinity(id_a: Column, id_b: Column) -> Column:
    """Affinity of two canonical genre indexes; 0.5 if either is NULL."""
    known = {(a, b): v for a, b, v in R.affinity_rows()}
    names = [g.lower() for g in R.CANONICAL_GENRES]
    matrix = [known[tuple(sorted((x, y)))] for x in names for y in names]
    cell = F.get(R.array_column(matrix), id_a * len(names) + id_b)
    return F.coalesce(cell, F.lit(0.5))


def with_genre_affinity(df: DataFrame, genre_a: str, genre_b: str) -> DataFrame:
    """Affinity of two genre-name columns as ``genre_compatibility``."""
    return df.withColumn("genre_compatibility",
                         genre_affinity(genre_id(F.col(genre_a)), genre_id(F.col(genre_b))))


def resolve_weights(defaults: DataFrame, *overrides: DataFrame) -> DataFrame:
    """Weights per canonical genre; each override replaces the non-NULL keys it has.

    Rows of unknown genres in an override are ignored, and of a repeated genre the
    largest values count, so the result stays at one row per canonical genre.
    """
    out = defaults
    for override in overrides:
        columns = [c for c in override.columns if c in defaults.columns and c != "genre"]
        renamed = override.groupBy("genre").agg(*[F.max(c).alias(f"new_{c}") for c in columns])
        out = out.join(renamed.join(defaults.select("genre"), "genre", "left_semi"), "genre", "left")
        out = out.select("genre", *[
            (F.coalesce(f"new_{c}", c) if c in columns else F.col(c)).alias(c)
            for c in defaults.columns if c != "genre"])
    return out


def with_weights(df: DataFrame, weights: DataFrame, genre: str) -> DataFrame:
    """Attach the weight row of a genre; other genres get the first canonical one.

    ``weights`` has one row per canonical genre (see :func:`resolve_weights`).
    """
    known = F.when(F.col(genre).isin(*R.CANONICAL_GENRES), F.col(genre)).otherwise(R.CANONICAL_GENRES[0])
    return (df.withColumn("weight_genre", known)
            .join(weights.withColumnRenamed("genre", "weight_genre"), "weight_genre", "left")
            .drop("weight_genre"))


def mix_profile(genre: Column) -> Column:
    """Struct of mix conventions of a genre (any letter case), else the default."""
    def as_struct(outro, transition, phrase, eq, technique):
        return F.struct(F.lit(float(outro[0])).alias("outro_min"), F.lit(float(outro[1])).alias("outro_max"),
                        F.lit(float(transition[0])).alias("trans_min"), F.lit(float(transition[1])).alias("trans_max"),
                        F.lit(phrase).alias("phrase_unit"), F.lit(eq).alias("eq"), F.lit(technique).alias("technique"))

    rows = [as_struct(*R.MIX_PROFILES[g]) for g in R.CANONICAL_GENRES]
    return F.coalesce(F.get(F.array(*rows), genre_id(genre)), as_struct(*R.DEFAULT_MIX_PROFILE))


def with_mix_profile(tracks: DataFrame, genre: str = "detected_genre") -> DataFrame:
    return tracks.withColumn("profile", mix_profile(F.col(genre)))


def top_partners(pairs: DataFrame, k: int, score: str = "objective") -> DataFrame:
    """The k best partners of every slot; equal scores go to the earlier slot."""
    order = Window.partitionBy("playlist_id", "a_input_pos").orderBy(F.desc(score), "b_input_pos")
    return (pairs.withColumn("partner_rank", F.row_number().over(order))
            .where(F.col("partner_rank") <= k))


def eligible_pairs(scored: DataFrame, same_genre: bool = False, max_bpm: float = 2.0, min_harmonic: int = 60,
                   min_overall: float = 0.70, min_groove: float = 0.5) -> DataFrame:
    """Pairs worth a listening test: close, harmonic, and with every factor known."""
    rule = ((F.col("bpm_diff") <= max_bpm) & (F.col("harmonic") >= min_harmonic)
            & (F.col("overall_score") >= min_overall) & (F.col("groove_match") >= min_groove)
            & F.col("bass_continuity").isNotNull() & F.col("timbre_match").isNotNull()
            & F.col("mood_match").isNotNull())
    if same_genre:
        rule = rule & (F.col("a_genre") == F.col("b_genre"))
    return scored.where(rule)
