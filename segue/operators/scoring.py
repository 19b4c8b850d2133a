"""Eight mixing factors and the overall score of a track pair.

Pure projections over the flat pair rows of :mod:`segue.operators.pairs`.  An
undeterminable factor is NULL; its weight goes to the other factors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue import refdata as R
from segue.functions import keys
from segue.operators import pairs

FACTORS = ("harmonic", "bpm", "energy", "genre", "groove", "bass", "timbre", "mood")
CLASSIC_SHARES = {"harmonic": 0.44, "bpm": 0.28, "energy": 0.28}
DIRECTIONS = {"Build Up": "up", "up": "up", "Cool Down": "down", "down": "down",
              "Maintain": "maintain", "maintain": "maintain"}


def unit(value: Column) -> Column:
    """Clamp to 0..1, keeping NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def tempo_smoothness(diff: Column, tol: float | Column) -> Column:
    half = F.greatest(tol / 2.0, F.lit(1e-9)) if isinstance(tol, Column) else F.lit(max(tol / 2.0, 1e-9))
    return F.when(diff > tol, 0.0).otherwise(F.exp(-diff / half))


def energy_flow(energy_a: Column, energy_b: Column, direction: str | None = None) -> Column:
    step = (energy_b - energy_a).cast("double")
    kind = DIRECTIONS.get(direction or "")
    if kind == "up":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), step) / 50.0)
    if kind == "down":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), -step) / 50.0)
    return F.greatest(F.lit(0.0), 1.0 - F.abs(step) / (50.0 if kind == "maintain" else 100.0))


def closeness(delta: Column, widest: Column | float) -> Column:
    """1 at no difference, 0 from ``widest`` on."""
    widest = F.lit(float(widest)) if not isinstance(widest, Column) else widest
    return F.when(widest <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(delta) / widest))


def with_cosines(df: DataFrame) -> DataFrame:
    """Raw cosines of the three vectors, as their own step so that each is computed once."""
    def cosine(name: str) -> Column:
        products = [F.col(f"a_{name}_{i}") * F.col(f"b_{name}_{i}") for i in range(pairs.VECTORS[name][1])]
        return F.when(F.col(f"a_has_{name}") & F.col(f"b_has_{name}"), reduce(lambda x, y: x + y, products))

    single = {f"{side}_{x}" for side in "ab" for x in pairs.VECTOR_COLUMNS}
    return df.select(*[c for c in df.columns if c not in single], cosine("groove").alias("onset_cosine"),
                     cosine("bass").alias("bass_cosine"), cosine("timbre").alias("timbre_cosine"))


def groove_match(floor: Column | float) -> Column:
    onset, bass = unit(F.col("onset_cosine")), unit(F.col("bass_cosine"))
    share = R.BASS_PATTERN_SHARE
    raw = F.coalesce(bass * share + onset * (1.0 - share), onset, bass)
    floor = F.lit(float(floor)) if not isinstance(floor, Column) else floor
    return F.when(floor >= 1.0, raw).otherwise(unit((raw - floor) / (1.0 - floor)))


def bass_continuity(sub_max: Column | float) -> Column:
    known = (F.col("a_sub_energy") > 0) & (F.col("b_sub_energy") > 0)
    sub = closeness(F.col("a_out_sub") - F.col("b_in_sub"), sub_max)
    punch = closeness(F.col("a_out_punch") - F.col("b_in_punch"), R.PUNCH_DELTA_MAX)
    return F.when(known, sub * 0.6 + punch * 0.4)


def mood_match(bright_max: Column | float) -> Column:
    known = (F.col("a_brightness") > 0) & (F.col("b_brightness") > 0)
    bright = closeness((F.col("a_brightness") - F.col("b_brightness")).cast("double"), bright_max)
    flat = closeness(F.col("a_flatness") - F.col("b_flatness"), R.FLATNESS_DELTA_MAX)
    score = bright * 0.7 + flat * 0.3
    switch = ((F.col("a_key_mode") != "") & (F.col("b_key_mode") != "")
              & (F.col("a_key_mode") != F.col("b_key_mode")))
    return F.when(known & switch, F.greatest(F.lit(0.0), score - R.MODE_SWITCH_PENALTY)).when(known, score)


def ai_bonus() -> Column:
    """0..0.14 for shared moods and sub-genres of two current descriptions."""
    moods_a, moods_b = F.col("a_ai_moods"), F.col("b_ai_moods")
    most = F.greatest(F.size(moods_a), F.size(moods_b))
    moods = F.when((F.size(moods_a) > 0) & (F.size(moods_b) > 0),
                   F.size(F.array_intersect(moods_a, moods_b)).cast("double") / most * 0.08)
    sub_a, sub_b = F.col("a_ai_sub_genre"), F.col("b_ai_sub_genre")
    both = (sub_a != "") & (sub_b != "")
    sub = (F.when(both & (sub_a == sub_b), 0.06)
           .when(both & (F.contains(sub_a, sub_b) | F.contains(sub_b, sub_a)), 0.03))
    return F.least(F.lit(0.14), F.coalesce(moods, F.lit(0.0)) + F.coalesce(sub, F.lit(0.0)))


def combine_weighted(values: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Weighted mean over the factors that are not NULL, 0 if none is."""
    def add(terms):
        return reduce(lambda x, y: x + y, terms)

    total = add([F.when(values[f].isNotNull(), weights[f]).otherwise(0.0) for f in FACTORS])
    score = add([F.coalesce(weights[f] * values[f], F.lit(0.0)) for f in FACTORS])
    return F.when(total > 0, score / total).otherwise(0.0)


def score_pairs(candidates: DataFrame, tol: float | Column, *, strictness: int | Column = 7, experimental: bool | Column = True,
                direction: str | None = None, weights: DataFrame | None = None,
                classic: bool = False) -> DataFrame:
    """Score candidate pairs; ``overall_score`` 0..1 and ``objective`` 0..100.

    ``weights`` overrides the per-genre weights (genre of A).  ``classic`` uses
    the four-factor formula.  Tolerance, strictness and experimental steps are numbers or
    columns of the candidates.
    """
    df = candidates
    if weights is not None:
        prefixed = weights.select("genre", *[F.col(c).alias(f"w_{c}") for c in R.WEIGHT_DEFAULTS])
        df = pairs.with_weights(df, prefixed, "a_genre")

    def setting(name: str) -> Column:
        return F.lit(R.WEIGHT_DEFAULTS[name]) if weights is None else F.col(f"w_{name}")

    df = with_cosines(df).select(
        "*",
        keys.harmonic_score(F.col("a_num"), F.col("a_letter"), F.col("b_num"), F.col("b_letter"),
                            F.col("bpm_diff"), F.col("bpm_relation"), tol, strictness, experimental).alias("harmonic"),
        tempo_smoothness(F.col("bpm_diff"), tol).alias("bpm_smoothness"),
        energy_flow(F.col("a_energy"), F.col("b_energy"), direction).alias("energy_flow"),
        pairs.genre_affinity(F.col("a_genre_id"), F.col("b_genre_id")).alias("genre_compatibility"),
        groove_match(setting("groove_sim_floor")).alias("groove_match"),
        bass_continuity(setting("bass_delta_max")).alias("bass_continuity"),
        unit(F.col("timbre_cosine")).alias("timbre_match"),
        mood_match(setting("brightness_delta_max")).alias("mood_match"),
        ai_bonus().alias("ai_bonus"))

    values = dict(zip(FACTORS, (F.col("harmonic") / 100.0, F.col("bpm_smoothness"), F.col("energy_flow"),
                                F.col("genre_compatibility"), F.col("groove_match"), F.col("bass_continuity"),
                                F.col("timbre_match"), F.col("mood_match"))))
    if classic:
        genre_share = F.when((F.col("a_genre") != "Unknown") & (F.col("b_genre") != "Unknown"), 0.2).otherwise(0.1)
        base = sum((1.0 - genre_share) * share * values[f] for f, share in CLASSIC_SHARES.items()) \
            + genre_share * values["genre"]
        df = df.withColumns({c: F.lit(None).cast("double") for c in
                             ("groove_match", "bass_continuity", "timbre_match", "mood_match")})
    else:
        known_genres = F.col("a_genre_id").isNotNull() & F.col("b_genre_id").isNotNull()
        shares = {f: setting(f"{f}_weight") for f in FACTORS}
        shares["genre"] = shares["genre"] * F.when(known_genres, 1.0).otherwise(0.5)
        base = combine_weighted(values, shares)
    overall = F.least(F.lit(1.0), base + F.col("ai_bonus"))
    overall = F.when(F.col("a_vocal") & F.col("b_vocal"),
                     F.greatest(F.lit(0.0), overall - R.VOCAL_CLASH_PENALTY)).otherwise(overall)
    overall = F.when(F.col("bpm_diff") > tol, 0.0).otherwise(overall)
    return (df.withColumn("overall_score", overall)
            .withColumn("objective", F.rint(F.col("overall_score") * 100.0).cast("int")))


PAIR_SCORES = ("playlist_id", "a_input_pos", "b_input_pos", "a_track_id", "b_track_id", "bpm_diff",
               "bpm_relation", "harmonic", "bpm_smoothness", "energy_flow", "genre_compatibility",
               "groove_match", "bass_continuity", "timbre_match", "mood_match", "ai_bonus",
               "overall_score", "objective")


def scored_playlist_pairs(tracks: DataFrame, tol: float, **options) -> DataFrame:
    """Candidate pairs of every playlist with their scores."""
    candidates = pairs.candidate_pairs(pairs.pair_features(tracks), tol)
    return score_pairs(candidates, tol, **options)
