"""Word lists, lookup tables and constants of the DJ domain.

Everything here is data that decides results (codes, thresholds, texts).  The
logic that uses it lives in ``segue.functions`` and ``segue.operators``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------- fixed values
METER = 4
MIX_POINT_UNSET = -1.0
QUANTIZE_TOLERANCE_SEC = 0.05
PHRASE_CONFIDENCE_MIN = 0.25
DEFAULT_BPM = 120.0
DEFAULT_SECTION_ENERGY = 50.0
BPM_HALF_DOUBLE_PENALTY = 0.85
BPM_HALFTIME_MAX_RESULT = 185.0
MAX_OVERLAP_SECONDS = 64.0
MIN_TRANSITION_BARS = 8
GAIN_DIFF_SHOW_DB = 1.0
GAIN_DIFF_WARN_DB = 3.0
KEY_CONFIDENCE_UNCERTAIN = 0.5
VOCAL_CLASH_PENALTY = 0.06
LOOKAHEAD_FUTURE_WEIGHT = 0.7
LOOKAHEAD_TOP_K = 8
SMOOTHING_PASSES = 3
SMOOTHING_ENERGY_MAX = 20
ENERGY_WAVE_WINDOW = 8
MAX_FILE_SIZE = 500 * 1024 * 1024
MAX_TRACK_SECONDS = 7200.0
RMS_THRESHOLD = 0.4
CUE_DEDUPE_SEC = 2.0
CANDIDATES_PER_SIDE = 8
ENERGY_TREND_STEP = 10
ENERGY_JUMP_MIN = 20
DNB_MINIMUM_BPM = 160.0
DNB_LOW_BPM_PENALTY = 0.5
GENRE_CONFIDENCE_MIN = 0.4

# Pitch classes in semitone order; the wheel code of (note, mode) is a rule:
# a fifth is 7 semitones and one step on the wheel.
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MODES = ("Minor", "Major")

FLAT_TO_SHARP = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#",
                 "Cb": "B", "Fb": "E"}

CANONICAL_GENRES = (
    "Psytrance",
    "Tech House",
    "Progressive",
    "Melodic Techno",
    "Techno",
    "Deep House",
    "Trance",
    "Drum & Bass",
    "Minimal",
)

# genre -> bpm range, bpm centre, centroid Hz, onsets/s, flatness, RMS variance, bass
GENRE_PROFILES = {
    "Psytrance": ((135, 150), 142, (2000, 4500), (2.0, 5.0), (0.01, 0.08), (0.15, 0.6), (50, 90)),
    "Tech House": ((124, 135), 128, (1500, 3500), (3.5, 7.0), (0.04, 0.15), (0.05, 0.25), (35, 70)),
    "Progressive": ((120, 140), 126, (1200, 3200), (1.5, 4.5), (0.03, 0.12), (0.03, 0.20), (30, 65)),
    "Melodic Techno": ((120, 130), 125, (1500, 3800), (2.5, 5.5), (0.02, 0.10), (0.08, 0.35), (35, 70)),
    "Techno": ((130, 150), 138, (1800, 4000), (3.5, 7.0), (0.05, 0.18), (0.04, 0.22), (50, 90)),
    "Deep House": ((118, 128), 123, (1000, 2800), (2.0, 4.5), (0.03, 0.12), (0.02, 0.15), (30, 65)),
    "Trance": ((128, 145), 138, (2200, 5000), (2.0, 5.5), (0.01, 0.08), (0.15, 0.55), (40, 80)),
    "Drum & Bass": ((160, 180), 174, (1800, 4200), (5.0, 10.0), (0.04, 0.15), (0.10, 0.50), (60, 95)),
    "Minimal": ((120, 132), 126, (800, 2500), (1.5, 4.0), (0.03, 0.13), (0.01, 0.12), (25, 60)),
}

# canonical genre -> lower-case tag spellings
GENRE_TAGS = {
    "Psytrance": (
        "psytrance", "psy trance", "psy-trance", "psychedelic trance", "goa trance",
        "goa", "full on", "full-on", "dark psy", "dark psytrance", "forest",
        "hi-tech", "hitech"),
    "Tech House": (
        "tech house", "tech-house", "techhouse", "minimal tech house", "bass house"),
    "Progressive": (
        "progressive", "progressive house", "progressive trance", "prog house",
        "prog trance", "prog", "deep progressive"),
    "Melodic Techno": (
        "melodic techno", "melodic house & techno", "melodic house",
        "melodic house/techno", "indie dance"),
    "Techno": (
        "techno", "hard techno", "industrial techno", "acid techno",
        "detroit techno", "peak time techno", "peak time / driving",
        "peak time / driving techno", "raw techno", "warehouse techno"),
    "Deep House": (
        "organic house", "afro house", "deep house", "deep-house", "deephouse",
        "soulful house", "lounge house", "deep tech", "chill house", "jazzy house"),
    "Trance": (
        "trance", "uplifting trance", "vocal trance", "epic trance",
        "euphoric trance", "dream trance", "hard trance", "classic trance",
        "tech trance", "eurotrance"),
    "Drum & Bass": (
        "drum & bass", "drum and bass", "drum&bass", "dnb", "d&b", "d'n'b",
        "jungle", "liquid dnb", "liquid drum & bass", "neurofunk", "liquid funk",
        "jump up"),
    "Minimal": (
        "minimal", "minimal techno", "minimal house", "minimal tech",
        "micro house", "microhouse", "clicks & cuts", "glitch"),
}

# genre -> outro bars, transition bars, phrase bars, EQ text, technique text
MIX_PROFILES = {
    "Psytrance": ((32, 64), (16, 32), 16,
                  "Bass Swap an der Drop-Grenze",
                  "Langer Intro/Outro-Overlap mit Bass Swap"),
    "Tech House": ((16, 32), (8, 16), 8,
                   "Schneller Bass Swap, Hi-Hats laufen lassen",
                   "Enge Cuts, Loop-basiertes Mixen"),
    "Progressive": ((32, 64), (32, 64), 8,
                    "Langsamer EQ-Blend ueber 32+ Bars",
                    "Langer Layer-Blend mit graduellem EQ-Shift"),
    "Melodic Techno": ((32, 64), (16, 32), 8,
                       "Filter Ride, Bass vom Incoming cutten bis Breakdown",
                       "Filter Rides, Melodie-bewusstes Blending"),
    "Techno": ((16, 32), (16, 32), 8,
               "Bass Swap auf Phrasengrenze: Lows schnell (2-4 Bars), Mids langsam (bis 16 Bars)",
               "16-Bar Standard-Blend, 32 Bars fuer volle Layering-Blends"),
    "Deep House": ((32, 64), (32, 64), 8,
                   "Sanfter Bass-Blend ueber 32+ Bars, Mids smooth halten",
                   "Langer smooth Blend, Groove-Matching"),
    "Trance": ((32, 64), (32, 64), 16,
               "Bass Swap am Build, Melodie rein-filtern",
               "Breakdown-basiertes Blending, Melodie-Layering"),
    "Drum & Bass": ((16, 32), (8, 16), 8,
                    "Schneller Bass Swap, Drums laufen lassen",
                    "Double Drop, schnelle Cuts, DJ Neumark style"),
    "Minimal": ((32, 64), (32, 64), 8,
                "Subtiler Bass-Blend, Texturen langsam einblenden",
                "Sehr langer Blend, hypnotische Uebergaenge"),
}
DEFAULT_MIX_PROFILE = ((16, 32), (16, 32), 8, "Standard Bass Swap",
                       "Standard Intro/Outro-Blend")

# affinity of genre pairs; symmetric, equal genres 1.0
GENRE_AFFINITY = {
    ("Psytrance", "Tech House"): 0.3,
    ("Psytrance", "Progressive"): 0.6,
    ("Psytrance", "Melodic Techno"): 0.4,
    ("Psytrance", "Techno"): 0.5,
    ("Psytrance", "Deep House"): 0.15,
    ("Psytrance", "Trance"): 0.75,
    ("Psytrance", "Drum & Bass"): 0.25,
    ("Psytrance", "Minimal"): 0.2,
    ("Tech House", "Progressive"): 0.5,
    ("Tech House", "Melodic Techno"): 0.75,
    ("Tech House", "Techno"): 0.8,
    ("Tech House", "Deep House"): 0.7,
    ("Tech House", "Trance"): 0.35,
    ("Tech House", "Drum & Bass"): 0.2,
    ("Tech House", "Minimal"): 0.75,
    ("Progressive", "Melodic Techno"): 0.85,
    ("Progressive", "Techno"): 0.55,
    ("Progressive", "Deep House"): 0.65,
    ("Progressive", "Trance"): 0.8,
    ("Progressive", "Drum & Bass"): 0.2,
    ("Progressive", "Minimal"): 0.6,
    ("Melodic Techno", "Techno"): 0.8,
    ("Melodic Techno", "Deep House"): 0.65,
    ("Melodic Techno", "Trance"): 0.7,
    ("Melodic Techno", "Drum & Bass"): 0.2,
    ("Melodic Techno", "Minimal"): 0.6,
    ("Techno", "Deep House"): 0.4,
    ("Techno", "Trance"): 0.55,
    ("Techno", "Drum & Bass"): 0.35,
    ("Techno", "Minimal"): 0.8,
    ("Deep House", "Trance"): 0.3,
    ("Deep House", "Drum & Bass"): 0.1,
    ("Deep House", "Minimal"): 0.65,
    ("Trance", "Drum & Bass"): 0.3,
    ("Trance", "Minimal"): 0.35,
    ("Drum & Bass", "Minimal"): 0.15,
}

# technique and EQ text of two different genres (either order)
CROSS_GENRE = {
    ("Psytrance", "Progressive"): (
        "Gradual BPM transition, blend during breakdowns",
        "Cut Psy bass early, blend progressive bass in slowly"),
    ("Tech House", "Melodic Techno"): (
        "Quick bass swap, match groove patterns",
        "Quick bass swap, watch mid frequencies for clashing melodies"),
    ("Progressive", "Melodic Techno"): (
        "Long blend over 32 bars, filter ride",
        "Gradual bass crossfade, use filter on incoming"),
    ("Psytrance", "Tech House"): (
        "Difficult mix - use breakdown bridge, adjust BPM early",
        "Full bass swap at phrase boundary, careful with mid clash"),
    ("Psytrance", "Melodic Techno"): (
        "Blend during breakdowns, gradual tempo shift",
        "Filter ride on incoming, swap bass at breakdown"),
    ("Tech House", "Progressive"): (
        "Match groove, gradual filter blend",
        "Gradual bass blend, keep hi-hats from tech house"),
    ("Techno", "Tech House"): (
        "Quick bass swap, Groove-Match -- verwandte Genres",
        "Schneller Bass Swap, Hi-Hats matchen"),
    ("Techno", "Melodic Techno"): (
        "Filter Ride auf Melodie, Bass swap am Breakdown",
        "Filter auf Incoming-Melodie, Bass swap am Drop"),
    ("Techno", "Minimal"): (
        "Langer Blend, Texturen langsam aufbauen/abbauen",
        "Subtiler Bass-Blend, Texturen langsam einblenden"),
    ("Techno", "Psytrance"): (
        "BPM matchen, Breakdown-Bridge nutzen",
        "Harter Bass Swap an Phrase-Grenze, Psy-Bass frueh cutten"),
    ("Techno", "Trance"): (
        "Breakdown-Blend, BPM langsam angleichen",
        "Bass Swap am Breakdown, Trance-Melodie filtern"),
    ("Techno", "Progressive"): (
        "Filter-Blend, Energie langsam anpassen",
        "Gradueller Bass-Blend, Techno-Kick langsam rausnehmen"),
    ("Deep House", "Tech House"): (
        "Groove-Match, sanfter Bass-Blend ueber 32 Bars",
        "Sanfter Bass-Blend, Groove matchen, Hi-Hats laufen lassen"),
    ("Deep House", "Melodic Techno"): (
        "Melodien layern, sanfter Uebergang",
        "Langer Bass-Crossfade, Mids sauber halten"),
    ("Deep House", "Progressive"): (
        "Langer atmosphaerischer Blend",
        "Sehr langer Bass-Blend, alles smooth halten"),
    ("Deep House", "Minimal"): (
        "Hypnotischer Blend, subtile Textur-Shifts",
        "Subtile EQ-Shifts, beide Basse blenden"),
    ("Trance", "Progressive"): (
        "Breakdown-Blend, Progressive Trance als Bridge",
        "Langer Blend, Trance-Bass im Breakdown cutten"),
    ("Trance", "Psytrance"): (
        "Verwandte Genres -- Breakdown-Overlap, BPM matchen",
        "Bass Swap an der Phrase-Grenze, Energie matchen"),
    ("Trance", "Melodic Techno"): (
        "Melodie-Layering, Filter Ride",
        "Melodie-Clash vermeiden, Bass swap, Mids filtern"),
    ("Drum & Bass", "Techno"): (
        "Half-Time DnB oder Tempo-Jump am Drop",
        "Harter Bass Swap, DnB-Sub frueh cutten"),
    ("Drum & Bass", "Trance"): (
        "Breakdown-Bridge, harter Tempo-Wechsel",
        "Full Cut am Drop, keine Bass-Ueberlappung"),
}

WEIGHT_DEFAULTS = {
    "harmonic_weight": 0.160,
    "bpm_weight": 0.120,
    "energy_weight": 0.120,
    "genre_weight": 0.120,
    "groove_weight": 0.300,
    "bass_weight": 0.080,
    "timbre_weight": 0.050,
    "mood_weight": 0.050,
    "groove_sim_floor": 0.65,
    "bass_delta_max": 0.50,
    "brightness_delta_max": 60.0,
}
PUNCH_DELTA_MAX = 1.4
FLATNESS_DELTA_MAX = 0.15
MODE_SWITCH_PENALTY = 0.15
BASS_PATTERN_SHARE = 0.6

MELODIC_GENRES = ("Melodic Techno", "Progressive", "Trance", "Deep House")
EQ_SWAP_GENRES = ("Tech House", "Techno", "Minimal", "Psytrance")
BASS_SWAP_GENRES = ("Tech House", "Techno", "Drum & Bass", "Minimal", "Psytrance")

AI_METADATA_VERSION = 1
AI_PROMPT_VERSION = "2026-07-20"


# ------------------------------------------------------------- derived tables
def wheel_codes() -> dict[tuple[str, str], str]:
    """(note, mode) -> wheel code, from the circle of fifths."""
    codes = {}
    for i, note in enumerate(NOTES):
        codes[note, "Minor"] = f"{(i * 7 + 4) % 12 + 1}A"
        codes[note, "Major"] = f"{(i * 7 + 7) % 12 + 1}B"
    return codes


def literal(value) -> str:
    """SQL text of a fixed value."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def map_column(mapping: dict) -> Column:
    """A MAP literal, as one expression text (one call for the whole table)."""
    return F.expr(f"map({', '.join(f'{literal(k)}, {literal(v)}' for k, v in mapping.items())})")


def array_column(values) -> Column:
    return F.expr(f"array({', '.join(literal(v) for v in values)})")


def lookup(mapping: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(map_column(mapping), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def affinity_rows() -> list[tuple[str, str, float]]:
    """Affinity with lower-case names in sorted order, one row per unordered pair."""
    rows = [(g.lower(), g.lower(), 1.0) for g in CANONICAL_GENRES]
    for (a, b), value in GENRE_AFFINITY.items():
        lo, hi = sorted((a.lower(), b.lower()))
        rows.append((lo, hi, value))
    return rows


def genre_affinity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(affinity_rows(), "g_lo string, g_hi string, affinity double")


def mix_profile_rows() -> list[tuple]:
    return [(name.lower(), float(o[0]), float(o[1]), float(t[0]), float(t[1]), phrase, eq, technique)
            for name, (o, t, phrase, eq, technique) in MIX_PROFILES.items()]


def weight_rows() -> list[tuple]:
    return [(genre, *WEIGHT_DEFAULTS.values()) for genre in CANONICAL_GENRES]


def genre_weights(spark: SparkSession) -> DataFrame:
    """Scoring weights and tolerances, one row per canonical genre."""
    cols = ", ".join(f"{name} double" for name in WEIGHT_DEFAULTS)
    return spark.createDataFrame(weight_rows(), f"genre string, {cols}")


def tag_rows() -> list[tuple[str, str]]:
    return [(tag, genre) for genre, tags in GENRE_TAGS.items() for tag in tags]
