"""Musical keys on the 12-step wheel: parsing, conversion, distance, scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segue import refdata as R

_CODE = r"^(1[0-2]|[1-9])([AB])\z"


def key_to_camelot(note: Column, mode: Column) -> Column:
    """Wheel code of a note and mode; unknown combinations give ''."""
    table = {f"{n}|{m}": code for (n, m), code in R.wheel_codes().items()}
    return R.lookup(table, F.concat_ws("|", F.coalesce(note, F.lit("")), F.coalesce(mode, F.lit(""))), "")


def camelot_number(code: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(code, F.lit("")), _CODE, 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def camelot_letter(code: Column) -> Column:
    return F.regexp_extract(F.coalesce(code, F.lit("")), _CODE, 2)


def wheel_distance(num_a: Column, num_b: Column) -> Column:
    gap = F.abs(num_a - num_b)
    return F.least(gap, F.lit(12) - gap)


def camelot_distance(code_a: Column, code_b: Column) -> Column:
    """Steps between two codes; NULL if either is not a code."""
    na, nb = camelot_number(code_a), camelot_number(code_b)
    return F.when((na > 0) & (nb > 0), wheel_distance(na, nb))


def text_key_to_camelot(text: Column) -> Column:
    """Key text of another catalogue ('Am', 'Bb', '8A') to a wheel code, NULL if unknown."""
    key = F.trim(text)
    minor = key.endswith("m")
    note = F.regexp_replace(key, r"m\z", "")
    flats = {f: s for f, s in R.FLAT_TO_SHARP.items() if f not in ("Cb", "Fb")}
    sharp = F.coalesce(R.lookup(flats, note), note)
    converted = F.nullif(key_to_camelot(sharp, F.when(minor, F.lit("Minor")).otherwise(F.lit("Major"))), F.lit(""))
    return F.when(camelot_number(key) > 0, key).otherwise(converted)


def camelot_to_text(code: Column) -> Column:
    """Wheel code to the key spelling of the export format."""
    return R.lookup(EXPORT_KEYS, F.upper(F.trim(code)))


def normalize_note(note: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(note, F.lit(""))))
    flat = F.concat(F.substring(text, 1, 1), F.lit("b"))
    upper_flats = {f.upper(): s for f, s in R.FLAT_TO_SHARP.items()}
    return F.coalesce(
        R.lookup(upper_flats, text),
        F.when((F.length(text) == 2) & text.endswith("B"), flat).otherwise(text))


def normalize_mode(mode: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    return F.when(text == "major", "Major").when(text == "minor", "Minor").otherwise("")


def normalize_text(text: Column) -> Column:
    lowered = F.translate(F.lower(F.coalesce(text, F.lit(""))), "_", " ")
    return F.trim(F.regexp_replace(lowered, r"\s+", " "))


def key_class(pred_note: Column, pred_mode: Column, true_note: Column, true_mode: Column) -> Column:
    """exact / relative / fifth / wrong / invalid."""
    pred = key_to_camelot(normalize_note(pred_note), normalize_mode(pred_mode))
    true = key_to_camelot(normalize_note(true_note), normalize_mode(true_mode))
    steps = wheel_distance(camelot_number(pred), camelot_number(true))
    same_mode = camelot_letter(pred) == camelot_letter(true)
    return (F.when((pred == "") | (true == ""), "invalid")
            .when(pred == true, "exact")
            .when((steps == 0) & ~same_mode, "relative")
            .when((steps == 1) & same_mode, "fifth")
            .otherwise("wrong"))


def harmonic_score(num_a: Column, letter_a: Column, num_b: Column, letter_b: Column,
                   bpm_diff: Column, bpm_relation: Column, tol: float | Column,
                   strictness: int | Column = 7, experimental: bool | Column = True) -> Column:
    """0..100 mixing score of two keys behind the tempo gate.

    The clockwise step from A to B decides the rule, so each rule is one
    comparison; +2, +4 and +7 are one-way, +-1 is not.  The settings are numbers or columns.
    """
    strictness = strictness if isinstance(strictness, Column) else F.lit(strictness)
    experimental = experimental if isinstance(experimental, Column) else F.lit(experimental)
    penalty = F.when(bpm_relation == "direct", F.lit(1.0)).otherwise(F.lit(R.BPM_HALF_DOUBLE_PENALTY))
    loose = F.greatest(F.lit(0.4), F.least(F.lit(1.0), 1.0 - (strictness - 7) * 0.08))
    step = F.pmod(num_b - num_a, F.lit(12))
    same = letter_a == letter_b

    def points(value: float | Column, factor: float | Column = 1.0) -> Column:
        return (F.lit(value) * penalty * F.lit(factor)).cast("int")

    rules = (F.when(bpm_diff > tol, F.lit(0))
             .when((num_a == 0) | (num_b == 0), points(10.0))
             .when(same & (step == 0), points(100.0))
             .when((step == 0) & (letter_a == "A"), points(90.0))
             .when(step == 0, points(85.0))
             .when(same & step.isin(1, 11), points(80.0))
             .when(same & (step == 2), points(75.0, loose))
             .when(experimental & same & (step == 4), points(70.0, loose))
             .when(experimental & same & (step == 7), points(65.0, loose)))
    return (rules.when(~same & step.isin(1, 11), points(60.0, loose))
            .otherwise(F.greatest(F.lit(5), points((15 - strictness).cast("double")))))


# fixed values: key spelling in the export format
EXPORT_KEYS = {
    "1A": "Abm", "2A": "Ebm", "3A": "Bbm", "4A": "Fm", "5A": "Cm", "6A": "Gm",
    "7A": "Dm", "8A": "Am", "9A": "Em", "10A": "Bm", "11A": "Gbm", "12A": "Dbm",
    "1B": "B", "2B": "Gb", "3B": "Db", "4B": "Ab", "5B": "Eb", "6B": "Bb",
    "7B": "F", "8B": "C", "9B": "G", "10B": "D", "11B": "A", "12B": "E",
}
