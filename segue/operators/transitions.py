"""Planning the transition between neighbours of an ordered playlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import refdata as R
from segue.functions import grid, keys, sections, tempo
from segue.operators import mixpoints, pairs, scoring

a = lambda name: F.col(f"a_{name}")
b = lambda name: F.col(f"b_{name}")

PLAN_COLUMNS = ("duration", "mix_in_point", "mix_out_point", "detected", "detected_id", "phrase_bars", "trans_min",
                "trans_max", "eq", "technique", "anchor", "intro_end", "outro_start", "sections", "avg_bass", "lufs",
                "key_confidence", "percussive_ratio", "code", "first_downbeat", "downbeat_confidence", "file_path")


def plan_features(ordered: DataFrame, order: str = "pos") -> DataFrame:
    """Everything planning needs, one row per slot of an ordered playlist."""
    c = F.col
    detected = F.coalesce(F.nullif(c("detected_genre"), F.lit("")), F.lit("Unknown"))
    prepared = ordered.withColumns({
        "detected": detected, "detected_id": pairs.genre_id(detected), "profile": pairs.mix_profile(detected),
        "anchor": grid.phrase_anchor(c("first_phrase"), c("downbeat_confidence"), c("phrase_confidence"),
                                     c("first_downbeat")),
        "intro_end": sections.intro_end(c("sections")),
        "outro_start": sections.outro_start(c("sections"), c("duration")),
        "code": keys.key_to_camelot(c("key_note"), c("key_mode"))})
    prepared = prepared.withColumns({
        "phrase_bars": c("profile.phrase_unit"), "trans_min": c("profile.trans_min"),
        "trans_max": c("profile.trans_max"), "eq": c("profile.eq"), "technique": c("profile.technique")})
    return pairs.pair_features(prepared, keep=(order, *PLAN_COLUMNS))


def adjacent(rows: DataFrame, keys_: Sequence[str] = ("playlist_id",), order: str = "pos") -> DataFrame:
    """Rows of neighbours (k, k+1) of each playlist as ``a_`` and ``b_`` columns, plus ``a_pos``."""
    others = [name for name in rows.columns if name not in keys_]
    w = Window.partitionBy(*keys_).orderBy(order)
    paired = rows.withColumn("next", F.lead(F.struct(*others)).over(w)).where(F.col("next").isNotNull())
    return paired.select(*keys_, *[F.col(n).alias(f"a_{n}") for n in others],
                         *[F.col(f"next.{n}").alias(f"b_{n}") for n in others])


def with_tempo(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"bpm_diff": tempo.effective_bpm_diff(a("bpm"), b("bpm")),
                             "bpm_relation": tempo.bpm_relation(a("bpm"), b("bpm"))})


def transition_type(tol: float, strictness: int = 7, experimental: bool = True) -> Column:
    """One of eight mixing moves."""
    diff, rel, h = F.col("bpm_diff"), F.col("bpm_relation"), F.col("harmonic")
    free = keys.harmonic_score(a("num"), a("letter"), b("num"), b("letter"), F.lit(0.0), rel, float("inf"),
                               strictness, experimental)
    step = b("energy") - a("energy")

    def either(genres):
        return a("genre").isin(*genres) | b("genre").isin(*genres)

    blend = (F.when(either(R.EQ_SWAP_GENRES), "pro_eq_swap").when(either(R.BASS_SWAP_GENRES), "bass_swap")
             .otherwise("smooth_blend"))
    return (F.when((rel != "direct") & (diff <= tol), "halftime_switch")
            .when((diff > tol) & (free >= 50), "breakdown_bridge")
            .when(diff > tol, "cold_cut")
            .when((step > 25) & (h >= 70), "drop_cut")
            .when((step < -25) & (h >= 60), "echo_out")
            .when(step < -25, "breakdown_bridge")
            .when((h >= 85) & (F.abs(step) <= 15) & (diff <= 2.0) & either(R.MELODIC_GENRES), "filter_ride")
            .when(h >= 70, blend)
            .when((h >= 50) & (F.abs(step) > 15), "breakdown_bridge")
            .when(h >= 50, "filter_ride")
            .when(h >= 30, "echo_out")
            .otherwise("cold_cut"))


def risk_level(tol: float) -> Column:
    score, step = F.col("objective"), F.abs(b("energy") - a("energy"))
    return (F.when((F.col("bpm_diff") > tol) | (score < 50), "high")
            .when((score >= 80) & (step <= 20), "low")
            .when((step > 35) & (score < 70), "high")
            .when(score >= 70, "medium-low")
            .otherwise("medium"))


def transition_bars() -> Column:
    """Length of a blend in bars: profile mean, adjusted, a multiple of 4, at least 8."""
    diff, step = F.col("bpm_diff"), F.abs(a("energy") - b("energy"))
    base = F.floor((a("trans_min") + a("trans_max") + b("trans_min") + b("trans_max")) / 4.0)
    base = base + F.when(diff > 8, 8).when(diff > 4, 4).otherwise(0) + F.when(step > 25, 4).otherwise(0)
    base = F.when(F.col("bpm_relation") != "direct", F.least(base, F.lit(16))).otherwise(base)
    base = base - F.when((diff < 1.0) & (step < 10), 4).otherwise(0)
    return F.greatest(F.lit(8), (F.rint(base / 4.0) * 4.0).cast("int"))


def clamp_overlap(overlap: Column, mix_out: Column, mix_in: Column) -> Column:
    """Overlap within the audio left in A and B, A's outro (in whole bars) and 64 seconds."""
    bar = tempo.seconds_per_bar(a("bpm"))
    headroom = a("outro_start") - mix_out
    limited = (F.size(a("sections")) > 0) & (a("duration") > 0) & (a("bpm") > 0) \
        & (a("outro_start") < a("duration")) & (headroom >= bar * float(R.MIN_TRANSITION_BARS))
    # least() skips NULL, so a limit that does not apply is NULL
    return F.greatest(F.lit(0.0), F.least(
        overlap, F.lit(R.MAX_OVERLAP_SECONDS),
        F.when(a("duration") > 0, F.greatest(F.lit(0.0), a("duration") - mix_out)),
        F.when(b("duration") > 0, F.greatest(F.lit(0.0), b("duration") - mix_in)),
        F.when(limited, F.floor(headroom / bar) * bar)))


# ------------------------------------------------------------------- advice
def _fmt(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def tempo_advice() -> Column:
    bpm_a, bpm_b, gap = a("bpm"), b("bpm"), F.col("bpm_diff")
    diff = bpm_b - bpm_a
    pct = F.abs(diff / bpm_a) * 100.0
    way = F.when(diff < 0, "runter").otherwise("rauf")
    octave = F.col("bpm_relation") != "direct"
    return (F.when((bpm_a <= 0) | (bpm_b <= 0), "")
            .when(octave & (gap < 0.3), _fmt(
                "%.1f → %.1f — Half/Double-Time kompatibel, Downbeat exakt auf Phrase setzen", bpm_a, bpm_b))
            .when(octave, _fmt("%.1f → %.1f — Half/Double-Time (eff. %.1f BPM, ~%.1f%% Fein-Pitch), "
                               "Downbeat auf Phrase setzen", bpm_a, bpm_b, gap, gap / bpm_a * 100.0))
            .when(gap < 0.3, _fmt("%.1f → %.1f — Match, kein Pitching noetig", bpm_a, bpm_b))
            .when(gap <= 2.0, _fmt("%.1f → %.1f (Diff %+.1f) — Pitch-Fader %.1f%% %s", bpm_a, bpm_b, diff, pct, way))
            .when(gap <= 5.0, _fmt("%.1f → %.1f (Diff %+.1f) — %.1f%% %s pitchen, frueh beginnen",
                                   bpm_a, bpm_b, diff, pct, way))
            .when(gap <= 10.0, _fmt("%.1f → %.1f (Diff %+.1f) — Tempo im Intro angleichen", bpm_a, bpm_b, diff))
            .otherwise(_fmt("%.1f → %.1f (Diff %+.1f) — Breakdown-Bridge oder Cold Cut", bpm_a, bpm_b, diff)))


def key_advice() -> Column:
    code_a, code_b, num_a, num_b = a("code"), b("code"), a("num"), b("num")
    steps = keys.wheel_distance(num_a, num_b)
    same = a("letter") == b("letter")
    way = F.when(F.pmod(num_b - num_a, F.lit(12)) <= 6, "+").otherwise("-")
    text_ = (F.when(code_a == code_b, "Gleiche Tonart, perfekt harmonisch")
             .when(steps == 0, "Dur/Moll-Wechsel, smooth energy shift")
             .when((steps == 1) & same, _fmt("1 Schritt (%s), harmonisch blendbar", way))
             .when(steps == 1, _fmt("1 Schritt (%s) + Modus-Wechsel, energy mix", way))
             .when(steps == 2, "Distanz 2, Filter-Ride empfohlen")
             .when(steps == 3, "Distanz 3, dezenter Clash — kein Melodie-Overlap")
             .when(steps.isin(4, 5) & same,
                   _fmt("Distanz %d, experimentelle Technik (+4/+7) — Energie-/Mood-Shift, kurz blenden", steps))
             .otherwise(_fmt("Distanz %d, Key-Clash — nur Bass Swap", steps)))
    return F.when((num_a == 0) | (num_b == 0), "").otherwise(F.concat(code_a, F.lit(" → "), code_b, F.lit(" — "), text_))


def energy_advice() -> Column:
    e_a, e_b = a("energy").cast("double"), b("energy").cast("double")
    diff = e_b - e_a
    text_ = (F.when(F.abs(diff) <= 5, "stabil, normaler Crossfade")
             .when(diff > 25, "Push, Drop-Cut oder Build-Einstieg")
             .when(diff > 10, "Aufbau, im Build einmixen")
             .when(diff < -25, "Drop, Breakdown-Uebergang planen")
             .when(diff < -10, "Abfall, im Outro ueberblenden")
             .otherwise("leichter Shift, smooth moeglich"))
    return F.when((e_a <= 0) & (e_b <= 0), "").otherwise(
        F.concat(_fmt("%.0f → %.0f (Diff %+.0f) — ", e_a, e_b, diff), text_))


def gain_advice() -> Column:
    l_a, l_b = a("lufs"), b("lufs")
    diff = l_a - l_b
    way = F.when(diff > 0, "rauf").otherwise("runter")
    hint = F.when(F.abs(diff) >= R.GAIN_DIFF_WARN_DB, " (deutlich — vor dem Mix angleichen!)").otherwise("")
    return (F.when((l_a >= 0) | (l_b >= 0), "")
            .when(F.abs(diff) < R.GAIN_DIFF_SHOW_DB,
                  _fmt("%.1f → %.1f LUFS — Pegel passt, kein Gain noetig", l_a, l_b))
            .otherwise(_fmt("%.1f → %.1f LUFS — Track B Gain %.1f dB %s%s", l_a, l_b, F.abs(diff), way, hint)))


def rhythm_advice() -> Column:
    p_a, p_b = a("percussive_ratio"), b("percussive_ratio")
    return (F.when((p_a > 0.7) & (p_b > 0.7),
                   "Beide Tracks sehr perkussiv - Vorsicht vor Rhythmus-Salat, kurzen Uebergang waehlen")
            .when(p_b < 0.3, "Incoming Track sehr tonal - ideal fuer lange Filter-Blends")
            .otherwise(""))


# fixed values: (outgoing label, incoming label) -> note
STRUCTURE_NOTES = {
    "outro>intro": "Ideal: Outro in Intro mixen",
    "outro>build": "Gut: Outro in aktiven Teil -- Energie anpassen",
    "outro>main": "Gut: Outro in aktiven Teil -- Energie anpassen",
    "breakdown>intro": "Smooth: Breakdown in Intro -- sanft halten",
    "breakdown>build": "Gut: Breakdown in Build/Drop -- Energie-Steigerung",
    "breakdown>drop": "Gut: Breakdown in Build/Drop -- Energie-Steigerung",
    "drop>intro": "Riskant: Drop in Intro -- Energie-Einbruch",
    "drop>drop": "Mutig: Drop-zu-Drop -- praezises Timing noetig",
    "main>intro": "Standard: Hauptteil in Intro blenden",
    "build>intro": "OK: Build in Intro -- Energie passt",
}


def structure_note(outgoing: Column, incoming: Column) -> Column:
    pair = F.concat(outgoing, F.lit(">"), incoming)
    return F.when((outgoing == "unknown") | (incoming == "unknown"), "").otherwise(F.coalesce(
        R.lookup(STRUCTURE_NOTES, pair), F.concat(F.lit("Struktur: "), outgoing, F.lit(" -> "), incoming)))


def cross_genre(what: int) -> Column:
    """Technique (0) or EQ (1) text for two different genres; the profile of B if equal."""
    table = {}
    for (x, y), texts in R.CROSS_GENRE.items():
        table[f"{x}|{y}"] = table[f"{y}|{x}"] = texts[what]
    affinity = F.col("detected_affinity")
    fallback = (
        F.when(affinity < 0.3, "Schwierige Kombination -- Breakdown-Bridge oder Cold Cut, kein langer Blend")
        .when(affinity < 0.6, "Vorsichtiger Uebergang -- kurzer Blend am Phrasen-Ende, Energie angleichen")
        .otherwise("Standard cross-genre blend - match energy levels")) if what == 0 else (
        F.when(affinity < 0.3, "Bass von Track A komplett cutten BEVOR Track B einsetzt -- keine Ueberlappung")
        .otherwise("Standard bass swap at phrase boundary"))
    crossing = (a("detected") != b("detected")) & (a("detected") != "Unknown") & (b("detected") != "Unknown")
    return F.when(crossing, F.coalesce(R.lookup(table, F.concat_ws("|", a("detected"), b("detected"))), fallback)) \
        .otherwise(b("technique") if what == 0 else b("eq"))


def risk_notes(mix_out: Column, mix_in: Column) -> Column:
    """Warnings in fixed order, without NULLs."""
    gap, rel = F.col("bpm_diff"), F.col("bpm_relation")
    step = F.abs(a("energy") - b("energy"))
    affinity = F.col("detected_affinity")
    wheel = keys.wheel_distance(a("num"), b("num"))
    bass_a = F.coalesce(sections.section_covering(a("sections"), mix_out)["avg_bass"], a("avg_bass"))
    bass_b = F.coalesce(sections.section_covering(b("sections"), mix_in)["avg_bass"], b("avg_bass"))
    louder = F.abs(a("lufs") - b("lufs"))

    def unsure(side: str) -> Column:
        conf = F.col(f"{side}_key_confidence")
        return F.when((conf > 0) & (conf < R.KEY_CONFIDENCE_UNCERTAIN), _fmt(
            f"Key von Track {side.upper()} unsicher erkannt (%.0f%%) -- Harmonik-Empfehlung pruefen, im Zweifel Bass Swap",
            conf * 100.0))

    return F.array_compact(F.array(
        F.when(rel != "direct", F.concat(
            _fmt("Half/Double-Time (%.1f↔%.1f) -- exakt auf Phrase/Downbeat cutten", a("bpm"), b("bpm")),
            F.when(gap <= 2.0, "").otherwise(_fmt(", eff. %.1f BPM angleichen", gap))))
        .when(gap > 8, _fmt("Grosser BPM-Sprung (%.1f) -- Pitch-Anpassung noetig", gap))
        .when(gap > 4, _fmt("BPM-Differenz %.1f -- langsam angleichen", gap)),
        F.when(step > 30, _fmt("Grosser Energie-Sprung (%d) -- EQ-Uebergang nutzen", step))
        .when(step > 15, _fmt("Deutlicher Energie-Shift (%d) -- Transition aufbauen", step)),
        F.when(affinity < 0.4, "Geringe Genre-Kompatibilitaet -- Bridge-Track empfohlen")
        .when(affinity < 0.6, "Maessige Genre-Kompatibilitaet -- im Breakdown/Intro mixen"),
        F.when((a("num") > 0) & (b("num") > 0) & (wheel > 2),
               _fmt("Tonart-Clash (Camelot-Distanz: %d) -- EQ/Filter nutzen", wheel)),
        F.when(bass_b > 80, "Incoming Track hat sehr dominanten Bass -- Bass-Swap am Phrasen-Ende empfohlen"),
        unsure("a"), unsure("b"),
        F.when((a("lufs") < 0) & (b("lufs") < 0) & (louder >= R.GAIN_DIFF_WARN_DB), _fmt(
            "Lautheits-Sprung %.1f dB (%.1f vs %.1f LUFS) -- Gain vor dem Mix angleichen", louder, a("lufs"), b("lufs"))),
        F.when(a("vocal") & b("vocal"), "Beide Tracks vocal-lastig -- Vocal-Ueberlappung vermeiden "
                                        "(Uebergang ueber instrumentale Passagen legen)"),
        # the collision at the pair's own points is re-judged last and so closes the list
        F.when((bass_a > 60) & (bass_b > 60), _fmt(
            "Bass-Kollision droht! (A:%.0f%%, B:%.0f%%) -- Bass von Track A hart cutten", bass_a, bass_b))))


def description(tol: float) -> Column:
    """Plain-language summary of a transition."""
    h, score = F.col("harmonic"), F.col("objective")
    diff, step = b("bpm") - a("bpm"), b("energy") - a("energy")
    codes = F.when((a("code") != "") & (b("code") != ""), _fmt(" (%s->%s)", a("code"), b("code"))).otherwise("")
    planned = F.col("has_advice")
    key_text = (F.when(h >= 90, F.concat(F.lit("Perfekte Tonart"), codes))
                .when(planned & (h >= 70), F.concat(F.lit("Harmonisch"), codes))
                .when(planned, F.lit(None))
                .when(h >= 70, F.concat(F.lit("Harmonisch kompatibel"), codes))
                .when(h >= 50, F.concat(F.lit("Tonart geht, kurz mixen"), codes))
                .otherwise(F.concat(F.lit("Tonart-Clash"), codes, F.lit(" -- EQ-Filter nutzen"))))
    tempo_text = (F.when(planned | (F.abs(diff) < 0.5), F.lit(None))
                  .when(F.abs(diff) <= tol, _fmt("BPM-Anpassung %+.1f -- Pitch Fader korrigieren", diff))
                  .otherwise(_fmt("BPM-Sprung %+.1f -- harter Cut oder Breakdown nutzen", diff)))
    energy_text = (F.when(planned, F.lit(None))
                   .when(step > 25, "Grosser Energie-Push [++] -- Drop-Einstieg ideal")
                   .when(step > 12, "Energie steigt [+] -- im Build reinmixen")
                   .when(step < -25, "Starker Energie-Drop [--] -- Breakdown-Uebergang planen")
                   .when(step < -12, "Energie faellt [-] -- im Outro sanft ueberblenden")
                   .otherwise("Energie stabil [=] -- nahtlose Ueberblendung moeglich"))
    verdict = (F.when(score >= 85, "Sichere Transition -- laeuft fast von allein")
               .when(score >= 70, "Solide Transition -- mit Aufmerksamkeit sauber mixbar")
               .when(score >= 55, "Machbar, aber anspruchsvoll -- Timing und EQ muessen stimmen")
               .otherwise("Riskante Transition -- nur fuer erfahrene DJs oder mit langem Breakdown"))
    return F.concat_ws("; ", key_text, tempo_text, energy_text, verdict)


def recommend(ordered: DataFrame, tol: float = 3.0, *, overlap: float = 12.0, strictness: int = 7,
              experimental: bool = True, order: str = "pos", weights: DataFrame | None = None) -> DataFrame:
    """Full plan and advice for every neighbour pair of the ordered playlists.

    ``ordered`` has the track columns plus ``pos``.  One window per playlist
    pairs neighbours; everything else is a projection.  ``weights`` are score weights per genre.
    """
    rows = with_tempo(adjacent(plan_features(ordered, order), order=order))
    rows = scoring.score_pairs(rows, tol, strictness=strictness, experimental=experimental, weights=weights)
    wanted = float(max(4.0, min(64.0, overlap)))
    effective = F.when((a("duration") > 0) & (b("duration") > 0), F.least(
        F.lit(wanted), F.greatest(F.lit(6.0), F.least(a("duration"), b("duration")) * 0.2))).otherwise(wanted)
    rows = mixpoints.paired_mix_points(rows).withColumns({
        "has_advice": (a("detected") != "Unknown") & (b("detected") != "Unknown"),
        "detected_affinity": pairs.genre_affinity(a("detected_id"), b("detected_id")),
        "effective_overlap": effective, "transition_bars": transition_bars()})
    _, own_out = sections.resolve_mix_points(a("mix_in_point"), a("mix_out_point"), a("duration"),
                                             F.col("effective_overlap"))
    own_in, _ = sections.resolve_mix_points(b("mix_in_point"), b("mix_out_point"), b("duration"),
                                            F.col("effective_overlap"))
    planned = F.col("has_advice")
    rows = rows.withColumns({"plan_out": F.when(planned, F.col("mix_out_a")).otherwise(own_out),
                             "plan_in": F.when(planned, F.col("mix_in_b")).otherwise(own_in)})
    bars_long = tempo.seconds_per_bar(a("bpm")) * F.col("transition_bars")
    blend = F.when(planned & (a("bpm") > 0), bars_long).otherwise(F.col("effective_overlap"))
    outgoing = sections.label_at(a("sections"), F.col("plan_out"), "out")
    incoming = sections.label_at(b("sections"), F.col("plan_in"), "in")
    rows = rows.withColumns({
        "plan_overlap": clamp_overlap(blend, F.col("plan_out"), F.col("plan_in")),
        "transition_type": transition_type(tol, strictness, experimental), "risk_level": risk_level(tol),
        "outgoing_section": outgoing, "incoming_section": incoming})
    rows = rows.withColumns({
        "fade_out_end": F.least(F.col("plan_out") + F.col("plan_overlap"),
                                F.when(a("duration") > 0, a("duration"))),
        "tempo_ratio": F.when((a("bpm") > 0) & (b("bpm") > 0), b("bpm") / a("bpm")).otherwise(1.0),
        "dj": F.when(planned, F.struct(
            F.concat_ws(" -> ", a("detected"), b("detected")).alias("genre_pair"),
            cross_genre(0).alias("technique"), cross_genre(1).alias("eq"),
            structure_note(F.col("outgoing_section"), F.col("incoming_section")).alias("structure_note"),
            tempo_advice().alias("tempo"), key_advice().alias("key"), energy_advice().alias("energy"),
            gain_advice().alias("gain"), rhythm_advice().alias("rhythm"))),
        "risk_notes": F.when(planned, risk_notes(F.col("plan_out"), F.col("plan_in"))),
        "description": description(tol)})
    return rows.select(
        "playlist_id", F.col(f"a_{order}").alias("idx"), a("track_id").alias("from_track"), b("track_id").alias("to_track"),
        F.col("plan_out").alias("mix_out_a"), F.col("plan_in").alias("mix_in_b"),
        F.col("plan_overlap").alias("overlap"), "fade_out_end", "transition_type", "tempo_ratio",
        F.bround(b("bpm") - a("bpm"), 2).alias("bpm_delta"), (b("energy") - a("energy")).alias("energy_delta"),
        F.col("objective").alias("score"), "risk_level", "transition_bars", "outgoing_section", "incoming_section",
        "dj", "risk_notes", "description", notes().alias("notes"),
        a("bpm").alias("bpm_a"), b("bpm").alias("bpm_b"), a("lufs").alias("lufs_a"), b("lufs").alias("lufs_b"),
        a("duration").alias("duration_a"), b("duration").alias("duration_b"),
        a("downbeat_confidence").alias("downbeat_confidence_a"), b("downbeat_confidence").alias("downbeat_confidence_b"),
        a("file_path").alias("path_a"), b("file_path").alias("path_b"))


def notes() -> Column:
    """The advice as one line."""
    dj = F.col("dj")

    def tagged(label: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(label), value))

    collision = "Bass-Kollision droht!"
    warnings = F.coalesce(F.col("risk_notes"), F.array().cast("array<string>"))
    early = F.transform(F.filter(warnings, lambda n: ~n.startswith(collision)), lambda n: F.concat(F.lit("! "), n))
    late = F.transform(F.filter(warnings, lambda n: n.startswith(collision)), lambda n: F.concat(F.lit("! "), n))
    head = F.array_compact(F.array(
        tagged("Mix: ", dj["technique"]), tagged("EQ: ", dj["eq"]),
        F.when(F.col("has_advice"), F.format_string("Transition: %d bars", F.col("transition_bars"))),
        F.nullif(dj["structure_note"], F.lit("")),
        F.when(F.col("has_advice"), F.concat(F.lit("["), dj["genre_pair"], F.lit("]")))))
    tail = F.array_compact(F.array(
        tagged("BPM: ", dj["tempo"]), tagged("Key: ", dj["key"]), tagged("Energy: ", dj["energy"]),
        tagged("Gain: ", dj["gain"]), tagged("Rhythmus: ", dj["rhythm"])))
    return F.concat_ws("; ", head, early, tail, late, F.col("description"))


def effective_mix_points(rows: DataFrame) -> DataFrame:
    """Plan values, else pair values, else track values (nullable ``plan_*``, ``pair_*``, ``track_*``)."""
    c = F.col
    return rows.withColumns({
        "mix_out": F.coalesce("plan_out", F.when(c("pair_out") >= 0, c("pair_out")),
                              F.greatest(F.lit(0.0), c("track_out"))),
        "mix_in": F.coalesce("plan_in", F.when(c("pair_in") >= 0, c("pair_in")), F.greatest(F.lit(0.0), c("track_in"))),
        "crossfade": F.coalesce("plan_overlap", F.when(c("pair_overlap") > 0, c("pair_overlap")),
                                F.nullif(c("track_overlap"), F.lit(0.0)), F.lit(16.0))})


def clip_requests(plans: DataFrame, reliable: float = 0.30, post_roll: float = 8.0) -> DataFrame:
    """One request row per planned transition: timing, reliability and tempo stretch."""
    c = F.col
    bpm_a = F.when(c("bpm_a") != 0, c("bpm_a")).otherwise(120.0)
    bpm_b = F.when(c("bpm_b") != 0, c("bpm_b")).otherwise(120.0)
    near = bpm_a * 0.04
    target = (F.when(F.abs(bpm_b * 2.0 - bpm_a) < near, bpm_b * 2.0)
              .when(F.abs(bpm_b / 2.0 - bpm_a) < near, bpm_b / 2.0).otherwise(bpm_b))
    stretched = (bpm_a > 0) & (bpm_b > 0) & (F.abs(bpm_a - bpm_b) > 0.05)
    rate = F.when(stretched, bpm_a / target).otherwise(1.0)
    return plans.select(
        "playlist_id", "idx", "path_a", "path_b", c("mix_out_a").alias("mix_out_sec"), c("mix_in_b").alias("mix_in_sec"),
        F.least(F.greatest(F.lit(0.0), c("overlap")), F.lit(R.MAX_OVERLAP_SECONDS)).alias("crossfade_sec"),
        "transition_type",
        (c("downbeat_confidence_a") >= reliable).alias("downbeat_reliable_a"),
        (c("downbeat_confidence_b") >= reliable).alias("downbeat_reliable_b"),
        (c("downbeat_confidence_a") == 1.0).alias("bar_phase_reliable_a"),
        (c("downbeat_confidence_b") == 1.0).alias("bar_phase_reliable_b"),
        rate.alias("rate_wanted"), F.least(F.lit(1.08), F.greatest(F.lit(0.92), rate)).alias("rate"),
        (F.abs(rate - F.least(F.lit(1.08), F.greatest(F.lit(0.92), rate))) <= 1e-6).alias("in_sync"),
        (c("duration_a") - c("mix_out_a")).alias("reserve_a"),
        (c("duration_b") - c("mix_in_b") - post_roll).alias("reserve_b"))
