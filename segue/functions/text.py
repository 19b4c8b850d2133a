"""Names, labels and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segue import refdata as R

# fixed values: label patterns and aliases found in file names
DASHED_NAME = r"^(?:\d+[\s.-]*)?([^-]+?)\s*-\s*(.+)$"
UNDERSCORED_NAME = r"^(?:\d+[\s._-]*)?([^_]+?)_(.+)$"
SHOP_LABELS = r"_(\d{2,3})__\(([^)]+)\)_([A-G][#b]?)_(Minor|Major)_"
NAME_BPM = r"_(\d{2,3})__"
GENRE_ALIASES = (
    "Psytrance", "Psy-Trance", "Psy Trance", "Psy",
    "Melodic Techno", "Melodic House & Techno", "Melodic House", "Melodic_House_&_Techno",
    "Techno",
    "Trance",
    "House",
    "DnB", "Drum & Bass", "Drum and Bass",
    "Progressive", "Progressive House",
)
ALIASES_OF = {
    "Psytrance": ("Psytrance", "Psy-Trance", "Psy Trance", "Psy"),
    "Melodic Techno": ("Melodic Techno", "Melodic House & Techno", "Melodic House", "Melodic_House_&_Techno"),
    "Techno": ("Techno",),
    "Trance": ("Trance",),
    "House": ("House",),
    "Drum & Bass": ("DnB", "Drum & Bass", "Drum and Bass"),
    "Progressive": ("Progressive", "Progressive House"),
}
VERSION_WORDS = ("mix", "remix", "edit", "original", "rework")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*\z", "")


def file_name_parts(path: Column) -> tuple[Column, Column]:
    """(artist, title) read from 'Artist - Title' or 'Artist_Title'; NULL if neither fits."""
    name = stem(path)
    pairs = []
    for pattern in (DASHED_NAME, UNDERSCORED_NAME):
        artist = F.trim(F.regexp_extract(name, pattern, 1))
        title = F.trim(F.regexp_extract(name, pattern, 2))
        fits = (F.length(artist).between(1, 100)) & (F.length(title).between(1, 200))
        pairs.append((fits, artist, title))
    (fit1, artist1, title1), (fit2, artist2, title2) = pairs
    return (F.when(fit1, artist1).when(fit2, artist2), F.when(fit1, title1).when(fit2, title2))


def artist_title_genre(path: Column, artist: Column, title: Column, genre: Column) -> tuple[Column, Column, Column]:
    """Tag value, else file name, else 'Unknown' (title: the file name itself)."""
    def known(value):
        return F.nullif(F.nullif(value, F.lit("")), F.lit("Unknown"))

    name_artist, name_title = file_name_parts(path)
    return (F.coalesce(known(artist), name_artist, F.lit("Unknown")),
            F.coalesce(known(title), name_title, basename(path)),
            F.coalesce(F.nullif(genre, F.lit("")), F.lit("Unknown")))


def shop_labels(path: Column) -> tuple[Column, Column, Column, Column]:
    """(bpm, genre, note, mode) encoded in a shop file name; NULL without the pattern."""
    name = basename(path)
    found = F.regexp_extract(name, SHOP_LABELS, 1) != ""
    note = F.regexp_extract(name, SHOP_LABELS, 3)
    flats = {f: s for f, s in R.FLAT_TO_SHARP.items() if f not in ("Cb", "Fb")}
    return (F.when(found, F.regexp_extract(name, SHOP_LABELS, 1).try_cast("double")),
            F.when(found, F.translate(F.regexp_extract(name, SHOP_LABELS, 2), "_", " ")),
            F.when(found, F.coalesce(R.lookup(flats, note), note)),
            F.when(found, F.regexp_extract(name, SHOP_LABELS, 4)))


def bpm_from_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(basename(path), NAME_BPM, 1), F.lit("")).try_cast("int")


def genre_from_name(path: Column) -> Column:
    """Genre written in a file name: known alias, shop label, else the first bracket that
    is no version note; '?' if there is none."""
    name = basename(path)
    lowered = F.lower(name)
    alias = F.coalesce(*[
        F.when(F.greatest(*[F.contains(lowered, F.lit(f"{o}{a.lower()}{c}")) for o in "(_" for c in ")_"]), a)
        for a in GENRE_ALIASES])
    shop = F.nullif(F.regexp_extract(name, r"__\(([^)]+)\)__", 1), F.lit(""))
    brackets = F.filter(
        F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), 1),
        lambda g: ~F.greatest(*[F.contains(F.lower(g), F.lit(w)) for w in VERSION_WORDS]))
    return F.coalesce(alias, shop, F.get(brackets, F.lit(0)), F.lit("?"))


def genre_label_matches(name_genre: Column, detected: Column) -> Column:
    """Does a detected genre fit the genre written in the file name."""
    d = F.lower(detected)
    f = F.translate(F.lower(name_genre), "_-", "  ")
    by_alias = F.lit(False)
    for genre, aliases in ALIASES_OF.items():
        hits = [F.contains(f, F.lit(a.lower().replace("-", " "))) |
                F.contains(F.lit(a.lower().replace("-", " ")), f) for a in aliases]
        hit = hits[0]
        for h in hits[1:]:
            hit = hit | h
        by_alias = by_alias | ((detected == genre) & hit)
    fits = (by_alias | F.contains(f, d) | F.contains(d, f)
            | (F.contains(f, F.lit("psy")) & F.contains(d, F.lit("psy"))))
    usable = detected.isNotNull() & ~detected.isin("", "n/a") & (name_genre != "?")
    return F.coalesce(usable & fits, F.lit(False))


def match_genre_tag(tag: Column) -> Column:
    """Canonical genre of a tag: exact spelling, else the longest known spelling in it."""
    cleaned = F.lower(F.trim(tag))
    exact = R.lookup(dict(R.tag_rows()), cleaned)
    longest_first = sorted(R.tag_rows(), key=lambda row: -len(row[0]))
    partial = F.coalesce(*[F.when(F.contains(cleaned, F.lit(t)), g) for t, g in longest_first])
    return F.when(F.length(cleaned) > 0, F.coalesce(exact, partial))


def resolved_genre(detected: Column, tag: Column) -> Column:
    def known(value):
        return F.nullif(F.nullif(value, F.lit("")), F.lit("Unknown"))

    return F.coalesce(known(detected), known(tag), F.lit("Unknown"))


def minutes_seconds(seconds: Column) -> Column:
    """m:ss with a leading minus for negative times."""
    s = F.abs(seconds)
    return F.concat(F.when(seconds < 0, "-").otherwise(""),
                    F.floor(s / 60.0).cast("string"), F.lit(":"),
                    F.lpad(F.floor(s % 60.0).cast("string"), 2, "0"))


def mix_point_text(seconds: Column, bars: Column) -> Column:
    return F.when(seconds < 0, "--:-- (- bars)").otherwise(F.concat(
        F.format_string("%02d", F.floor(seconds / 60.0)), F.lit(":"),
        F.format_string("%02d", F.floor(seconds % 60.0)), F.lit(" ("), bars.cast("string"), F.lit(" bars)")))
