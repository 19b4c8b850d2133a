"""Named bands of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: lower bound -> name
TRANSITION_BANDS = ((0.85, "Sehr gut"), (0.70, "Gut"), (0.55, "Passend"), (0.40, "Schwach"))
TEXTURE_BANDS = ((0.85, "Klang: Identisch"), (0.70, "Klang: Aehnlich"), (0.55, "Klang: Harmonisch"),
                 (0.40, "Klang: Passend"), (0.25, "Klang: Kontrast"))
SEVEN_STEPS = ((0.90, "#0f5223"), (0.80, "#248a3d"), (0.70, "#5cd65c"), (0.55, "#e6c300"),
               (0.40, "#ff8c00"), (0.25, "#ff4500"))
LAMP_BANDS = ((0.8, "success"), (0.6, "warning"))


def _unit(value: Column) -> Column:
    """Score on 0..1; values above 1 are percentages; NaN counts as 0."""
    value = F.when(F.isnan(value), F.lit(0.0)).otherwise(value)
    return F.when(value > 1.0, value / 100.0).otherwise(value)


def _ladder(value: Column, bands, lowest: str) -> Column:
    out = F.when(value >= bands[0][0], bands[0][1])
    for bound, name in bands[1:]:
        out = out.when(value >= bound, name)
    return out.otherwise(lowest)


def transition_label(score: Column) -> Column:
    return _ladder(_unit(score), TRANSITION_BANDS, "Riskant")


def lamp(score: Column) -> Column:
    return _ladder(_unit(score), LAMP_BANDS, "danger")


def seven_step(score: Column) -> Column:
    return _ladder(_unit(score), SEVEN_STEPS, "#ff3b30")


def texture_label(value: Column) -> Column:
    return _ladder(F.when(F.isnan(value), F.lit(0.0)).otherwise(value), TEXTURE_BANDS, "Klang: Discord")


def edge_class(score: Column) -> Column:
    return (F.when(score <= 0.001, "danger").when(score >= 0.6, "success").otherwise("warning"))
