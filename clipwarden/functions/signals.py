"""Predicates and classes over per-sample confidences and frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SMOKE_FLOOR = 0.3  # fixed value: smoke or weak fire below this never supports a hit


def fire_only(fire: Column, threshold: float) -> Column:
    return fire >= threshold


def combined(fire: Column, smoke: Column, fire_th: float, smoke_th: float) -> Column:
    """Fire alone, or weaker fire together with smoke."""
    return (fire >= fire_th) | ((fire >= SMOKE_FLOOR) & (smoke >= smoke_th))


def either(fire: Column, smoke: Column, threshold: float) -> Column:
    return (fire >= threshold) | (smoke >= threshold)


def smoke_ok(fire: Column, smoke: Column, fire_th: float, smoke_th: float) -> Column:
    return (fire >= fire_th) | (smoke >= smoke_th)


def smoke_gated(fire: Column, smoke: Column, fire_th: float, smoke_th: float, use_smoke: bool) -> Column:
    return smoke_ok(fire, smoke, fire_th, smoke_th) if use_smoke else fire >= fire_th


def smoke_rise(fire: Column, smoke: Column, base: Column, fire_th: float, rise: float | None) -> Column:
    """Fire by level, smoke only by its rise over the clip's own baseline."""
    if rise is None:
        return fire >= fire_th
    return (fire >= fire_th) | ((smoke >= base + rise) & (smoke >= SMOKE_FLOOR))


def daylight(brightness: Column) -> Column:
    # fixed values: mean grey level limits
    return F.when(brightness < 60, "night").when(brightness <= 110, "dusk").otherwise("day")


def is_dark(brightness: Column) -> Column:
    return brightness < 65


def snow_or_fog(white: Column, lower: Column, upper: Column, contrast: Column) -> Column:
    """Ground whiter than sky is snow; flat and even haze is fog; else NULL."""
    snow = (lower > upper + 0.12) & (lower > 0.3)
    fog = (contrast < 32) & (white > 0.35) & (F.abs(lower - upper) < 0.2)
    return F.when(white >= 0.18, F.when(snow, "snow").when(fog, "fog"))


def snow_score(bright: Column, saturation: Column, value: Column) -> Column:
    floor0 = lambda c: F.greatest(F.lit(0.0), c)
    return bright * 2.0 + floor0((140 - saturation) / 140) + floor0((value - 120) / 135)


def fog_score(spread: Column, saturation: Column, value: Column) -> Column:
    floor0 = lambda c: F.greatest(F.lit(0.0), c)
    return floor0((70 - spread) / 70) * 2.0 + floor0((110 - saturation) / 110) + floor0((value - 100) / 155)


def scene_candidate(bright: Column, saturation: Column, value: Column, spread: Column) -> Column:
    """Class and score of the second rule set (``struct<kind, score>``)."""
    snow, fog = snow_score(bright, saturation, value), fog_score(spread, saturation, value)
    kind = lambda name, score: F.struct(F.lit(name).alias("kind"), score.alias("score"))
    return (
        F.when((bright >= 0.18) & (saturation <= 90), kind("snow", snow))
        .when((spread <= 42) & (saturation <= 80) & (value >= 110), kind("fog", fog))
        .otherwise(kind("plain", F.greatest(snow, fog)))
    )


# fixed values: what the condition fields say for "yes"
_YES_WORD = r"(?i)^(yes|y|true|1)$"
_YES_GRADE = r"(?i)(light|heavy|weak|strong)"
CONDITION_FILTERS = ("night", "day", "snow", "rain", "fog", "hard")


def _yes(v: Column) -> Column:
    v = F.coalesce(v, F.lit(""))
    return v.rlike(_YES_WORD) | v.rlike(_YES_GRADE)


def condition_filter(name: str, tod: Column, snow: Column, rain: Column, fog: Column) -> Column:
    """True where a clip's recording conditions pass the named filter."""
    said = lambda word: F.coalesce(tod, F.lit("")).rlike(f"(?i){word}")
    return {
        "night": said("night"),
        "day": said("day"),
        "snow": _yes(snow),
        "rain": _yes(rain),
        "fog": _yes(fog),
        "hard": said("night") | _yes(snow) | _yes(rain) | _yes(fog),
    }[name]


def uncertainty(peak: Column, unlabelled: Column) -> Column:
    """Highest near 0.35, with a bonus for clips nobody has labelled."""
    return 1 - F.abs(peak - 0.35) / 0.35 + F.when(unlabelled, 0.5).otherwise(0.0)


def worth_labelling(peak: Column, unlabelled: Column) -> Column:
    return peak.between(0.15, 0.55) | (unlabelled & (peak >= 0.1))


def route(max_conf: Column, keep: float = 0.35) -> Column:
    """Pseudo-label routing of a frame by its best detection."""
    return F.when(max_conf >= keep, "label").when(max_conf.isNull(), "negative").otherwise("ambiguous")
