"""Clip times: clock strings, the half-second grid and small rounding helpers.

Rounding is half-even throughout, hence ``bround`` and never ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hms_to_s(text: Column, missing: str | None = "0:0:0") -> Column:
    """``H:M:S`` to whole seconds; ``missing`` replaces an empty text, or None keeps NULL."""
    empty = text.isNull() | (F.trim(text) == "")
    text = F.when(empty, F.lit(missing)).otherwise(text)
    part = F.split(F.trim(text), ":")
    number = [F.try_element_at(part, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    return number[0] * 3600 + number[1] * 60 + number[2]


def clock_to_s(text: Column) -> Column:
    """Like ``hms_to_s`` for texts with one to three parts: missing leading parts are zero."""
    part = F.split(F.trim(text), ":")
    padded = F.concat(F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 3 - F.size(part))), part)
    return (
        F.element_at(padded, 1).try_cast("int") * 3600
        + F.element_at(padded, 2).try_cast("int") * 60
        + F.element_at(padded, 3).try_cast("int")
    )


def hms(seconds: Column) -> Column:
    """Seconds, rounded to whole ones, as ``HH:MM:SS``."""
    s = F.bround(seconds).cast("long")
    return F.format_string(
        "%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    )


def tick(t: Column) -> Column:
    """Integer position on the half-second label grid, safe as a join key."""
    return F.bround(t * 2).cast("int")


def snap(t: Column) -> Column:
    return F.bround(t * 2) / 2


def sigmoid(z: Column, digits: int | None = 3) -> Column:
    p = 1 / (1 + F.exp(-z))
    return p if digits is None else F.bround(p, digits)


def micros(ts: Column, dtype: str) -> Column:
    """Microseconds since the epoch for both timestamp types."""
    if dtype == "timestamp_ntz":
        return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return F.unix_micros(ts)
