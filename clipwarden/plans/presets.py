"""Named rule presets and parameter grids.

All numbers in this file are fixed values: results are only comparable when the
same grids are searched in the same order.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple


class FireRule(NamedTuple):
    """One point of a fire grid; fields a kind does not use stay None."""

    kind: str
    fire: float
    smoke: float | None
    rise: float | None
    win: int
    hits: int


class EntryRule(NamedTuple):
    conf: float
    corners: int
    hold: int
    settle: float


class DwellRule(NamedTuple):
    conf: float
    corners: int
    dwell: float
    delay: float
    settle: float
    gap: int


class RunRule(NamedTuple):
    threshold: float
    need: int


def _rise(fire: float, rise: float | None, win: int, hits: int) -> FireRule:
    return FireRule("smoke_rise", fire, None, rise, win, hits)


RISE_FIRE = (0.10, 0.14, 0.18, 0.22, 0.26, 0.30, 0.34, 0.40, 0.50)
RISE_WINDOWS = (
    (3, 2), (4, 2), (6, 3), (8, 4), (10, 5), (12, 5), (12, 7), (14, 6), (16, 7), (16, 9), (20, 9), (20, 12),
)
RISE_STEPS = (None, 0.2, 0.3, 0.4, 0.5)


def rise_grid() -> list[FireRule]:
    """540 points: fire level x frame x smoke rise."""
    return [_rise(f, r, w, h) for f, (w, h), r in product(RISE_FIRE, RISE_WINDOWS, RISE_STEPS)]


def fused_grid() -> list[FireRule]:
    """405 points for fused signals."""
    fire = (0.10, 0.12, 0.15, 0.18, 0.20, 0.25, 0.30, 0.40, 0.50)
    windows = ((2, 2), (3, 2), (4, 2), (4, 3), (6, 3), (6, 4), (8, 4), (8, 5), (12, 6))
    return [_rise(f, r, w, h) for f, (w, h), r in product(fire, windows, RISE_STEPS)]


def detail_grid() -> list[FireRule]:
    """630 points: kind x fire level x smoke level x frame."""
    kinds = ("fire_only", "combined", "smoke_ok")
    fire = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)
    smoke = (0.3, 0.4, 0.5, 0.6, 0.7)
    windows = ((3, 2), (5, 3), (6, 4), (8, 5), (10, 6), (12, 8))
    return [FireRule(k, f, s, None, w, h) for k, f, s, (w, h) in product(kinds, fire, smoke, windows)]


def gated_grid() -> list[FireRule]:
    """96 points with smoke switched off and on."""
    return [
        FireRule("smoke_ok" if on else "fire_only", f, s, None, w, h)
        for f, s, (w, h), on in product(
            (0.35, 0.4, 0.45, 0.5), (0.6, 0.7, 0.8), ((6, 4), (6, 3), (8, 4), (4, 2)), (False, True)
        )
    ]


def held_out_fire_grid() -> list[FireRule]:
    """216 points searched by leave-one-out."""
    windows = ((4, 3), (6, 4), (8, 4), (10, 5), (12, 7), (16, 7), (16, 9), (20, 9), (20, 12))
    return [
        _rise(f, r, w, h)
        for f, (w, h), r in product((0.12, 0.18, 0.25, 0.30, 0.40, 0.50), windows, (None, 0.15, 0.20, 0.30))
    ]


def held_out_entry_grid() -> list[EntryRule]:
    """216 points."""
    return [
        EntryRule(*p)
        for p in product((0.25, 0.35, 0.45, 0.55), (0, 3, 4), (1, 2, 3), (8.0, 12.0, 16.0, 20.0, 24.0, 28.0))
    ]


def held_out_dwell_grid() -> list[DwellRule]:
    """864 points."""
    return [
        DwellRule(*p)
        for p in product((0.25, 0.4, 0.55), (0, 3), (6, 8, 10, 12), (8, 10, 12), (0, 5, 10, 15), (2, 6, 12))
    ]


def held_out_run_grid() -> list[RunRule]:
    """52 points: 13 thresholds x 4 run lengths."""
    return [RunRule(-3.0 + 0.5 * i, n) for i, n in product(range(13), (1, 2, 3, 4))]


def fall_grid() -> list[RunRule]:
    """24 points for the track curves: threshold on the logit, run length."""
    return [RunRule(th, n) for th, n in product((0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5), (1, 2, 3))]


CROSSING_THRESHOLDS = tuple(round(0.30 + 0.05 * i, 2) for i in range(13))
SEQUENCE_THRESHOLDS = tuple(i * 0.5 for i in range(-2, 9))

NAMED_RULES = {
    "either 0.6 4/6": FireRule("either", 0.6, None, None, 6, 4),
    "fire 0.4 4/6": FireRule("fire_only", 0.4, None, None, 6, 4),
    "combined 0.4/0.6 4/6": FireRule("combined", 0.4, 0.6, None, 6, 4),
    "combined 0.4/0.6 3/5": FireRule("combined", 0.4, 0.6, None, 5, 3),
}

# certified runner settings; samples every 0.5 s for fire and every 1 s otherwise
CERTIFIED = {
    "fire": {"conf": 0.40, "hits": 4, "win": 6, "delay": 10.0},
    "intrusion": {"conf": 0.40, "hits": 2, "win": 4, "corners": 4},
    "loiter": {"conf": 0.25, "dwell_samples": 14},
    "fall": {"conf": 0.30, "hits": 3, "win": 4},
}
