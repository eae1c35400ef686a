"""Event rules: from per-sample predicates to one alarm time.

Every rule here works on *hit rows only* (samples or boxes for which the
predicate holds).  "N hits among the last M samples" first becomes true at a
hit, and at that moment the frame holds exactly N hits, so the rule reads: the
(N-1)-th previous hit is fewer than M samples away.  That needs one ``lag``
over the hits instead of a frame over all samples, and its reach is bounded by
M, which is what lets a long clip be cut into pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint
from .ordered import carry, chunked, next_value, piece_window, positions_among, time_bucket, with_position

ALARM_DELAY_S = 10.0  # fixed value: the fire alarm is due ten seconds after onset


def index_samples(
    samples: DataFrame,
    keys: Sequence[str] = ("clip",),
    t: str = "t",
    seconds: float = 1800.0,
    among: dict[str, Column] | None = None,
    reach: int = 0,
    about: DataFrame | None = None,
) -> DataFrame:
    """Adds ``idx``, the dense sample position in the clip.

    ``among`` names several sets of the samples instead, and the position is
    counted in each of them; see ``positions_among`` for ``reach`` and ``about``.
    """
    if among:
        return positions_among(samples, keys, [t], among, time_bucket(t, seconds), reach, about)
    return with_position(samples, keys, [t], time_bucket(t, seconds), "idx")


def with_previous_time(samples: DataFrame, keys: Sequence[str] = ("clip",), t: str = "t") -> DataFrame:
    """Adds ``prev_t``, the time of the sample before (needs ``idx``)."""
    cut = chunked(samples, keys, "idx", back=1)
    w = piece_window(keys, "idx")
    return cut.withColumn("prev_t", F.lag(t).over(w)).filter("_own").drop("_own", "_piece")


def n_of_m(
    hits: DataFrame,
    n: int,
    m: int,
    keys: Sequence[str] = ("clip",),
    t: str = "t",
    extra: Sequence[str] = (),
) -> DataFrame:
    """First time that ``n`` of the last ``m`` samples are hits.

    Returns one row per firing group with ``onset`` (the first hit inside the
    firing frame) and ``fired_at`` (the sample that completed it).
    """
    cut = chunked(hits, keys, "idx", back=m - 1)
    w = piece_window(keys, "idx", extra=extra)
    fired = (
        cut.withColumn("_first_idx", F.lag("idx", n - 1).over(w))
        .withColumn("_first_t", F.lag(t, n - 1).over(w))
        .filter(F.col("_own") & (F.col("idx") - F.col("_first_idx") < m))
    )
    # both times grow with the sample, so the first firing holds both minima
    return fired.groupBy(*keys, *extra).agg(F.min("_first_t").alias("onset"), F.min(t).alias("fired_at"))


def all_of_m(hits: DataFrame, m: int, keys: Sequence[str] = ("clip",), t: str = "t") -> DataFrame:
    """Dwell: the first sample that ends ``m`` samples in a row; onset is that sample."""
    return n_of_m(hits, m, m, keys, t).select(*keys, F.col("fired_at").alias("onset"))


def run_length(
    curve: DataFrame, threshold: float, need: int, keys: Sequence[str] = ("clip", "track"), t: str = "t", z: str = "z"
) -> DataFrame:
    """First of ``need`` consecutive values at or above the threshold, per curve."""
    return n_of_m(curve.filter(F.col(z) >= threshold), need, need, keys, t).select(*keys, "onset")


def first_crossing(
    values: DataFrame, threshold: float, keys: Sequence[str] = ("clip",), t: str = "t", z: str = "z", delay: float = 0.0
) -> DataFrame:
    """First time the value reaches the threshold, plus a delay."""
    return (
        values.filter(F.col(z) >= threshold)
        .groupBy(*keys)
        .agg((F.min(t) + F.lit(float(delay))).alias("onset"))
    )


def island_detections(
    qualified: DataFrame,
    need: int,
    gap: int = 0,
    keys: Sequence[str] = ("clip",),
    track: str = "track",
    t: str = "t",
    tie: Sequence[str] = (),
) -> DataFrame:
    """First time a track has ``need`` qualified boxes with no pause over ``gap`` samples.

    ``qualified`` holds one row per qualified box with its sample position
    ``idx``.  Two boxes of one track in one sample count twice, as pauses are
    counted in samples and length in boxes.  Returns per track ``at`` (the
    detection time) and ``since`` (where the counted stretch began), and
    ``before``, the sample before ``at``, where ``qualified`` has ``prev_t``.
    """
    reach = (need - 1) * (gap + 1)
    cut = chunked(qualified, keys, "idx", back=reach)
    w = piece_window(keys, "idx", *tie, extra=[track])
    broken = F.when(F.col("idx") - F.lag("idx").over(w) - 1 > gap, 1).otherwise(0)
    steps = cut.withColumn("_broken", broken).withColumn("_since", F.lag(t, need - 1).over(w))
    if need > 1:
        frame = w.rowsBetween(-(need - 2), 0)
        steps = steps.withColumn("_breaks", F.sum("_broken").over(frame))
    else:
        steps = steps.withColumn("_breaks", F.lit(0))
    found = steps.filter(F.col("_own") & F.col("_since").isNotNull() & (F.col("_breaks") == 0))
    # all times grow along the track, so the first detection holds the minima
    before = [F.min("prev_t").alias("before")] if "prev_t" in qualified.columns else []
    return found.groupBy(*keys, track).agg(F.min(t).alias("at"), F.min("_since").alias("since"), *before)


def settle(
    detections: DataFrame,
    samples: DataFrame,
    settle_s: float,
    keys: Sequence[str] = ("clip",),
    at: str = "at",
    value: str = "at",
    t: str = "t",
    seconds: float = 1800.0,
) -> DataFrame:
    """Keeps moving to later detections until ``settle_s`` seconds bring no new one.

    A detection time is final when some sample lies at least ``settle_s`` after
    it and before the next detection; the sample just before the next detection
    (``prev_t``) decides.  The alarm is the latest value up to the first final
    detection.  Detections with a column ``before`` bring that sample along, and
    ``samples`` is not read.
    """
    carried = "before" in detections.columns
    extra = [F.min("before").alias("before")] if carried else []
    # one row per detection time, needed three times below
    times = checkpoint(detections.groupBy(*keys, at).agg(F.max(value).alias("_value"), *extra))
    if carried:
        times = carry(times, keys, [at], time_bucket(at, seconds), F.struct(at, "before"), "_later", ahead=True, inclusive=False)
        times = times.withColumns({"_next": F.col("_later")[at], "_before": F.col("_later.before")})
    else:
        times = next_value(times, keys, at, time_bucket(at, seconds), "_next")
        # only the samples that are themselves detection times matter
        before_next = samples.select(*keys, F.col(t).alias("_next"), F.col("prev_t").alias("_before"))
        times = times.join(before_next, [*keys, "_next"], "left")
    final = F.col("_next").isNull() | (F.col("_before") - F.col(at) >= settle_s)
    stop = times.filter(final).groupBy(*keys).agg(F.min(at).alias("_stop"))
    return (
        times.join(stop, list(keys))
        .filter(F.col(at) <= F.col("_stop"))
        .groupBy(*keys)
        .agg(F.max("_value").alias("alarm"))
    )


def entrant_alarm(
    qualified: DataFrame,
    samples: DataFrame,
    hold: int,
    settle_s: float,
    keys: Sequence[str] = ("clip",),
    track: str = "track",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Intrusion: last entrant's entry, an entry being ``hold`` boxes in a row."""
    entries = island_detections(qualified, hold, 0, keys, track, tie=tie)
    return settle(entries, samples, settle_s, keys)


def dwell_alarm(
    qualified: DataFrame,
    samples: DataFrame,
    dwell_s: float,
    gap: int,
    settle_s: float,
    delay: float,
    keys: Sequence[str] = ("clip",),
    track: str = "track",
    step_s: float = 0.5,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Loitering: start of the last loiterer's stay, plus a delay."""
    need = max(1, -(-int(round(dwell_s * 1000)) // int(round(step_s * 1000))))
    stays = island_detections(qualified, need, gap, keys, track, tie=tie)
    return settle(stays, samples, settle_s, keys, value="since").withColumn(
        "alarm", F.col("alarm") + F.lit(float(delay))
    )


def baseline(
    signal: DataFrame, value: str | Sequence[str], keys: Sequence[str] = ("clip",), t: str = "t", head_s: float = 60.0, share: float = 0.8
) -> DataFrame:
    """Order statistic of the first seconds of a clip: index ``min(int(n*share), n-1)``.

    Only the head of each clip is read into a group, so its size is bounded by
    the sample rate.  Clips without a head sample get no row; callers use 0.
    Several values get a column each, null where the head has none.
    """
    values = [value] if isinstance(value, str) else list(value)
    head = signal.filter(F.col(t) <= head_s).groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(v)).alias(f"_head{i}") for i, v in enumerate(values)]
    )

    def at(i: int) -> Column:
        n = F.size(f"_head{i}")
        return F.get(f"_head{i}", F.least(F.floor(n * F.lit(share)).cast("int"), n - 1))

    return head.select(*keys, *[at(i).alias(f"{v}_base") for i, v in enumerate(values)])
