"""Sample and window features for classifiers and diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import chunked, piece_window
from .scoring import AFTER_S, BEFORE_S

ONSET_WINDOW = 12  # fixed value: six seconds of half-second samples
SEQUENCE_WINDOW = 20


def class_peaks(boxes: DataFrame, keys: Sequence[str], conf: str = "conf", cls: str = "cls") -> DataFrame:
    """Boxes to one row per sample: best confidence per class, 0 where none."""
    best = lambda c: F.coalesce(F.max(F.when(F.col(cls) == c, F.col(conf))), F.lit(0.0))
    return boxes.groupBy(*keys).agg(
        best(0).alias("fire"), best(1).alias("smoke"), F.count(F.lit(1)).alias("boxes")
    )


def class_peaks_nested(samples: DataFrame, boxes: str = "boxes") -> DataFrame:
    """The same from a nested box array: no shuffle, empty samples stay with zeros."""
    best = lambda c: F.coalesce(
        F.array_max(F.transform(F.filter(boxes, lambda b: b["cls"] == c), lambda b: b["conf"])), F.lit(0.0)
    )
    return samples.withColumn("fire", best(0)).withColumn("smoke", best(1))


def view_features(boxes: DataFrame, keys: Sequence[str], views: int = 6) -> DataFrame:
    """Best confidence per view and class, plus the box of the best fire."""
    cell = lambda cls, v: F.coalesce(
        F.max(F.when((F.col("cls") == cls) & (F.col("view") == v), F.col("conf"))), F.lit(0.0)
    )
    fire = F.when(F.col("cls") == 0, F.struct(F.col("conf"), (-F.col("view")).alias("v")))
    aggs = [cell(0, v).alias(f"fire{v}") for v in range(views)]
    aggs += [cell(1, v).alias(f"smoke{v}") for v in range(views)]
    aggs.append(F.max_by(F.struct("cx", "cy", "w", "h"), fire).alias("_box"))
    out = boxes.groupBy(*keys).agg(*aggs)
    zero = F.lit(0.0)
    return out.select(
        *keys,
        *[f"fire{v}" for v in range(views)],
        *[f"smoke{v}" for v in range(views)],
        *[F.coalesce(F.col(f"_box.{c}"), zero).alias(f"best_{c}") for c in ("cx", "cy", "w", "h")],
    )


def window_extrema(samples: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Peaks inside the tolerance window, well before it, around it and overall."""
    t, g = F.col("t"), F.col("start_s")
    peak = lambda cond, v: F.coalesce(F.max(F.when(cond, F.col(v))), F.lit(0.0))
    around = (t >= g - 10) & (t <= g + 20)
    return samples.groupBy(*keys).agg(
        peak((t >= g - BEFORE_S) & (t <= g + AFTER_S), "fire").alias("in_window"),
        peak(t < g - 5, "fire").alias("before"),
        peak(around, "fire").alias("around_fire"),
        peak(around, "smoke").alias("around_smoke"),
        F.coalesce(F.max("fire"), F.lit(0.0)).alias("overall"),
    )


def miss_diagnosis(boxes: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """What was seen inside the tolerance window: best fire with view and area, best smoke."""
    t, g = F.col("t"), F.col("start_s")
    inside = boxes.filter((t >= g - BEFORE_S) & (t <= g + AFTER_S))
    fire = F.when(F.col("cls") == 0, F.col("conf"))
    return inside.groupBy(*keys).agg(
        F.max(fire).alias("fire"),
        F.max_by("view", fire).alias("view"),
        F.max_by("area", fire).alias("area"),
        F.max(F.when(F.col("cls") == 1, F.col("conf"))).alias("smoke"),
        F.count(F.lit(1)).alias("samples"),
    )


def trailing_summary(indexed: DataFrame, values: Sequence[str] = ("fire", "smoke"), size: int = ONSET_WINDOW) -> DataFrame:
    """Six summaries per value over the last ``size`` samples, and their count."""
    cut = chunked(indexed, ["clip"], "idx", back=size - 1)
    w = piece_window(["clip"], "idx").rowsBetween(-(size - 1), 0)
    n = F.count(F.lit(1)).over(w)
    cols: dict[str, Column] = {}
    for v in values:
        x = F.col(v)
        cols[f"{v}_max"] = F.max(x).over(w)
        cols[f"{v}_mean"] = F.avg(x).over(w)
        cols[f"{v}_std"] = F.stddev_pop(x).over(w)
        cols[f"{v}_share"] = F.count(F.when(x >= 0.4, 1)).over(w) / n
        cols[f"{v}_last"] = x
        cols[f"{v}_rise"] = x - F.first(x).over(w)
    cols["n"] = n
    return cut.withColumns(cols).filter("_own").drop("_own", "_piece")


def onset_label(t: Column, start: Column, delay: float = 10.0) -> Column:
    """1 where raising the alarm now would land inside the tolerance window."""
    due = t + delay
    return F.when(start.isNotNull() & (due >= start - BEFORE_S) & (due <= start + AFTER_S), 1).otherwise(0)


def overlap_seconds(t0: Column, t1: Column, g0: Column, g1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(t1, g1) - F.greatest(t0, g0))


def window_label(t0: Column, t1: Column, start: Column, dur: Column, min_dur: float = 5.0) -> Column:
    """1 with at least half the window inside the event, 0 with none, NULL between."""
    dur = F.greatest(dur, F.lit(min_dur))
    overlap = overlap_seconds(t0, t1, start, start + dur)
    share = overlap / (t1 - t0 + 1e-6)
    return F.when(start.isNull(), 0).when(share >= 0.5, 1).when(overlap == 0, 0)


def training_windows(
    indexed: DataFrame, values: Sequence[str], size: int = SEQUENCE_WINDOW, present: str | None = None, keys: Sequence[str] = ("clip",)
) -> DataFrame:
    """Windows of the ``size`` samples before each sample; the last sample ends none.

    Needs ``start_s`` and ``dur_s``.  Ambiguous windows are dropped, and with a
    ``present`` flag also windows with fewer than a quarter of it set.
    """
    cut = chunked(indexed, keys, "idx", back=size)
    w = piece_window(keys, "idx").rowsBetween(-size, -1)
    cols: dict[str, Column] = {
        "_n": F.count(F.lit(1)).over(w),
        "t0": F.min("t").over(w),
        "t1": F.max("t").over(w),
    }
    for v in values:
        cols[f"{v}_seq"] = F.collect_list(v).over(w)
    if present:
        cols["_present"] = F.count(F.when(F.col(present), 1)).over(w)
    out = cut.withColumns(cols).filter(F.col("_own") & (F.col("_n") == size))
    if present:
        out = out.filter(F.col("_present") >= size // 4)
    out = out.withColumn("label", window_label(F.col("t0"), F.col("t1"), F.col("start_s"), F.col("dur_s")))
    return out.filter(F.col("label").isNotNull()).select(
        *keys, F.col("idx").alias("end_idx"), "t0", "t1", *[f"{v}_seq" for v in values], "label"
    )


def strided_windows(
    indexed: DataFrame, values: Sequence[str], size: int, stride: int, label: str = "end", keys: Sequence[str] = ("clip",)
) -> DataFrame:
    """Full windows starting at every ``stride``-th sample.

    ``label="end"``: 1 when the window ends inside the tolerance window;
    ``label="overlap"``: as in ``window_label``, ambiguous windows dropped.
    """
    cut = chunked(indexed, keys, "idx", ahead=size - 1)
    w = piece_window(keys, "idx").rowsBetween(0, size - 1)
    cols: dict[str, Column] = {
        "_n": F.count(F.lit(1)).over(w),
        "t0": F.col("t"),
        "t1": F.max("t").over(w),
    }
    for v in values:
        cols[f"{v}_seq"] = F.collect_list(v).over(w)
    out = cut.withColumns(cols).filter(F.col("_own") & (F.col("_n") == size) & (F.col("idx") % stride == 0))
    if label == "end":
        inside = (F.col("t1") >= F.col("start_s") - BEFORE_S) & (F.col("t1") <= F.col("start_s") + AFTER_S)
        y = F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    else:
        y = window_label(F.col("t0"), F.col("t1"), F.col("start_s"), F.col("dur_s"))
    out = out.withColumn("label", y).filter(F.col("label").isNotNull())
    return out.select(*keys, F.col("idx").alias("start_idx"), "t0", "t1", *[f"{v}_seq" for v in values], "label")


def resample(samples: DataFrame, axis: DataFrame, factor: int, payload: Sequence[str], keys: Sequence[str] = ("clip",), tracks: Sequence[str] = ("track",)) -> DataFrame:
    """Keeps the first present sample of every ``factor`` positions of the axis.

    ``axis`` has every sample position of the clip (``idx, t``); the result has
    one row per kept position and track, ``present=false`` where the track has
    no sample in the bucket.
    """
    slot = F.floor(F.col("idx") / factor).cast("long")
    kept = (
        samples.withColumn("slot", slot)
        .groupBy(*keys, *tracks, "slot")
        .agg(F.min_by(F.struct(*payload), "idx").alias("_first"))
    )
    ticks = axis.filter(F.col("idx") % factor == 0).select(*keys, slot.alias("slot"), "t")
    names = samples.select(*keys, *tracks).distinct()
    full = ticks.join(names, list(keys))
    return full.join(kept, [*keys, *tracks, "slot"], "left").select(
        *keys, *tracks, "slot", "t",
        F.col("_first").isNotNull().alias("present"),
        *[F.col(f"_first.{p}").alias(p) for p in payload],
    )


def lag_difference(indexed: DataFrame, value: str, by: int, out: str, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Change against ``by`` samples ago; NULL at the start of a clip."""
    cut = chunked(indexed, keys, "idx", back=by)
    w = piece_window(keys, "idx")
    return (
        cut.withColumn(out, F.col(value) - F.lag(value, by).over(w)).filter("_own").drop("_own", "_piece")
    )


def person_summary(slots: DataFrame, keys: Sequence[str], vector: str, dims: int, people: int) -> DataFrame:
    """Max and mean per dimension over all slots, empty ones included, plus the valid count.

    ``vector`` holds ``dims`` values per slot and starts with the valid flag.
    """
    aggs = [F.max(F.col(vector)[i]).alias(f"max{i}") for i in range(dims)]
    aggs += [(F.sum(F.col(vector)[i]) / people).alias(f"mean{i}") for i in range(dims)]
    aggs.append(F.sum(F.col(vector)[0]).alias("valid"))
    return slots.groupBy(*keys).agg(*aggs)


def main_track(presence: DataFrame) -> DataFrame:
    """The track that stands for the event: mean confidence x samples inside it.

    ``presence`` has ``clip, track, t, conf, present, start_s, dur_s``.
    """
    inside = presence.filter(
        F.col("present") & (F.col("t") >= F.col("start_s")) & (F.col("t") <= F.col("start_s") + F.col("dur_s"))
    )
    weight = inside.groupBy("clip", "track").agg((F.avg("conf") * F.count(F.lit(1))).alias("weight"))
    return weight.groupBy("clip").agg(
        F.max_by("track", F.struct("weight", (-F.xxhash64("track")).alias("tie"))).alias("main_track"),
        F.max("weight").alias("weight"),
    )
