"""Alarms against ground truth with a tolerance window, and the F1 tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: tolerance around the ground-truth start, in seconds
BEFORE_S = 2.0
AFTER_S = 10.0

HIT, MISS, FALSE, NORMAL = "hit", "miss", "false", "normal"


def in_window(alarm: Column, start: Column) -> Column:
    return (alarm >= start - BEFORE_S) & (alarm <= start + AFTER_S)


def verdict(alarm: Column, start: Column) -> Column:
    """hit / miss / false per clip; without an event: false or normal."""
    return (
        F.when(start.isNull() & alarm.isNull(), NORMAL)
        .when(start.isNull(), FALSE)
        .when(alarm.isNull(), MISS)
        .when(in_window(alarm, start), HIT)
        .otherwise(FALSE)
    )


def f1_percent(tp: Column, fn: Column, fp: Column, digits: int | None = 2) -> Column:
    """Harmonic mean of recall and precision in percent, zero when undefined."""
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)) * 100
    return f1 if digits is None else F.bround(f1, digits)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def tally(scored: DataFrame, by: Sequence[str] = (), penalty: str = "double", digits: int | None = 2) -> DataFrame:
    """Counts and F1 over verdict rows (columns ``start_s``, ``verdict``).

    ``penalty="double"``: an alarm outside the window is a false alarm and a
    miss.  ``penalty="single"``: it is a false alarm only.
    """
    v, has = F.col("verdict"), F.col("start_s").isNotNull()
    lost = v == MISS
    if penalty == "double":
        lost = lost | (has & (v == FALSE))
    counts = scored.groupBy(*by).agg(
        count_if(v == HIT).alias("tp"), count_if(lost).alias("fn"), count_if(v == FALSE).alias("fp")
    )
    return counts.withColumn("f1", f1_percent(F.col("tp"), F.col("fn"), F.col("fp"), digits))


def score_alarms(
    alarms: DataFrame, truth: DataFrame, alarm: str = "alarm", by: Sequence[str] = (), penalty: str = "double"
) -> DataFrame:
    """One alarm at most per clip, joined to ground truth on the left."""
    scored = truth.join(alarms, "clip", "left").withColumn("verdict", verdict(F.col(alarm), F.col("start_s")))
    return tally(scored, by, penalty)


def tally_multi(alarms: DataFrame, truth: DataFrame, alarm: str = "alarm", digits: int | None = 2) -> DataFrame:
    """Several alarms per clip: the first in the window scores, all others are false."""
    start = F.col("start_s")
    per_clip = (
        truth.join(alarms, "clip", "left")
        .groupBy("clip", "start_s")
        .agg(
            F.count(alarm).alias("k"),
            F.coalesce(F.bool_or(in_window(F.col(alarm), start)), F.lit(False)).alias("ok"),
        )
    )
    per_clip = per_clip.withColumn("ok", F.col("ok") & start.isNotNull())
    totals = per_clip.agg(
        count_if(F.col("ok")).alias("tp"),
        count_if(~F.col("ok") & start.isNotNull()).alias("fn"),
        F.coalesce(F.sum(F.col("k") - F.col("ok").cast("long")), F.lit(0)).alias("fp"),
    )
    return totals.withColumn("f1", f1_percent(F.col("tp"), F.col("fn"), F.col("fp"), digits))


def image_metrics(flags: DataFrame, by: Sequence[str] = (), truth: str = "positive", alarm: str = "alarmed") -> DataFrame:
    """Image-level alarm quality: counts, precision, recall, F1, false-alarm rate."""
    y, a = F.col(truth), F.col(alarm)
    c = flags.groupBy(*by).agg(
        count_if(y & a).alias("tp"), count_if(~y & a).alias("fp"),
        count_if(y & ~a).alias("fn"), count_if(~y & ~a).alias("tn"),
    )
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero)
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)
    return (
        c.withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
        .withColumn("far", F.coalesce(F.try_divide("fp", F.col("fp") + F.col("tn")), zero))
    )
