"""Onset detection learned from trailing signal summaries, judged on clips it has not seen."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..plans.presets import CROSSING_THRESHOLDS
from . import boosting, sweep
from .features import onset_label, trailing_summary

FEATURES = [f"{v}_{s}" for v in ("fire", "smoke") for s in ("max", "mean", "std", "share", "last", "rise")] + ["n"]
FOLDS = 5
FIT_ROWS = 200_000  # windows that a fold is fitted on at most


def onset_dataset(indexed: DataFrame, truth: DataFrame) -> DataFrame:
    """13 features per sample, and 1 where raising the alarm now would be a hit; clips without an event have none."""
    x = trailing_summary(indexed).join(truth, "clip")
    return x.withColumn("label", onset_label(F.col("t"), F.col("start_s")))


def out_of_fold(
    indexed: DataFrame, truth: DataFrame, folds: int = FOLDS, settings: boosting.Settings = boosting.Settings(), limit: int = FIT_ROWS
) -> DataFrame:
    """``clip, idx, t, fold, label, p``: every sample's probability by the model of the folds its clip is not in.

    The models are as many as the folds and of fixed size: they pass the driver.
    """
    rows = onset_dataset(indexed, truth).withColumn("fold", sweep.fold_of(F.col("clip"), folds))
    rows = rows.select("clip", "idx", "t", "fold", "label", *FEATURES)
    fitted = boosting.fit_folds(rows, FEATURES, "label", folds, order=F.xxhash64("clip", "idx"), limit=limit, settings=settings)
    models = {k: {"base": 0.0, "trees": []} for k in range(folds)}
    models.update({r["fold"]: json.loads(r["model"]) for r in fitted.toLocalIterator()})
    return boosting.score_folds(rows, models, FEATURES).select("clip", "idx", "t", "fold", "label", "p")


def fired_at_thresholds(scored: DataFrame, truth: DataFrame, delay: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """First sample at or over each threshold with its verdict, and the thresholds."""
    levels = CROSSING_THRESHOLDS
    firsts = scored.groupBy("clip").agg(*[F.min(F.when(F.col("p") >= th, F.col("t"))).alias(f"t{i}") for i, th in enumerate(levels)])
    fired = firsts.select(
        "clip", F.posexplode(F.array(*[F.col(f"t{i}") for i in range(len(levels))])).alias("ordinal", "onset")
    ).filter(F.col("onset").isNotNull())
    table = sweep.rule_table(scored.sparkSession, [(t,) for t in levels], ["threshold"])
    return sweep.fired_verdicts(fired, truth, delay), table
