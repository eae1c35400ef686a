"""Plug point for a detector: images in, per-image scores out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_kept: dict[str, Callable] = {}  # predictors of this worker process


BOXES = "array<struct<cls:int,conf:double,x1:double,y1:double,x2:double,y2:double>>"


def score_images(
    images: DataFrame, make_predictor: Callable[[], Callable[[pd.DataFrame], pd.Series]], keys: str, conf: float = 0.25,
    model: str | None = None,
) -> DataFrame:
    """Runs a user-supplied predictor over Arrow batches and sums up each image.

    ``make_predictor`` returns a function from a batch of rows to one list of
    boxes (dicts) per row.  It is called once per task, or with a name for its
    ``model`` once per worker process, which keeps what it loaded.  ``keys`` is the schema
    of the columns to keep.  The summary stays in Spark: number of boxes at or
    above ``conf``, best confidence, class of the best box.
    """
    names = [k.strip().split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = _kept.get(model) or make_predictor()
        if model is not None:
            _kept[model] = predict
        for batch in batches:
            yield batch[names].assign(boxes=predict(batch))

    found = images.mapInPandas(run, f"{keys}, boxes {BOXES}")
    kept = F.filter("boxes", lambda b: b["conf"] >= conf)
    best = F.array_max(F.transform("kept", lambda b: F.struct(b["conf"], (-b["cls"]).alias("neg"))))
    return found.select(*names, kept.alias("kept")).select(
        *names, F.size("kept").alias("n_det"), F.coalesce(best["conf"], F.lit(0.0)).alias("max_conf"), (-best["neg"]).alias("top_class")
    )
