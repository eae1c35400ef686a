"""Greedy keep-the-best selection inside groups of any size.

``geometry.suppress`` handles a frame in one row.  When a group can be large
(a clip of mining candidates, a frame with an unusual number of boxes) the same
rule is run in rounds: every round looks at a bounded number of the best
remaining rows per group, decides them one by one against what was kept, and
drops all rows the newly kept ones exclude.  The result equals the sequential
pass over the whole group; no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import suppress
from ..session import checkpoint
from .ordered import top_per_group


def keep_diverse(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    row_id: str,
    vector: str,
    limit: float,
    cap: int,
    batch: int = 64,
) -> DataFrame:
    """Best rows first, at most ``cap`` per group, none with a dot product over ``limit`` to a kept one.

    ``order`` must be total.  Vectors have unit length; a NULL vector is never
    a duplicate.  Every round keeps at least one row per unfinished group, so
    there are at most ``cap`` rounds and usually two or three.
    """
    remaining, kept = rows, None
    pick_schema = rows.schema
    while True:
        head = top_per_group(remaining, keys, order, batch, "_rank")
        seen = kept.withColumn("_rank", F.lit(0)) if kept is not None else None
        both = head if seen is None else head.unionByName(seen)

        def decide(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_rank", kind="stable")
            vectors = [np.asarray(v, dtype=np.float64) for v in pdf.loc[pdf["_rank"] == 0, vector] if v is not None]
            count = int((pdf["_rank"] == 0).sum())
            fresh = []
            for i, (rank, v) in enumerate(zip(pdf["_rank"], pdf[vector])):
                if rank == 0:
                    continue
                if count >= cap:
                    break
                if v is not None:
                    v = np.asarray(v, dtype=np.float64)
                    if any(float(np.dot(v, k)) > limit for k in vectors):
                        continue
                    vectors.append(v)
                count += 1
                fresh.append(i)
            return pdf.iloc[fresh].drop(columns=["_rank"])

        fresh = checkpoint(both.groupBy(*keys).applyInPandas(decide, pick_schema))
        kept = fresh if kept is None else checkpoint(kept.unionByName(fresh))
        # a finished group is at its cap; elsewhere the kept vectors, at most ``cap``
        # of them, travel with the rows and drop everything too close to one
        state = kept.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_kept"), F.collect_list(vector).alias("_vectors")
        )
        looked = top_per_group(remaining, keys, order, batch, "_rank").select(*keys, row_id)
        rest = remaining.join(looked, [*keys, row_id], "left_anti").join(
            state.filter(F.col("_kept") < cap), list(keys)
        )
        close = F.exists("_vectors", lambda k: too_close(F.col(vector), k, limit))
        remaining = checkpoint(
            rest.filter(F.col(vector).isNull() | ~F.coalesce(close, F.lit(False))).select(*rows.columns)
        )
        if remaining.isEmpty():
            return kept


def suppress_frames(
    boxes: DataFrame,
    keys: Sequence[str],
    overlaps: Callable[[Column, Column], Column],
    order: Sequence[Column],
    box: str = "b",
    limit: int = 1000,
    batch: int = 500,
) -> DataFrame:
    """Greedy suppression of every frame: the rows that stay, ``keys`` and ``box``.

    Frames of up to ``limit`` boxes are decided in one array expression.  A
    larger one never becomes an array: its best ``batch`` boxes are decided,
    what they exclude is dropped by a join, and so on with the rest.  ``order``
    must be total on the columns of ``boxes``.
    """
    keys = list(keys)
    sizes = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = checkpoint(sizes.filter(F.col("_n") > limit).select(*keys))
    small = boxes if large.isEmpty() else boxes.join(large, keys, "left_anti")
    ranked = small.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = _decide(ranked, keys, overlaps, box)
    if large.isEmpty():
        return kept
    remaining = checkpoint(boxes.join(large, keys, "left_semi"))
    while not remaining.isEmpty():
        head = checkpoint(top_per_group(remaining, keys, order, batch, "_rank"))
        fresh = checkpoint(_decide(head, keys, overlaps, box))
        kept = kept.unionByName(fresh)
        rest = remaining.join(head.select(*keys, F.col(box).alias("_seen")), [
            *[remaining[k] == head[k] for k in keys], remaining[box].eqNullSafe(F.col("_seen"))
        ], "left_anti")
        near = fresh.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(box).alias("_kept"))
        hit = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [overlaps(F.col("_kept"), F.col(box))]
        remaining = checkpoint(rest.join(near, hit, "left_anti"))
    return kept


def _decide(rows: DataFrame, keys: list[str], overlaps, box: str) -> DataFrame:
    frame = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", F.col(box).alias("_b")))).alias("_f"))
    ranked = F.transform("_f", lambda e: e["_b"])
    # the array is in deciding order already
    kept = suppress(ranked, overlaps, order=lambda b: F.lit(0))
    return frame.select(*keys, F.explode(kept).alias(box))


def too_close(a: Column, b: Column, limit: float) -> Column:
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return dot > limit
