"""The event rules on live samples.

Every operator here is a plain function on a streaming DataFrame.  Samples of a
clip arrive in time order; rows inside one micro-batch are put in order first,
so a batch may arrive shuffled.  What a clip can bring into one task is bounded
by the trigger (``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` at the source).
State per clip is a few numbers and survives restarts in the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import MAX_MISS, _Track, advance, match_boxes

_STATE = "payload string"
_TIMEOUT = GroupStateTimeout.NoTimeout


def _load(state: GroupState, fresh: Callable[[], dict]) -> dict:
    return json.loads(state.get[0]) if state.exists else fresh()


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    frames = list(batches)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    return rows.sort_values(by, kind="stable")


def online_onset(samples: DataFrame, n: int, m: int, key_type: str = "long") -> DataFrame:
    """N-of-M onset, emitted once per clip as soon as it fires.

    ``samples`` has ``clip, t, hit`` with one row per sample, hit or not.
    """

    def step(key, batches, state: GroupState):
        s = _load(state, lambda: {"seen": 0, "hits": [], "done": False})
        if s["done"]:
            for _ in batches:
                pass
            return
        rows = _ordered(batches, ["t"])
        for t, hit in zip(rows["t"].tolist(), rows["hit"].tolist()):
            s["seen"] += 1
            if not hit:
                continue
            # hits that can still share a frame with this one
            s["hits"] = [h for h in s["hits"] if h[0] > s["seen"] - m] + [[s["seen"], t]]
            if len(s["hits"]) >= n:
                s["done"] = True
                yield pd.DataFrame({"clip": [key[0]], "onset": [s["hits"][0][1]], "fired_at": [t]})
                s["hits"] = []
                break
        state.update((json.dumps(s),))

    return samples.groupBy("clip").applyInPandasWithState(
        step, f"clip {key_type}, onset double, fired_at double", _STATE, "append", _TIMEOUT
    )


def box_samples(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple[int, tuple[float, ...]]]]]:
    """Samples in time order, each with (box_no, corners) of its boxes, the most confident first.

    A clip has a few boxes in a sample, so they are cut out of plain lists; a
    frame for each sample would cost more than tracking it.
    """
    frames = list(batches)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    order = np.lexsort((rows["box_no"], -rows["conf"], rows["idx"]))
    idx, box_no = (rows[n].to_numpy()[order].tolist() for n in ("idx", "box_no"))
    corners = zip(*[rows[n].to_numpy()[order].tolist() for n in ("x1", "y1", "x2", "y2")])
    for at, sample in groupby(zip(idx, box_no, corners), key=lambda r: r[0]):
        yield int(at), [(b, c) for _, b, c in sample]


def online_tracks(boxes: DataFrame, key_type: str = "long") -> DataFrame:
    """The box tracker on live samples: ``clip, idx, box_no, conf`` and corners in, track numbers out."""

    def step(key, batches, state: GroupState):
        s = _load(state, lambda: {"created": 0, "tracks": []})
        tracks = [_Track(tuple(t[:4]), t[4], t[5]) for t in s["tracks"]]
        created = s["created"]
        out: list[tuple[int, int, int]] = []
        for idx, sample in box_samples(batches):
            tokens, tracks, created = advance(tracks, idx, [c for _, c in sample], created, match_boxes, MAX_MISS + 1)
            out += [(idx, int(b), t) for (b, _), t in zip(sample, tokens)]
        state.update((json.dumps({"created": created, "tracks": [[*t.box, t.last, t.token] for t in tracks]}),))
        yield pd.DataFrame(
            {"clip": [key[0]] * len(out), "idx": [o[0] for o in out], "box_no": [o[1] for o in out], "track": [o[2] for o in out]}
        )

    return boxes.groupBy("clip").applyInPandasWithState(
        step, f"clip {key_type}, idx long, box_no long, track long", _STATE, "append", _TIMEOUT
    )


def sample_grid(detections: DataFrame, ts: str = "ts", width: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Tumbling sample grid: best confidence per class and grid cell."""
    best = lambda c: F.coalesce(F.max(F.when(F.col("cls") == c, F.col("conf"))), F.lit(0.0))
    return (
        detections.withWatermark(ts, late)
        .groupBy("clip", F.window(ts, width))
        .agg(best(0).alias("fire"), best(1).alias("smoke"), F.count(F.lit(1)).alias("boxes"))
        .select("clip", F.col("window.start").alias("start"), "fire", "smoke", "boxes")
    )


def sliding_summary(
    samples: DataFrame, ts: str = "ts", width: str = "6 seconds", step: str = "500 milliseconds", late: str = "10 seconds"
) -> DataFrame:
    """Trailing summaries on a sliding window of event time."""
    return (
        samples.withWatermark(ts, late)
        .groupBy("clip", F.window(ts, width, step))
        .agg(
            F.max("fire").alias("fire_max"), F.avg("fire").alias("fire_mean"), F.stddev_pop("fire").alias("fire_std"),
            F.count(F.when(F.col("fire") >= 0.4, 1)).alias("strong"), F.count(F.lit(1)).alias("n"),
        )
        .select("clip", F.col("window.end").alias("at"), "fire_max", "fire_mean", "fire_std", "strong", "n")
    )


def late_rows(query) -> int:
    """Rows a finished or running query dropped behind its watermark."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for p in query.recentProgress
        for op in (p["stateOperators"] if isinstance(p, dict) else json.loads(p.json)["stateOperators"])
    )


def latest_progress(lines: DataFrame, pattern: str, order: Column) -> DataFrame:
    """Newest matching line of every log that is still growing (update mode)."""
    return (
        lines.filter(F.col("line").rlike(pattern))
        .groupBy("name")
        .agg(F.max_by("line", order).alias("line"), F.count(F.lit(1)).alias("matches"))
    )


def enrich(samples: DataFrame, static: DataFrame, key: str = "clip") -> DataFrame:
    """Stream-static join with ground truth or zones; Spark broadcasts a small static side."""
    return samples.join(static, key, "left")
