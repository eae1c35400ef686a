"""Linking per-sample detections to tracks.

Greedy tracking is sequential along a clip, yet what it remembers is small: the
last box of each track that may still be matched.  A clip is therefore cut into
pieces that run in parallel.  A piece needs the tracks alive at its start.  They
are first guessed from a short stretch before the piece, then compared with
what the piece before really ended with; pieces that started from something
else run again, until every start equals the end before it.  The guess is
nearly always right, as a track is forgotten after a few missed samples, and
the result is the sequential one.  Track numbers are put together afterwards: a
piece numbers its own new tracks, inherited ones are followed back through the
pieces by doubling steps.

Equal overlaps or distances go to the track whose last box comes first by
position, which does not depend on how long a track has lived.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpoint
from .ordered import chunked

# fixed values
IOU_LIMIT, MAX_MISS, NEAR_PX, NEAR_SIDE = 0.25, 10, 60.0, 0.8
KP_GAP, KP_NEAR_PX, KP_NEAR_STEP_PX = 8, 120.0, 40.0

TRACK_PIECE = 512


class _Track:
    __slots__ = ("box", "last", "token")

    def __init__(self, box: tuple[float, ...], last: int, token: int):
        self.box, self.last, self.token = box, last, token


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def _center_distance(a, b) -> float:
    return math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def match_boxes(box, idx: int, free: list[_Track]) -> _Track | None:
    """Best overlap over the limit, else the nearest centre within reach.

    Every box meets every free track here, so overlap and distance are written
    out instead of calling ``_iou`` and ``_center_distance``.
    """
    x1, y1, x2, y2 = box
    area = (x2 - x1) * (y2 - y1)
    best, top = None, None
    for t in free:
        a1, b1, a2, b2 = t.box
        w = (a2 if a2 < x2 else x2) - (a1 if a1 > x1 else x1)
        if w <= 0:
            continue
        h = (b2 if b2 < y2 else y2) - (b1 if b1 > y1 else y1)
        if h <= 0:
            continue
        inter = w * h
        union = area + (a2 - a1) * (b2 - b1) - inter
        over = inter / union if union > 0 else 0.0
        if over > IOU_LIMIT and (best is None or over > top or over == top and t.box < best.box):
            best, top = t, over
    if best is not None:
        return best
    reach, cx, cy = max(NEAR_PX, NEAR_SIDE * max(x2 - x1, y2 - y1)), x1 + x2, y1 + y2
    for t in free:
        a1, b1, a2, b2 = t.box
        far = math.hypot((cx - a1 - a2) / 2, (cy - b1 - b2) / 2)
        if far <= reach * (1 + idx - t.last) and (best is None or far < top or far == top and t.box < best.box):
            best, top = t, far
    return best


def match_centers(box, idx: int, free: list[_Track]) -> _Track | None:
    """Nearest keypoint centre; the reach grows with the pause."""
    cx, cy = box[0] + box[2], box[1] + box[3]
    best, top = None, None
    for t in free:
        a1, b1, a2, b2 = t.box
        far = math.hypot((cx - a1 - a2) / 2, (cy - b1 - b2) / 2)
        if far <= KP_NEAR_PX + KP_NEAR_STEP_PX * (idx - t.last) and (best is None or far < top or far == top and t.box < best.box):
            best, top = t, far
    return best


def advance(
    tracks: list[_Track], idx: int, boxes: Sequence[tuple[float, ...]], created: int, match: Callable, memory: int
) -> tuple[list[int], list[_Track], int]:
    """One sample: token per box in the given order, the tracks kept, new tracks so far."""
    alive = [t for t in tracks if idx - t.last <= memory]
    free, tokens, fresh = list(alive), [], []
    for box in boxes:
        t = match(box, idx, free)
        if t is None:
            created += 1
            t = _Track(box, idx, created)
            fresh.append(t)
        else:
            free.remove(t)
            t.box, t.last = box, idx
        tokens.append(t.token)
    return tokens, alive + fresh, created


_RESULT = (
    "{keys}, piece long, kind int, idx long, box_no long, token long, created long, "
    "state array<struct<x1:double,y1:double,x2:double,y2:double,last:long,token:long>>"
)
_GEOMETRY = ("x1", "y1", "x2", "y2", "last")
_NAMES = ("x1", "y1", "x2", "y2")
# result rows: a box, the tracks at the end of the piece, the tracks it started from
_BOX, _END, _START = 0, 1, 2


def _samples(boxes: pd.DataFrame, order: Sequence[str]):
    """Samples in time order, each with its boxes in choosing order."""
    ordered = boxes.sort_values(["idx", *order], kind="stable")
    numbers = zip(ordered["idx"].tolist(), ordered["box_no"].tolist())
    corners = zip(*[ordered[n].tolist() for n in _NAMES])
    return groupby(zip(numbers, corners), key=lambda r: r[0][0])


def _run_piece(keys: Sequence[str], order: Sequence[str], match: Callable, memory: int, size: int):
    """One piece: from the given start, or from a guess made on the samples before it."""

    def guess(before: pd.DataFrame, begin: int) -> list[_Track]:
        tracks: list[_Track] = []
        for idx, sample in _samples(before, order):
            _, tracks, _ = advance(tracks, idx, [c for _, c in sample], 0, match, memory)
        return [t for t in tracks if begin - t.last <= memory]

    def run(key, boxes: pd.DataFrame, states: pd.DataFrame | None) -> pd.DataFrame:
        begin = key[-1] * size
        if states is None:
            tracks = guess(boxes[~boxes["_own"]], begin)
        elif len(states):
            tracks = [_Track(tuple(s[n] for n in _NAMES), int(s["last"]), 0) for s in states["state"].iloc[0]]
        else:
            tracks = []
        # a slot is the place of a track in position order
        tracks.sort(key=lambda t: (*t.box, t.last))
        for slot, t in enumerate(tracks):
            t.token = -(slot + 1)
        started = [{**dict(zip(_NAMES, t.box)), "last": t.last, "token": t.token} for t in tracks]
        created, out = 0, []
        for idx, sample in _samples(boxes[boxes["_own"]], order):
            rows = list(sample)
            tokens, tracks, created = advance(tracks, idx, [c for _, c in rows], created, match, memory)
            out += [(idx, n[1], t) for (n, _), t in zip(rows, tokens)]
        ended = [{**dict(zip(_NAMES, t.box)), "last": t.last, "token": t.token} for t in tracks]
        n = len(out)
        frame = pd.DataFrame({"kind": np.r_[np.full(n, _BOX), _END, _START]}).assign(**dict(zip((*keys, "piece"), key)))
        for i, c in enumerate(("idx", "box_no", "token")):
            frame[c] = pd.array([o[i] for o in out] + [None, None], dtype="Int64")
        frame["created"] = pd.arrays.IntegerArray(np.r_[np.zeros(n, "int64"), created, 0], np.r_[np.ones(n, bool), False, True])
        frame["state"] = pd.Series([None] * n + [ended, started], dtype=object)
        return frame[[*keys, "piece", "kind", "idx", "box_no", "token", "created", "state"]]

    return run


def _newest(log: list[DataFrame], at: Sequence[str]) -> DataFrame:
    """The start and the end of each piece, as the last round that ran it left them."""
    edges = reduce(DataFrame.unionByName, [d.filter(F.col("kind") != _BOX).select(*at, "kind", "round", "created", "state") for d in log])
    if len(log) == 1:
        return edges
    newest = edges.groupBy(*at, "kind").agg(F.max_by(F.struct("round", "created", "state"), "round").alias("_e"))
    return newest.select(*at, "kind", "_e.round", "_e.created", "_e.state")


def _states(results: DataFrame, keys: Sequence[str], piece: int, memory: int) -> DataFrame:
    """The tracks each piece hands to the next one, in position order."""
    # the shifted piece number gets its own step: inside the lambda a new column of
    # the same select would hide the old one
    handed = results.filter(F.col("kind") == _END).select(*keys, (F.col("piece") + 1).alias("piece"), "state")
    usable = F.filter("state", lambda t: F.col("piece") * piece - t["last"] <= memory)
    return handed.withColumn("state", F.array_sort(usable)).filter(F.size("state") > 0)


def link(
    boxes: DataFrame,
    keys: Sequence[str] = ("clip",),
    order: Sequence[str] = ("neg_conf", "box_no"),
    match: Callable = match_boxes,
    memory: int = MAX_MISS + 1,
    piece: int = TRACK_PIECE,
) -> DataFrame:
    """Track number for every box: (keys, idx, box_no, track), numbered from one per clip.

    ``boxes`` has ``idx`` (sample position), ``box_no`` (unique in the sample),
    the corners, and the columns of ``order`` in which a sample's boxes choose.
    """
    if piece <= memory:
        raise ValueError("a piece must be longer than the memory of a track")
    keys, at = list(keys), [*keys, "piece"]
    columns = list(dict.fromkeys(["idx", "box_no", *_NAMES, *order]))
    # the samples before a piece serve to guess the tracks it starts with
    cut = chunked(boxes.select(*keys, *columns), keys, "idx", back=min(4 * memory, piece - 1), size=piece)
    cut = checkpoint(cut.withColumnRenamed("_piece", "piece"))
    schema = _RESULT.format(keys=", ".join(f"{k} {dict(boxes.dtypes)[k]}" for k in keys))
    run = _run_piece(keys, order, match, memory, piece)
    # what each round found, with its number: a round writes only the pieces it ran again
    log = [
        checkpoint(
            cut.groupBy(*at).applyInPandas(
                lambda key, rows: run(key, rows, None) if rows["_own"].any() else _nothing(keys), schema
            ).withColumn("round", F.lit(0))
        )
    ]
    own = cut.filter("_own").drop("_own").withColumn("_own", F.lit(True))
    geometry = F.transform("state", lambda t: F.struct(*[t[c] for c in _GEOMETRY]))
    while True:
        edges = _newest(log, at)
        started = edges.filter(F.col("kind") == _START).select(*at, geometry.alias("_old"))
        states = _states(edges, keys, piece, memory)
        given = states.select(*at, geometry.alias("_new"))
        changed = started.join(given, at, "left").withColumn("_new", F.coalesce("_new", F.slice("_old", 1, 0)))
        changed = checkpoint(changed.filter(F.col("_new") != F.col("_old")).select(*at))
        if changed.isEmpty():
            break
        again = (
            own.join(changed, at, "left_semi").groupBy(*at)
            .cogroup(states.join(changed, at, "left_semi").groupBy(*at))
            .applyInPandas(run, schema)
        )
        log.append(checkpoint(again.withColumn("round", F.lit(len(log)))))
    last = edges.filter(F.col("kind") == _END).select(*at, "round")
    results = reduce(DataFrame.unionByName, log)
    results = results.join(last, [*at, "round"]) if len(log) > 1 else results

    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = results.filter(F.col("kind") == _END).select(
        *at, F.coalesce(F.sum("created").over(before), F.lit(0)).alias("base")
    )
    roots = _roots(_states(results, keys, piece, memory), keys)
    own = results.filter(F.col("kind") == _BOX).select(*at, "idx", "box_no", "token")
    placed = own.withColumn("slot", F.when(F.col("token") < 0, -F.col("token") - 1)).join(roots, [*at, "slot"], "left")
    placed = placed.select(
        *keys, "idx", "box_no",
        F.coalesce("root_piece", "piece").alias("piece"), F.coalesce("root_token", "token").alias("token"),
    )
    return placed.join(base, at).select(*keys, "idx", "box_no", (F.col("base") + F.col("token")).alias("track"))


def _nothing(keys: Sequence[str]) -> pd.DataFrame:
    names = (*keys, "piece", "kind", "idx", "box_no", "token", "created", "state")
    return pd.DataFrame({c: pd.Series(dtype=object) for c in names})


def _roots(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where every inherited slot began: (keys, piece, slot) to (root_piece, root_token)."""
    links = states.select(*keys, "piece", F.posexplode("state").alias("slot", "_t")).select(
        *keys, "piece", F.col("slot").cast("long").alias("slot"), (F.col("piece") - 1).alias("to_piece"), F.col("_t.token").alias("to")
    )
    links = checkpoint(links)
    while not links.filter(F.col("to") < 0).isEmpty():
        target = links.select(
            *keys, F.col("piece").alias("to_piece"), (-F.col("slot") - 1).alias("to"),
            F.col("to_piece").alias("_piece"), F.col("to").alias("_to"),
        )
        links = checkpoint(
            links.join(target, [*keys, "to_piece", "to"], "left").select(
                *keys, "piece", "slot", F.coalesce("_piece", "to_piece").alias("to_piece"), F.coalesce("_to", "to").alias("to")
            )
        )
    return links.select(*keys, "piece", "slot", F.col("to_piece").alias("root_piece"), F.col("to").alias("root_token"))


def track_people(boxes: DataFrame, keys: Sequence[str] = ("clip",), piece: int = TRACK_PIECE) -> DataFrame:
    """Box tracker: most confident box first, overlap before distance."""
    ranked = boxes.withColumn("neg_conf", -F.col("conf"))
    return link(ranked, keys, ("neg_conf", "box_no"), match_boxes, MAX_MISS + 1, piece)


def track_keypoints(people: DataFrame, keys: Sequence[str] = ("clip",), piece: int = TRACK_PIECE) -> DataFrame:
    """Keypoint-centre tracker: slots in order, people without a visible keypoint are no detection."""
    from ..functions.pose import center

    # inside a generator, as a filter on the centre would move below it and find it a second time
    c = people.select(
        *keys, "idx", F.col("slot").cast("long").alias("box_no"), F.inline(F.array_compact(F.array(center(F.col("kp"))))).alias("_x", "_y")
    )
    points = c.select(*keys, "idx", "box_no", F.col("_x").alias("x1"), F.col("_y").alias("y1"), F.col("_x").alias("x2"), F.col("_y").alias("y2"))
    return link(points, keys, ("box_no",), match_centers, KP_GAP, piece)
