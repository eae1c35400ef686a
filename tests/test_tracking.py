"""The piecewise trackers against a plain sequential loop."""

import random

import pytest

from clipwarden.operators import tracking as K


def sequential(rows, match, memory, order):
    """clip -> (idx, box_no) -> track number, one sample after the other."""
    out = {}
    for clip in sorted({r["clip"] for r in rows}):
        tracks, created = [], 0
        mine = [r for r in rows if r["clip"] == clip]
        for idx in sorted({r["idx"] for r in mine}):
            sample = sorted((r for r in mine if r["idx"] == idx), key=order)
            boxes = [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in sample]
            alive = [t for t in tracks if idx - t["last"] <= memory]
            used = []
            for r, b in zip(sample, boxes):
                free = [t for t in alive if not any(t is u for u in used)]
                best = match(b, idx, free)
                if best is None:
                    created += 1
                    best = {"id": created}
                    alive.append(best)
                best["box"], best["last"] = b, idx
                used.append(best)
                out[(clip, idx, r["box_no"])] = best["id"]
            tracks = alive
    return out


def by_boxes(b, idx, free):
    scored = sorted(((-K._iou(b, t["box"]), t["box"], i) for i, t in enumerate(free)))
    if scored and -scored[0][0] > 0.25:
        return free[scored[0][2]]
    lim = max(60.0, 0.8 * max(b[2] - b[0], b[3] - b[1]))
    near = sorted((K._center_distance(b, t["box"]), t["box"], i) for i, t in enumerate(free))
    near = [n for n in near if n[0] <= lim * (1 + idx - free[n[2]]["last"])]
    return free[near[0][2]] if near else None


@pytest.mark.parametrize("seed", [1, 2])
def test_box_tracker_equals_sequential(spark, seed):
    rng = random.Random(seed)
    rows = []
    for clip in ("a", "b"):
        walkers = [[rng.uniform(0, 900), rng.uniform(0, 500)] for _ in range(4)]
        idx = 0
        while idx < 160:
            for n, w in enumerate(walkers):
                w[0] += rng.uniform(-25, 25)
                w[1] += rng.uniform(-15, 15)
                if rng.random() < 0.6:
                    rows.append(dict(clip=clip, idx=idx, box_no=n, conf=rng.random(), x1=w[0], y1=w[1], x2=w[0] + 40, y2=w[1] + 90))
            idx += 1 if rng.random() < 0.95 else rng.randrange(2, 40)
            if rng.random() < 0.05:
                walkers[rng.randrange(4)] = [rng.uniform(0, 900), rng.uniform(0, 500)]
    want = sequential(rows, by_boxes, 11, lambda r: (-r["conf"], r["box_no"]))
    df = spark.createDataFrame(rows, "clip string, idx long, box_no long, conf double, x1 double, y1 double, x2 double, y2 double")
    got = {(r.clip, r.idx, r.box_no): r.track for r in K.track_people(df, piece=16).collect()}
    assert got == want
    assert max(want.values()) > 4


def test_keypoint_tracker_gap_and_empty_slots(spark):
    def kp(x, y, c=0.9):
        return [(float(x), float(y), c)] * 17

    rows = [
        ("a", 0, 0, kp(100, 100)), ("a", 1, 0, kp(110, 100)), ("a", 1, 1, kp(600, 100)),
        ("a", 9, 0, kp(120, 100)),            # eight samples later: still the same person
        ("a", 18, 0, kp(120, 100)),           # nine samples later: a new one
        ("a", 19, 0, kp(0, 0, 0.1)),          # nothing visible: no detection
        ("a", 20, 0, kp(320, 100)),           # 200 px after two samples: within 120 + 40 * 2
    ]
    df = spark.createDataFrame(rows, "clip string, idx long, slot int, kp array<struct<x:double,y:double,c:double>>")
    got = {(r.idx, r.box_no): r.track for r in K.track_keypoints(df, piece=10).collect()}
    assert got == {(0, 0): 1, (1, 0): 1, (1, 1): 2, (9, 0): 1, (18, 0): 3, (20, 0): 3}


def test_matching_writes_its_formulas_out(monkeypatch):
    """As the formulas say, ties included, and without a call for every pair."""
    rng = random.Random(3)
    iou, distance = K._iou, K._center_distance

    def boxes(n):
        return [(x, y, x + 10 * rng.randrange(1, 6), y + 10 * rng.randrange(1, 6)) for x, y in ((10.0 * rng.randrange(30), 10.0 * rng.randrange(30)) for _ in range(n))]

    cases = [(b, 9, [K._Track(t, rng.randrange(9), i) for i, t in enumerate(boxes(rng.randrange(8)))]) for b in boxes(400)]
    want = []
    for b, idx, free in cases:
        over = [((-iou(b, t.box), t.box), t.token) for t in free if iou(b, t.box) > K.IOU_LIMIT]
        reach = max(K.NEAR_PX, K.NEAR_SIDE * max(b[2] - b[0], b[3] - b[1]))
        far = [((distance(b, t.box), t.box), t.token, idx - t.last) for t in free]
        near = [f[:2] for f in far if f[0][0] <= reach * (1 + f[2])]
        seen = [f[:2] for f in far if f[0][0] <= K.KP_NEAR_PX + K.KP_NEAR_STEP_PX * f[2]]
        want.append(tuple(min(found)[1] if found else None for found in (over or near, seen)))
    monkeypatch.setattr(K, "_iou", None)
    monkeypatch.setattr(K, "_center_distance", None)
    token = lambda t: None if t is None else t.token
    assert [(token(K.match_boxes(*c)), token(K.match_centers(*c))) for c in cases] == want
    assert len(set(want)) > 10


def test_centers_are_found_once(spark, monkeypatch):
    rows = [("a", 0, 0, [(1.0, 2.0, 0.9)] * 17), ("a", 0, 1, [(1.0, 2.0, 0.1)] * 17), ("a", 0, 2, None)]
    df = spark.createDataFrame(rows, "clip string, idx long, slot int, kp array<struct<x:double,y:double,c:double>>")
    monkeypatch.setattr(K, "link", lambda points, *a: points)
    points = K.track_keypoints(df)
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(kp") == 1
    assert [tuple(r) for r in points.collect()] == [("a", 0, 0, 1.0, 2.0, 1.0, 2.0)]


def test_boxes_without_a_number_are_tracked(spark):
    rows = [("a", 0, None, 1.0), ("a", 0, 2**40 + 1, 900.0), ("a", 1, 7, 2.0)]
    df = spark.createDataFrame([(c, i, n, [(x, x, 0.9)] * 17) for c, i, n, x in rows], "clip string, idx long, slot long, kp array<struct<x:double,y:double,c:double>>")
    got = sorted(((r.idx, r.box_no, r.track) for r in K.track_keypoints(df, piece=10).collect()), key=repr)
    first = {n: t for _, n, t in got}
    assert [g[:2] for g in got] == [(0, 1099511627777), (0, None), (1, 7)] and first[7] == first[None] != first[2**40 + 1]
