"""Posture and pose features from 17 keypoints, ``array<struct<x,y,c>>``.

All expressions use higher-order functions on the row, so a pose table is
turned into feature vectors without a shuffle and without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: keypoint positions in the 17-point layout
NOSE = 1
SHOULDERS = (6, 7)
HIPS = (12, 13)
ANKLES = (16, 17)
SEEN = 0.2


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, however often that uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _pair(kp: Column, points: tuple[int, int], axis: str, seen: float, strict: bool = False) -> Column:
    """Mean of the visible points of a pair, NULL when neither is visible."""
    a, b = (F.element_at(kp, i) for i in points)
    ok = lambda p: p["c"] > seen if strict else p["c"] >= seen
    value = lambda p: F.when(ok(p), p[axis].cast("double")).otherwise(0.0)
    n = ok(a).cast("int") + ok(b).cast("int")
    return (value(a) + value(b)) / F.nullif(n, F.lit(0))


def _mean(points: Column, axis: str) -> Column:
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[axis].cast("double"))
    return F.try_divide(total, F.size(points))


def torso_angle(kp: Column, seen: float = SEEN, strict: bool = False) -> Column:
    """Degrees between the torso and the horizontal, NULL without both ends."""
    end = lambda pair, axis: _pair(kp, pair, axis, seen, strict)
    dy, dx = end(HIPS, "y") - end(SHOULDERS, "y"), end(HIPS, "x") - end(SHOULDERS, "x")
    a = F.abs(F.degrees(F.atan2(dy, dx)))
    return F.least(a, 180 - a)


def lying(kp: Column, w: Column, h: Column) -> Column:
    """Fallen: torso closer to the horizontal than 45 degrees, or a wide box."""
    return F.coalesce(torso_angle(kp) < 45, F.lit(False)) | (w >= h)


def neck_height(kp: Column, frame_h: Column, seen: float = SEEN) -> Column:
    return F.coalesce(_pair(kp, SHOULDERS, "y", seen) / frame_h, F.lit(0.0))


def visibility(c: Column) -> Column:
    return F.when(c > 0.5, 2).when(c > 0.2, 1).otherwise(0)


def center(kp: Column, seen: float = SEEN) -> Column:
    """Mean of the visible keypoints, NULL when none is."""
    ok = F.filter(kp, lambda p: p["c"] >= seen)
    mean = lambda o: F.when(F.size(o) > 0, F.struct(_mean(o, "x").alias("x"), _mean(o, "y").alias("y")))
    return _let(ok, mean)


def _flat(kp: Column, frame_w: Column, frame_h: Column) -> Column:
    return F.flatten(
        F.transform(kp, lambda p: F.array(p["x"] / frame_w, p["y"] / frame_h, p["c"].cast("double")))
    )


def pose_features(
    kp: Column, conf: Column, x1: Column, y1: Column, x2: Column, y2: Column, frame_w: Column, frame_h: Column
) -> Column:
    """The 59-value vector: 8 box and posture values, then 17 x (x, y, c)."""
    w, h = x2 - x1, y2 - y1
    base = F.array(
        conf.cast("double"),
        (x1 + x2) / 2 / frame_w,
        (y1 + y2) / 2 / frame_h,
        w / frame_w,
        h / frame_h,
        w / F.greatest(F.lit(1.0), h),
        F.coalesce(torso_angle(kp), F.lit(90.0)) / 90.0,
        neck_height(kp, frame_h),
    )
    return F.concat(base, _flat(kp, frame_w, frame_h)).cast("array<float>")


def pose_features_from_points(kp: Column, frame_w: Column, frame_h: Column) -> Column:
    """The same vector when only keypoints exist: the box spans the visible ones."""
    seen = F.filter(kp, lambda p: p["c"] >= SEEN)

    def full(ok: Column) -> Column:
        axis = lambda name: F.transform(ok, lambda p: p[name].cast("double"))
        edges = F.struct(
            F.array_min(axis("x")).alias("x1"), F.array_min(axis("y")).alias("y1"),
            F.array_max(axis("x")).alias("x2"), F.array_max(axis("y")).alias("y2"),
        )

        def base(b: Column) -> Column:
            w, h = F.greatest(b["x2"] - b["x1"], F.lit(1.0)), F.greatest(b["y2"] - b["y1"], F.lit(1.0))
            return F.array(
                _mean(ok, "c"), (b["x1"] + b["x2"]) / 2 / frame_w, (b["y1"] + b["y2"]) / 2 / frame_h,
                w / frame_w, h / frame_h, w / h,
                F.coalesce(torso_angle(kp), F.lit(90.0)) / 90.0, neck_height(kp, frame_h),
            )

        vector = F.concat(_let(edges, base), _flat(kp, frame_w, frame_h))
        return F.when(F.size(ok) > 0, vector).otherwise(F.array_repeat(F.lit(0.0), 59))

    return _let(seen, full).cast("array<float>")


def physical_features(kp: Column, frame_w: Column, frame_h: Column) -> Column:
    """13 physical values per person; all zero with fewer than four points above 0.1."""
    seen = 0.1
    fw, fh = F.greatest(frame_w, F.lit(1)), F.greatest(frame_h, F.lit(1))
    unit = F.transform(
        kp,
        lambda p: F.struct(
            (p["x"] / fw).alias("x"), (p["y"] / fh).alias("y"), p["c"].cast("double").alias("c")
        ),
    )

    def parts(u: Column) -> Column:
        ok = F.filter(u, lambda p: p["c"] > seen)
        nose = F.element_at(u, NOSE)
        return _let(
            ok,
            lambda o: F.struct(
                F.size(o).alias("n"), _mean(o, "c").alias("conf"),
                F.array_min(F.transform(o, lambda p: p["x"])).alias("x1"), F.array_max(F.transform(o, lambda p: p["x"])).alias("x2"),
                F.array_min(F.transform(o, lambda p: p["y"])).alias("y1"), F.array_max(F.transform(o, lambda p: p["y"])).alias("y2"),
                F.coalesce(torso_angle(u, seen, True), F.lit(90.0)).alias("angle"),
                F.when(nose["c"] > seen, nose["y"]).alias("nose"),
                _pair(u, SHOULDERS, "y", seen, True).alias("neck"), _pair(u, ANKLES, "y", seen, True).alias("foot"),
            ),
        )

    def vector(f: Column) -> Column:
        w, h = F.greatest(f["x2"] - f["x1"], F.lit(1e-4)), F.greatest(f["y2"] - f["y1"], F.lit(1e-4))
        nose, foot = F.coalesce(f["nose"], f["neck"], F.lit(0.0)), F.coalesce(f["foot"], f["y2"])
        full = F.array(
            F.lit(1.0), f["conf"], f["n"] / F.size(kp), w, h, w / h, f["angle"] / 90.0, nose, foot, nose - foot,
            (f["y1"] + f["y2"]) / 2, (f["x1"] + f["x2"]) / 2, h * w,
        )
        return F.when(f["n"] >= 4, full).otherwise(F.array_repeat(F.lit(0.0), 13))

    return _let(_let(unit, parts), vector)
