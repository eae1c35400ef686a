"""Boxes, polygons and tiles as column expressions.

Corner boxes are ``struct<x1,y1,x2,y2>`` in pixels, label boxes are normalised
top-left ``x, y, w, h``; the two are never mixed in one column.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _clip01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Overlap over union, zero where the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def iou_soft(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    """Overlap over union with a small constant instead of the zero test."""
    inter = intersection(a, b)
    return inter / (area(a) + area(b) - inter + epsilon)


def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies inside ``b``."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def cover(a: Column, b: Column) -> Column:
    """The larger of the two containments."""
    return F.greatest(containment(a, b), containment(b, a))


def center_to_corner(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return cx - w / 2, cy - h / 2


def corner_to_center(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / 2, y + h / 2


def pixel_box_to_yolo(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel top-left box to a normalised centre box, every value clamped to 0..1."""
    return F.struct(
        _clip01((x + w / 2) / width).alias("cx"),
        _clip01((y + h / 2) / height).alias("cy"),
        _clip01(w / width).alias("w"),
        _clip01(h / height).alias("h"),
    )


def inside(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd test against ``array<struct<x,y>>``; fewer than three points hold nothing."""
    n = F.size(poly)
    # pair every corner with the next one, the last with the first
    following = F.concat(F.slice(poly, 2, F.greatest(n - 1, F.lit(0))), F.slice(poly, 1, 1))
    edges = F.zip_with(poly, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        straddles = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
        return straddles & (x < at)

    crossings = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False))))
    return F.coalesce((n >= 3) & (crossings % 2 == 1), F.lit(False))


def corners_inside(b: Column, poly: Column) -> Column:
    """How many of the four corners lie in the polygon."""
    points = [(b["x1"], b["y1"]), (b["x2"], b["y1"]), (b["x1"], b["y2"]), (b["x2"], b["y2"])]
    flags = [inside(px, py, poly).cast("int") for px, py in points]
    return flags[0] + flags[1] + flags[2] + flags[3]


def foot_inside(b: Column, poly: Column) -> Column:
    return inside((b["x1"] + b["x2"]) / 2, b["y2"], poly)


def body_inside(b: Column, poly: Column) -> Column:
    return corners_inside(b, poly) == 4


def entered(b: Column, poly: Column, corners: int) -> Column:
    """Foot point inside and at least ``corners`` corners inside (0: foot only)."""
    foot = foot_inside(b, poly)
    return foot if corners <= 0 else foot & (corners_inside(b, poly) >= corners)


def view_tiles(width: Column, height: Column) -> Column:
    """The six views of a frame: whole, four quarters, centre; with their offsets."""
    w2, h2 = F.floor(width / 2), F.floor(height / 2)
    w4, h4 = F.floor(width / 4), F.floor(height / 4)
    zero = F.lit(0)
    views = [
        ("full", zero, zero, width, height),
        ("q1", zero, zero, w2, h2),
        ("q2", w2, zero, w2, h2),
        ("q3", zero, h2, w2, h2),
        ("q4", w2, h2, w2, h2),
        ("center", w4, h4, w2, h2),
    ]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("tile"),
                F.lit(name).alias("view"),
                *[v.cast("int").alias(k) for k, v in zip(("ox", "oy", "tw", "th"), box)],
            )
            for i, (name, *box) in enumerate(views)
        ]
    )


def grid_tiles(width: Column, height: Column, grid: int, overlap: float) -> Column:
    """A ``grid`` x ``grid`` tiling whose tiles reach ``overlap`` into their neighbours."""
    tw, th = F.floor(width / grid), F.floor(height / grid)
    ox, oy = F.floor(tw * overlap), F.floor(th * overlap)

    def tile(i: Column) -> Column:
        gx, gy = i % grid, F.floor(i / grid)
        x0, y0 = F.greatest(F.lit(0), gx * tw - ox), F.greatest(F.lit(0), gy * th - oy)
        x1, y1 = F.least(width, (gx + 1) * tw + ox), F.least(height, (gy + 1) * th + oy)
        return F.struct(
            i.cast("int").alias("tile"),
            x0.cast("int").alias("ox"),
            y0.cast("int").alias("oy"),
            (x1 - x0).cast("int").alias("tw"),
            (y1 - y0).cast("int").alias("th"),
        )

    if grid <= 1:
        zero = F.lit(0)
        return F.array(
            F.struct(
                zero.alias("tile"), zero.alias("ox"), zero.alias("oy"),
                width.cast("int").alias("tw"), height.cast("int").alias("th"),
            )
        )
    return F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), tile)


def to_frame(b: Column, ox: Column, oy: Column) -> Column:
    """A box found inside a tile, moved back to frame coordinates."""
    return F.struct(
        (b["x1"] + ox).alias("x1"), (b["y1"] + oy).alias("y1"),
        (b["x2"] + ox).alias("x2"), (b["y2"] + oy).alias("y2"),
    )


def suppress(boxes: Column, overlaps, order=None) -> Column:
    """Greedy suppression inside one frame's box array, best confidence first.

    ``overlaps(kept, candidate)`` is the column predicate that drops a box.
    Equal confidences keep the array order.  Boxes of one frame are bounded by
    the detector, so this stays one expression per row: no shuffle, no Python.
    """
    order = order or (lambda b: -b["conf"])
    ranked = F.transform(
        F.array_sort(F.transform(boxes, lambda b, i: F.struct(order(b).alias("o"), i.alias("i"), b.alias("b")))),
        lambda e: e["b"],
    )
    return F.aggregate(
        ranked,
        F.slice(ranked, 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda k: overlaps(k, b)), kept).otherwise(
            F.concat(kept, F.array(b))
        ),
    )


def person_overlap(iou_limit: float = 0.5, contain_limit: float = 0.75):
    """Class-agnostic: same body twice, or a part inside a kept box."""
    return lambda k, b: (iou(b, k) >= iou_limit) | (containment(b, k) >= contain_limit)


def class_overlap(iou_limit: float = 0.5):
    """Per class, soft overlap."""
    return lambda k, b: (k["cls"] == b["cls"]) & (iou_soft(k, b) >= iou_limit)


def plain_overlap(iou_limit: float = 0.55, strict: bool = False):
    return lambda k, b: iou_soft(k, b) > iou_limit if strict else iou_soft(k, b) >= iou_limit


def cover_overlap(iou_limit: float = 0.4, cover_limit: float = 0.9):
    """Proposal boxes: overlap, or one mostly covered by the other."""
    return lambda k, b: (iou(b, k) >= iou_limit) | (cover(b, k) >= cover_limit)
