"""Registered queries over boxes, zones and tracks, and over detection quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..operators import detection, joins, marts, rules, suppression
from ..session import checkpoint, passing
from . import presets
from .inputs import (
    BOXES_SQL, DET_SQL, TRUTH_BOX_SQL, ZONE_TAG_SQL, boxes, contain_sql, detections, inside_sql, iou_sql,
    table, truth_boxes, zones,
)
from .registry import SQL, query
from .signal_queries import WIDTH_S


def located(spark, d) -> DataFrame:
    """Boxes with sample position, previous sample time and their clip's polygon."""
    ix = rules.with_previous_time(rules.index_samples(boxes(spark, d), seconds=WIDTH_S))
    return joins.zone_of_clip(ix, zones(spark), ["Loitering", "Intrusion"])


FLAGS_SQL = f"""{BOXES_SQL}, {ZONE_TAG_SQL},
flags AS (SELECT b.*, zt.tag AS zone_tag,
  {inside_sql('(b.x1 + b.x2) / 2', 'b.y2')} AS foot,
  {inside_sql('b.x1', 'b.y1')}::INT + {inside_sql('b.x2', 'b.y1')}::INT + {inside_sql('b.x1', 'b.y2')}::INT + {inside_sql('b.x2', 'b.y2')}::INT AS n_corners
  FROM bix b LEFT JOIN zt ON zt.loc = b.loc)"""


@query("box_in_zone", f"WITH {FLAGS_SQL} SELECT clip, idx, zone_tag AS tag, foot, CAST(n_corners AS INTEGER) AS corners, foot AND n_corners >= 3 AS entered, n_corners = 4 AS body FROM flags")
def box_in_zone(spark, d):
    b, poly = F.col("box"), F.col("poly")
    return located(spark, d).select(
        "clip", "idx", "tag", G.foot_inside(b, poly).alias("foot"), G.corners_inside(b, poly).alias("corners"),
        G.entered(b, poly, 3).alias("entered"), G.body_inside(b, poly).alias("body"),
    )


@query("zone_of_clip", f"""WITH {BOXES_SQL}, {ZONE_TAG_SQL} SELECT DISTINCT bx.clip, zt.tag,
  CAST((SELECT max(corners) FROM edges e WHERE e.loc = zt.loc AND e.tag = zt.tag) AS INTEGER) AS corners FROM bx LEFT JOIN zt USING (loc)""")
def zone_of_clip(spark, d):
    clips = boxes(spark, d).select("clip", "loc").distinct()
    z = joins.zone_of_clip(clips, zones(spark), ["Loitering", "Intrusion"])
    return z.select("clip", "tag", F.size("poly").alias("corners"))


SETTLE_SQL = """nx AS (SELECT *, lead(det_t) OVER (PARTITION BY clip ORDER BY det_t) AS next_at FROM times),
final AS (SELECT clip, min(det_t) AS stop FROM nx WHERE next_at IS NULL OR EXISTS (
   SELECT 1 FROM bix s WHERE s.clip = nx.clip AND s.t - nx.det_t >= {settle} AND s.t < nx.next_at AND s.t >= nx.det_t) GROUP BY clip),
alarms AS (SELECT times.clip, max(v) AS alarm FROM times JOIN final ON final.clip = times.clip AND det_t <= stop GROUP BY times.clip)"""


@query(
    "entrant_alarm",
    f"""WITH {FLAGS_SQL}, q AS (SELECT clip, track, idx, t FROM flags WHERE conf >= 0.25e0 AND foot),
    isl AS (SELECT *, idx - row_number() OVER (PARTITION BY clip, track ORDER BY idx) AS g FROM q),
    pos AS (SELECT *, row_number() OVER (PARTITION BY clip, track, g ORDER BY idx) AS p FROM isl),
    entry AS (SELECT clip, track, min(t) AS det_t FROM pos WHERE p = 2 GROUP BY clip, track),
    times AS (SELECT clip, det_t, max(det_t) AS v FROM entry GROUP BY clip, det_t), {SETTLE_SQL.format(settle=24)}
    SELECT * FROM alarms""",
)
def entrant_alarm(spark, d):
    loc = located(spark, d)
    q = loc.filter((F.col("conf") >= 0.25) & G.entered(F.col("box"), F.col("poly"), 0))
    return rules.entrant_alarm(q, loc, hold=2, settle_s=24.0)


@query(
    "dwell_alarm",
    f"""WITH {FLAGS_SQL}, q AS (SELECT clip, track, idx, t FROM flags WHERE conf >= 0.1e0 AND foot),
    st AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY clip, track ORDER BY idx) - 1 <= 6 THEN 0 ELSE 1 END AS s FROM q),
    isl AS (SELECT *, sum(s) OVER (PARTITION BY clip, track ORDER BY idx) AS g FROM st),
    pos AS (SELECT *, row_number() OVER (PARTITION BY clip, track, g ORDER BY idx) AS p, min(t) OVER (PARTITION BY clip, track, g) AS since FROM isl),
    det AS (SELECT clip, track, arg_min(since, idx) AS since, min(t) AS det_t FROM pos WHERE p * 0.5e0 >= 3 GROUP BY clip, track),
    times AS (SELECT clip, det_t, max(since) AS v FROM det GROUP BY clip, det_t), {SETTLE_SQL.format(settle=5)}
    SELECT clip, alarm + 10 AS alarm FROM alarms""",
)
def dwell_alarm(spark, d):
    loc = located(spark, d)
    q = loc.filter((F.col("conf") >= 0.1) & G.entered(F.col("box"), F.col("poly"), 0))
    return rules.dwell_alarm(q, loc, dwell_s=3.0, gap=6, settle_s=5.0, delay=10.0)


@query(
    "body_onset",
    f"""WITH {FLAGS_SQL}, fr AS (SELECT clip, idx, t, sum(h) OVER w AS c, min(CASE WHEN h = 1 THEN t END) OVER w AS o FROM
      (SELECT clip, idx, t, CASE WHEN conf >= 0.4e0 AND n_corners = 4 THEN 1 ELSE 0 END AS h FROM flags)
      WINDOW w AS (PARTITION BY clip ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT clip, arg_min(o, idx) AS onset FROM fr WHERE c >= 2 GROUP BY clip""",
)
def body_onset(spark, d):
    rule = presets.CERTIFIED["intrusion"]
    hits = located(spark, d).filter((F.col("conf") >= rule["conf"]) & G.body_inside(F.col("box"), F.col("poly")))
    return rules.n_of_m(hits, rule["hits"], rule["win"]).select("clip", "onset")


@query(
    "nearest_sample",
    f"""WITH {BOXES_SQL}, q AS (SELECT clip, event_id AS row_id, t + 0.35e0 AS t FROM bx WHERE track = 2),
    p AS (SELECT q.clip, row_id, q.t, s.t AS near_t, s.conf, row_number() OVER (PARTITION BY row_id ORDER BY abs(q.t - s.t), s.t) AS rn
      FROM q JOIN bx s ON s.clip = q.clip AND s.track = 1 AND abs(q.t - s.t) < 1)
    SELECT q.clip, q.row_id, q.t, near_t, p.conf FROM q LEFT JOIN (SELECT * FROM p WHERE rn = 1) p ON p.row_id = q.row_id""",
)
def nearest_sample(spark, d):
    b = boxes(spark, d)
    left = with_ids(spark, d).filter("track = 2").select("clip", "row_id", (F.col("t") + 0.35).alias("t"))
    right = b.filter("track = 1").select("clip", "t", "conf")
    return joins.nearest_within(left, right, ["conf"])


def with_ids(spark, d) -> DataFrame:
    from .inputs import EPOCH_MICROS, _ts_micros

    ev = table(spark, d, "events")
    return ev.select(
        F.col("user_id").alias("clip"), F.col("event_id").alias("row_id"),
        F.when(F.col("event_type").isin("click", "view", "error"), 1).otherwise(2).alias("track"),
        ((_ts_micros(ev) - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)).alias("t"), "event_type", "value", "props",
    )


@query(
    "nearest_frame",
    f"""WITH {BOXES_SQL}, q AS (SELECT clip, event_id AS row_id, t + 0.35e0 AS t FROM bx WHERE track = 2),
    p AS (SELECT q.clip, row_id, q.t, s.t AS near_t, row_number() OVER (PARTITION BY row_id ORDER BY abs(q.t - s.t), s.t) AS rn
      FROM q LEFT JOIN bx s ON s.clip = q.clip AND s.track = 1) SELECT clip, row_id, t, near_t FROM p WHERE rn = 1""",
)
def nearest_frame(spark, d):
    ev = with_ids(spark, d)
    left = ev.filter("track = 2").select("clip", "row_id", (F.col("t") + 0.35).alias("t"))
    return joins.nearest(left, ev.filter("track = 1").select("clip", "t"), seconds=WIDTH_S)


@query(
    "seed_segments",
    f"""WITH {BOXES_SQL}, s AS (SELECT clip, track AS obj, round_even(t * 2, 0) / 2 AS t, max(event_id) AS seed FROM bx WHERE conf > 0.5e0 GROUP BY ALL)
    SELECT clip, obj, t, seed, lead(t) OVER (PARTITION BY clip, obj ORDER BY t) AS until FROM s""",
)
def seed_segments(spark, d):
    from ..functions.timecode import snap

    ev = with_ids(spark, d).filter(F.get_json_object("props", "$.k").cast("double") / 100.0 > 0.5)
    seeds = ev.select("clip", F.col("track").alias("obj"), snap(F.col("t")).alias("t"), F.col("row_id").alias("seed"))
    return joins.seed_segments(seeds, seconds=WIDTH_S)


@query(
    "area_profile",
    f"""WITH {BOXES_SQL}, sd AS (SELECT clip, track AS obj, t, (x2 - x1) * y2 AS a FROM bx WHERE conf > 0.8e0),
    f AS (SELECT clip, track AS obj, event_id, t, (x2 - x1) * y2 * (0.1e0 + 4 * conf) AS area FROM bx WHERE conf <= 0.8e0),
    j AS (SELECT f.*, (SELECT max(t) FROM sd WHERE sd.clip = f.clip AND sd.obj = f.obj AND sd.t <= f.t) AS t0,
                 (SELECT min(t) FROM sd WHERE sd.clip = f.clip AND sd.obj = f.obj AND sd.t >= f.t) AS t1 FROM f),
    k AS (SELECT j.*, a.a AS a0, b.a AS a1 FROM j LEFT JOIN sd a ON a.clip = j.clip AND a.obj = j.obj AND a.t = j.t0
       LEFT JOIN sd b ON b.clip = j.clip AND b.obj = j.obj AND b.t = j.t1),
    e AS (SELECT *, CASE WHEN t0 IS NULL THEN a1 WHEN t1 IS NULL THEN a0 WHEN t1 > t0 THEN a0 + (a1 - a0) * ((t - t0) / (t1 - t0)) ELSE a0 END AS expected FROM k)
    SELECT clip, obj, event_id AS row_id, round_even(expected, 6) AS expected,
      CASE WHEN area = 0 THEN 'empty' WHEN area > 5000 OR area > 3 * coalesce(expected, area) OR area < coalesce(expected, area) / 3 THEN 'size' END AS dropped FROM e""",
)
def area_profile(spark, d):
    from ..operators.curation import drift_filter, expected_area

    ev = with_ids(spark, d)
    k = F.get_json_object("props", "$.k").cast("double") / 100.0
    base = ev.select("clip", F.col("track").alias("obj"), "row_id", "t", k.alias("conf"), (F.lit(10.0)).alias("w"), F.least("value", F.lit(100.0)).alias("h"))
    base = base.join(boxes_area(spark, d), "row_id")
    seeds = base.filter("conf > 0.8D").select("clip", "obj", "t", "area")
    frames = base.filter("conf <= 0.8D").select("clip", "obj", "row_id", "t", (F.col("area") * (0.1 + 4 * F.col("conf"))).alias("area"))
    out = drift_filter(expected_area(frames, seeds, seconds=WIDTH_S), frame_area=10000.0)
    return out.select("clip", "obj", "row_id", F.bround("expected", 6).alias("expected"), "dropped")


def boxes_area(spark, d) -> DataFrame:
    from .inputs import EPOCH_MICROS, _ts_micros

    ev = table(spark, d, "events")
    cx = F.pmod(_ts_micros(ev) - F.lit(EPOCH_MICROS), F.lit(86400000000)) / F.lit(8.64e8)
    return ev.select(F.col("event_id").alias("row_id"), (((cx + 5.0) - (cx - 5.0)) * F.least("value", F.lit(100.0))).alias("area"))


# ---- suppression and detection quality --------------------------------------------------


def nms_sql(overlap: str, extra: str = "") -> str:
    """Greedy suppression one rank at a time, with the kept boxes as a list."""
    return f"""WITH RECURSIVE {DET_SQL},
    rk AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, det_id) AS r,
             {{'det_id': det_id, 'cls': cls, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b FROM det),
    step(image, r, kept) AS (
      SELECT image, r, [b] FROM rk WHERE r = 1
      UNION ALL
      SELECT s.image, s.r + 1, CASE WHEN len(list_filter(s.kept, lambda k: {overlap})) > 0 THEN s.kept ELSE list_append(s.kept, n.b) END
      FROM step s JOIN rk n ON n.image = s.image AND n.r = s.r + 1),
    fin AS (SELECT image, arg_max(kept, r) AS kept FROM step GROUP BY image)
    SELECT image, CAST(len(kept) AS INTEGER) AS kept, CAST(list_sum(list_transform(kept, lambda k: k.det_id)) AS BIGINT) AS id_sum FROM fin"""


def kept_boxes(spark, d, overlap) -> DataFrame:
    det = detections(spark, d).select(
        "image", F.struct("det_id", "cls", "conf", "box.x1", "box.y1", "box.x2", "box.y2").alias("b")
    )
    return suppression.suppress_frames(det, ["image"], overlap, [F.desc("b.conf"), F.asc("b.det_id")])


def _kept(spark, d, overlap) -> DataFrame:
    return kept_boxes(spark, d, overlap).groupBy("image").agg(
        F.count(F.lit(1)).cast("int").alias("kept"), F.sum("b.det_id").alias("id_sum")
    )


@query("suppress_person", nms_sql(f"{iou_sql('n.b', 'k')} >= 0.5e0 OR {contain_sql('n.b', 'k')} >= 0.75e0"))
def suppress_person(spark, d):
    return _kept(spark, d, G.person_overlap())


@query("suppress_per_class", nms_sql(f"k.cls = n.b.cls AND {iou_sql('n.b', 'k', True)} >= 0.5e0"))
def suppress_per_class(spark, d):
    return _kept(spark, d, G.class_overlap())


@query("suppress_plain", nms_sql(f"{iou_sql('n.b', 'k', True)} >= 0.55e0"))
def suppress_plain(spark, d):
    return _kept(spark, d, G.plain_overlap())


@query("suppress_cover", nms_sql(f"{iou_sql('n.b', 'k')} >= 0.4e0 OR greatest({contain_sql('n.b', 'k')}, {contain_sql('k', 'n.b')}) >= 0.9e0"))
def suppress_cover(spark, d):
    return _kept(spark, d, G.cover_overlap())


MATCH_SQL = f"""{DET_SQL}, {TRUTH_BOX_SQL}, lv AS (SELECT unnest([0.5e0, 0.55e0, 0.6e0, 0.65e0, 0.7e0, 0.75e0, 0.8e0, 0.85e0, 0.9e0, 0.95e0]) AS level),
pr AS (SELECT d.image, d.cls, d.det_id, d.conf, t.truth_id, {iou_sql('d', 't')} AS iou FROM det d JOIN tru t USING (image, cls)),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, cls, det_id ORDER BY iou DESC, truth_id) AS r FROM pr WHERE iou >= 0.5e0) WHERE r = 1),
win AS (SELECT image, cls, level, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image, cls, truth_id, level ORDER BY conf DESC, det_id) AS w
   FROM bst JOIN lv ON iou >= level) WHERE w = 1),
jd AS (SELECT d.image, d.cls, d.det_id, d.conf, lv.level, w.det_id IS NOT NULL AS tp FROM det d CROSS JOIN lv
   LEFT JOIN win w ON w.image = d.image AND w.cls = d.cls AND w.det_id = d.det_id AND w.level = lv.level)"""


@query("match_counts", f"WITH {MATCH_SQL} SELECT cls, level, count(*) FILTER (tp) AS tp, count(*) FILTER (NOT tp) AS fp FROM jd GROUP BY cls, level")
def match_counts(spark, d):
    return detection.level_counts(detection.match(detections(spark, d), truth_boxes(spark, d), detection.IOU_LEVELS))


AP_SQL = f"""{MATCH_SQL}, n AS (SELECT cls, count(*) AS n FROM tru GROUP BY cls),
rn AS (SELECT cls, level, tp, row_number() OVER w AS pos, sum(tp::INT) OVER w AS ctp FROM jd WINDOW w AS (PARTITION BY cls, level ORDER BY conf DESC, image, det_id ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT cls, level, pos, CAST(ctp AS DOUBLE) / n AS r, CAST(ctp AS DOUBLE) / pos AS p FROM rn JOIN n USING (cls)
  UNION ALL SELECT DISTINCT cls, level, 0, 0e0, 1e0 FROM rn UNION ALL SELECT cls, level, max(pos) + 1, 1e0, 0e0 FROM rn GROUP BY cls, level),
env AS (SELECT cls, level, pos, r, max(p) OVER (PARTITION BY cls, level ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM pts),
seg AS (SELECT *, lead(r) OVER w AS r1, lead(p) OVER w AS p1 FROM env WINDOW w AS (PARTITION BY cls, level ORDER BY pos)),
crv AS (SELECT s.cls, s.level, x, CASE WHEN r1 IS NULL THEN p ELSE p + (p1 - p) * ((x / 100e0 - r) / (r1 - r)) END AS v
  FROM seg s JOIN (SELECT unnest(range(101)) AS x) g ON (x / 100e0 >= r OR x = 100) AND x / 100e0 >= r AND (r1 IS NULL OR x / 100e0 < r1)),
ap AS (SELECT cls, level, sum(v * CASE WHEN x IN (0, 100) THEN 0.5e0 ELSE 1 END) / 100 AS ap FROM crv GROUP BY cls, level)"""


@query("average_precision", f"WITH {AP_SQL} SELECT cls, round_even(max(CASE WHEN level = 0.5e0 THEN ap END), 6) AS map50, round_even(avg(ap), 6) AS map5095 FROM ap GROUP BY cls")
def average_precision(spark, d):
    t = truth_boxes(spark, d)
    return _rounded_precision(detection.match(detections(spark, d), t, detection.IOU_LEVELS), t)


def _rounded_precision(judged, truths, stored: bool = False) -> DataFrame:
    out = detection.detection_summary(detection.average_precision(judged, truths, stored=stored))
    return out.select("cls", F.bround("map50", 6).alias("map50"), F.bround("map5095", 6).alias("map5095"))


@query(
    "precision_recall",
    f"""WITH {MATCH_SQL}, n AS (SELECT cls, count(*) AS n FROM tru GROUP BY cls)
    SELECT jd.cls, count(*) FILTER (tp) / CAST(count(*) AS DOUBLE) AS precision, count(*) FILTER (tp) / CAST(n AS DOUBLE) AS recall
    FROM jd JOIN n USING (cls) WHERE level = 0.5e0 AND conf >= 0.25e0 GROUP BY jd.cls, n""",
)
def precision_recall(spark, d):
    t = truth_boxes(spark, d)
    return detection.precision_recall(detection.match(detections(spark, d), t), t, 0.25)


@query(
    "image_presence",
    f"""WITH {DET_SQL} SELECT image, bool_or(cls = 0) AS with_fire, bool_or(cls = 1) AS with_smoke, false AS negative,
      coalesce(min(CASE WHEN cls = 0 THEN (x2 - x1) / 1000 * ((y2 - y1) / 100) END) <= 0.01e0, false) AS small_fire FROM det GROUP BY image""",
)
def image_presence(spark, d):
    b = detections(spark, d).select("image", "cls", ((F.col("box.x2") - F.col("box.x1")) / 1000).alias("w"), ((F.col("box.y2") - F.col("box.y1")) / 100).alias("h"))
    return detection.image_presence(b)


@query(
    "image_alarm_metrics",
    f"""WITH {DET_SQL}, f AS (SELECT image, bool_or(cls = 0 AND det_id % 3 < 2) AS y, bool_or(conf >= 0.7e0) AS a FROM det GROUP BY image),
    c AS (SELECT count(*) FILTER (y AND a) AS tp, count(*) FILTER (NOT y AND a) AS fp, count(*) FILTER (y AND NOT a) AS fn, count(*) FILTER (NOT y AND NOT a) AS tn FROM f),
    q AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, CAST(fp AS DOUBLE) / (fp + tn) AS far FROM c)
    SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM q""",
)
def image_alarm_metrics(spark, d):
    from ..operators.scoring import image_metrics

    flags = detections(spark, d).groupBy("image").agg(
        F.bool_or((F.col("cls") == 0) & (F.col("det_id") % 3 < 2)).alias("positive"),
        F.bool_or(F.col("conf") >= 0.7).alias("alarmed"),
    )
    return image_metrics(flags)


@query(
    "view_tiles",
    """WITH f AS (SELECT l_orderkey AS image, 640 + max(l_linenumber) * 160 AS w, 480 + max(l_linenumber) * 90 AS h FROM lineitem GROUP BY l_orderkey)
    SELECT image, tile, CASE tile WHEN 0 THEN 0 WHEN 2 THEN w // 2 WHEN 4 THEN w // 2 WHEN 5 THEN w // 4 ELSE 0 END AS ox,
      CASE tile WHEN 3 THEN h // 2 WHEN 4 THEN h // 2 WHEN 5 THEN h // 4 ELSE 0 END AS oy,
      CASE tile WHEN 0 THEN w ELSE w // 2 END AS tw, CASE tile WHEN 0 THEN h ELSE h // 2 END AS th
    FROM f, (SELECT unnest(range(6))::INT AS tile)""",
)
def view_tiles(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.max("l_linenumber").alias("m"))
    return f.select("image", F.inline(G.view_tiles(640 + F.col("m") * 160, 480 + F.col("m") * 90))).drop("view")


@query(
    "grid_tile_boxes",
    f"""WITH {DET_SQL}, g AS (SELECT det.*, CAST(det_id % 9 AS INTEGER) AS tile FROM det),
    o AS (SELECT g.*, greatest(0, (tile % 3) * 426 - 85) AS ox, greatest(0, (tile // 3) * 240 - 48) AS oy FROM g)
    SELECT image, det_id, tile, x1 + ox AS x1, y1 + oy AS y1, x2 + ox AS x2, y2 + oy AS y2 FROM o""",
)
def grid_tile_boxes(spark, d):
    """Detections made inside tiles, joined to the tiling of their frame size and moved back."""
    det = detections(spark, d).withColumn("tile", (F.col("det_id") % 9).cast("int"))
    tiles = spark.range(1).select(F.inline(G.grid_tiles(F.lit(1280), F.lit(720), 3, 0.2)))
    moved = det.join(F.broadcast(tiles), "tile").withColumn("b", G.to_frame(F.col("box"), F.col("ox"), F.col("oy")))
    return moved.select("image", "det_id", "tile", "b.x1", "b.y1", "b.x2", "b.y2")


@query(
    "view_features",
    f"""WITH {DET_SQL}, v AS (SELECT *, det_id % 6 AS vw FROM det)
    SELECT image, {', '.join(f"coalesce(max(CASE WHEN cls = 0 AND vw = {i} THEN conf END), 0e0) AS fire{i}" for i in range(6))},
      {', '.join(f"coalesce(max(CASE WHEN cls = 1 AND vw = {i} THEN conf END), 0e0) AS smoke{i}" for i in range(6))},
      coalesce(max(CASE WHEN cls = 0 THEN conf END), 0e0) AS best FROM v GROUP BY image""",
)
def view_features(spark, d):
    from ..operators.features import view_features as features

    det = detections(spark, d).select(
        "image", "cls", "conf", (F.col("det_id") % 6).alias("view"),
        F.col("box.x1").alias("cx"), F.col("box.y1").alias("cy"), F.col("box.x2").alias("w"), F.col("box.y2").alias("h"),
    )
    out = features(det, ["image"])
    return out.withColumn("best", F.greatest(*[F.col(f"fire{i}") for i in range(6)])).drop("best_cx", "best_cy", "best_w", "best_h")


@query(
    "long_tracks",
    """WITH t AS (SELECT user_id AS clip, event_type AS track, count(*) AS samples FROM events GROUP BY ALL HAVING count(*) >= 6)
    SELECT e.user_id AS clip, e.event_type AS track, samples, e.event_id FROM events e JOIN t ON t.clip = e.user_id AND t.track = e.event_type""",
)
def long_tracks(spark, d):
    from ..operators.curation import long_lived

    ev = table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_type").alias("track"), "event_id")
    return long_lived(ev, ["clip", "track"], 6)


@query(
    "top_people_per_frame",
    f"WITH {DET_SQL} SELECT image, det_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, det_id) AS rank FROM det) WHERE rank <= 5",
)
def top_people_per_frame(spark, d):
    from ..operators.ordered import top_per_group

    det = detections(spark, d).select("image", "det_id", "conf")
    return top_per_group(det, ["image"], [F.desc("conf"), F.asc("det_id")], 5).select("image", "det_id", "rank")


# ---- tracking (sequential: no SQL form; tests compare with a plain loop) -------------------


def tracked_frames(spark, d) -> DataFrame:
    """Suppressed boxes of ten long clips: consecutive orders are consecutive samples."""
    kept = kept_boxes(spark, d, G.person_overlap())
    px = lambda c: F.col(f"b.{c}") * 12.0
    return kept.select(
        (F.col("image") % 10).alias("clip"), F.floor(F.col("image") / 10).alias("idx"), F.col("b.det_id").alias("box_no"),
        F.col("b.conf").alias("conf"), *[px(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
    )


@query("track_people")
def track_people(spark, d):
    from ..operators.tracking import track_people as link

    return link(tracked_frames(spark, d))


@query("track_keypoints")
def track_keypoints(spark, d):
    from ..operators.tracking import track_keypoints as link
    from .feature_queries import keypoints

    kp = keypoints(spark, d)
    people = kp.select((F.col("image") % 10).alias("clip"), F.floor(F.col("image") / 10).alias("idx"), "slot", "kp")
    return link(people)


def _cells_sql(source: str, section: str, name: str, metrics) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, '{m}' AS metric, round_even(CAST({m} AS DOUBLE), 6) AS value FROM {source}" for m in metrics)


GROUP_BOXES = 50_000_000  # boxes whose images are matched at once: what the matching writes does not grow with the input


@query(
    "evaluation_table",
    f"""WITH ap_rows AS ({SQL['average_precision']}), pr_rows AS ({SQL['precision_recall']}), alarm_rows AS ({SQL['image_alarm_metrics']}), by_class AS (SELECT * FROM ap_rows JOIN pr_rows USING (cls))
    {_cells_sql('by_class', 'class', 'CAST(cls AS VARCHAR)', ('map50', 'map5095', 'precision', 'recall'))}
    UNION ALL {_cells_sql('alarm_rows', 'alarm', "'images'", ('tp', 'fp', 'fn', 'tn', 'precision', 'recall', 'f1', 'far'))}""",
)
def evaluation_table(spark, d):
    """Everything an evaluation report shows, as one table."""
    boxes_, t = detections(spark, d), truth_boxes(spark, d)
    groups = max(1, -(-boxes_.count() // GROUP_BOXES))
    part = lambda df, g: df.filter(F.pmod(F.xxhash64("image"), F.lit(groups)) == g)

    def matched(g: int) -> DataFrame:
        return detection.match(part(boxes_, g), part(t, g), detection.IOU_LEVELS).select("image", "cls", "det_id", "conf", "hits")

    with passing(spark) as store:
        judged = reduce(DataFrame.unionByName, [store(matched(g)) for g in range(groups)])
        per_class = checkpoint(_rounded_precision(judged, t, stored=True).join(detection.precision_recall(judged, t, 0.25), "cls"))
    table_ = marts.evaluation_table(per_class, image_alarm_metrics(spark, d))
    return table_.withColumn("value", F.bround("value", 6))
