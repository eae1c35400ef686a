"""Registered queries for window features, poses and the onset classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K, pose as P, signals as S, timecode as T
from ..operators import classifier, features as X, joins, rules, sweep
from ..session import checkpoint
from .inputs import INDEXED_SQL, SIGNAL_SQL, TRUTH_SQL, signal, table, truth
from .registry import query
from .signal_queries import CURVE_SQL, WIDTH_S, curves, indexed


def _r(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in cols})


TRAIL = "WINDOW w AS (PARTITION BY clip ORDER BY idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


def _trail_cols(v: str) -> str:
    return (
        f"max({v}) OVER w AS {v}_max, round_even(avg({v}) OVER w, 6) AS {v}_mean, round_even(stddev_pop({v}) OVER w, 6) AS {v}_std, "
        f"round_even(sum(CASE WHEN {v} >= 0.4e0 THEN 1e0 ELSE 0e0 END) OVER w / count(*) OVER w, 6) AS {v}_share, {v} AS {v}_last, round_even({v} - first_value({v}) OVER w, 6) AS {v}_rise"
    )


@query("trailing_summary", f"WITH {INDEXED_SQL} SELECT clip, idx, {_trail_cols('fire')}, {_trail_cols('smoke')}, count(*) OVER w AS n FROM six {TRAIL}")
def trailing_summary(spark, d):
    t = X.trailing_summary(indexed(spark, d))
    cols = [f"{v}_{s}" for v in ("fire", "smoke") for s in ("max", "mean", "std", "share", "last", "rise")]
    t = _r(t, 6, *[c for c in cols if c.rsplit("_", 1)[1] in ("mean", "std", "share", "rise")])
    return t.select("clip", "idx", *cols, "n")


@query(
    "onset_labels",
    f"""WITH {SIGNAL_SQL}, {TRUTH_SQL} SELECT clip, count(*) AS samples, count(*) FILTER (start_s IS NOT NULL AND t + 10 >= start_s - 2 AND t + 10 <= start_s + 10) AS positives
    FROM sig JOIN gt USING (clip) GROUP BY clip""",
)
def onset_labels(spark, d):
    s = joins.with_truth(signal(spark, d), truth(spark, d))
    y = s.select("clip", X.onset_label(F.col("t"), F.col("start_s")).alias("y"))
    return y.groupBy("clip").agg(F.count(F.lit(1)).alias("samples"), F.sum("y").cast("long").alias("positives"))


def with_events(spark, d) -> DataFrame:
    gt = truth(spark, d).withColumn("dur_s", F.when(F.col("clip") % 3 == 0, 2.0).otherwise(40.0))
    return indexed(spark, d).join(gt, "clip", "left")


LABEL_SQL = """CASE WHEN start_s IS NULL THEN 0
  WHEN greatest(0e0, least(t1, start_s + dur) - greatest(t0, start_s)) / (t1 - t0 + 1e-6) >= 0.5e0 THEN 1
  WHEN greatest(0e0, least(t1, start_s + dur) - greatest(t0, start_s)) = 0 THEN 0 END"""
EVENT_SQL = f"{INDEXED_SQL}, {TRUTH_SQL}, ge AS (SELECT *, greatest(CASE WHEN clip % 3 = 0 THEN 2e0 ELSE 40e0 END, 5e0) AS dur FROM gt)"


@query(
    "training_windows",
    f"""WITH {EVENT_SQL}, w AS (SELECT six.clip, idx, start_s, dur, count(*) OVER w AS n, min(t) OVER w AS t0, max(t) OVER w AS t1, sum(fire) OVER w AS s
      FROM six LEFT JOIN ge ON ge.clip = six.clip WINDOW w AS (PARTITION BY six.clip ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, {LABEL_SQL} AS label FROM w WHERE n = 20)
    SELECT clip, idx AS end_idx, t0, t1, CAST(label AS INTEGER) AS label, round_even(s, 6) AS fire_sum FROM l WHERE label IS NOT NULL""",
)
def training_windows(spark, d):
    w = X.training_windows(with_events(spark, d), ["fire"])
    return w.select("clip", "end_idx", "t0", "t1", "label", F.bround(F.aggregate("fire_seq", F.lit(0.0), lambda a, v: a + v), 6).alias("fire_sum"))


@query(
    "strided_windows",
    f"""WITH {EVENT_SQL}, w AS (SELECT six.clip, idx, start_s, count(*) OVER w AS n, t AS t0, max(t) OVER w AS t1
      FROM six LEFT JOIN ge ON ge.clip = six.clip WINDOW w AS (PARTITION BY six.clip ORDER BY idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))
    SELECT clip, idx AS start_idx, t0, t1, CASE WHEN t1 >= start_s - 2 AND t1 <= start_s + 10 THEN 1 ELSE 0 END AS label FROM w WHERE n = 20 AND idx % 4 = 0""",
)
def strided_windows(spark, d):
    return X.strided_windows(with_events(spark, d), ["fire"], 20, 4).drop("fire_seq")


@query(
    "strided_overlap_windows",
    f"""WITH {EVENT_SQL}, w AS (SELECT six.clip, idx, start_s, dur, count(*) OVER w AS n, t AS t0, max(t) OVER w AS t1
      FROM six LEFT JOIN ge ON ge.clip = six.clip WINDOW w AS (PARTITION BY six.clip ORDER BY idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)), l AS (SELECT *, {LABEL_SQL} AS label FROM w WHERE n = 16 AND idx % 5 = 0)
    SELECT clip, idx AS start_idx, t0, t1, CAST(label AS INTEGER) AS label FROM l WHERE label IS NOT NULL""",
)
def strided_overlap_windows(spark, d):
    return X.strided_windows(with_events(spark, d), ["fire"], 16, 5, "overlap").drop("fire_seq")


@query(
    "window_overlap",
    f"""WITH {EVENT_SQL} SELECT six.clip, idx, greatest(0e0, least(t + 8, start_s + dur) - greatest(t, start_s)) AS overlap FROM six JOIN ge ON ge.clip = six.clip WHERE start_s IS NOT NULL""",
)
def window_overlap(spark, d):
    e = with_events(spark, d).filter(F.col("start_s").isNotNull())
    end = F.col("start_s") + F.greatest("dur_s", F.lit(5.0))
    return e.select("clip", "idx", X.overlap_seconds(F.col("t"), F.col("t") + 8, F.col("start_s"), end).alias("overlap"))


TRACK_AXIS_SQL = f"""{INDEXED_SQL}, tr AS (SELECT user_id AS clip, event_type AS track, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 3.6e9 AS t, value FROM events),
tx AS (SELECT tr.*, six.idx FROM tr JOIN six ON six.clip = tr.clip AND six.t = tr.t),
k AS (SELECT clip, track, idx // 5 AS slot, arg_min(value, idx) AS value FROM tx GROUP BY ALL),
ax AS (SELECT clip, idx // 5 AS slot, t FROM six WHERE idx % 5 = 0), nm AS (SELECT DISTINCT clip, track FROM tx)
"""


@query(
    "resample_tracks",
    f"""WITH {TRACK_AXIS_SQL} SELECT ax.clip, nm.track, ax.slot, ax.t, k.value IS NOT NULL AS present, coalesce(k.value, 0e0) AS value
    FROM ax JOIN nm ON nm.clip = ax.clip LEFT JOIN k ON k.clip = ax.clip AND k.track = nm.track AND k.slot = ax.slot""",
)
def resample_tracks(spark, d):
    s = rules.index_samples(_tracked(spark, d), seconds=WIDTH_S)
    return X.resample(s, s.select("clip", "idx", "t"), 5, ["value"]).na.fill(0.0, ["value"])


def _tracked(spark, d) -> DataFrame:
    from .inputs import EPOCH_MICROS, _ts_micros

    ev = table(spark, d, "events")
    return ev.select(F.col("user_id").alias("clip"), F.col("event_type").alias("track"), ((_ts_micros(ev) - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)).alias("t"), "value")


@query("lag_difference", f"WITH {INDEXED_SQL} SELECT clip, idx, fire - lag(fire, 2) OVER (PARTITION BY clip ORDER BY idx) AS growth FROM six")
def lag_difference(spark, d):
    return X.lag_difference(indexed(spark, d), "fire", 2, "growth").select("clip", "idx", "growth")


@query(
    "main_track",
    f"""WITH {TRUTH_SQL}, tr AS (SELECT user_id AS clip, event_type AS track, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 3.6e9 AS t, value FROM events),
    w AS (SELECT clip, track, avg(value) * count(*) AS weight FROM tr JOIN gt USING (clip) WHERE t >= start_s AND t <= start_s + 40 GROUP BY ALL)
    SELECT clip, arg_max(track, weight) AS main_track, round_even(max(weight), 6) AS weight FROM w GROUP BY clip""",
)
def main_track(spark, d):
    t = joins.with_truth(_tracked(spark, d), truth(spark, d)).withColumn("dur_s", F.lit(40.0))
    p = t.withColumn("present", F.lit(True)).withColumnRenamed("value", "conf")
    return _r(X.main_track(p), 6, "weight")


# ---- poses -----------------------------------------------------------------------------------


def keypoints(spark, d) -> DataFrame:
    """17 keypoints per order line, by integer arithmetic; some points are unseen."""
    li = table(spark, d, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    point = lambda i: F.struct(
        ((p * (i + 3)) % 640).cast("double").alias("x"), ((s * (i + 7) + p) % 480).cast("double").alias("y"),
        ((p + s * (i + 1)) % 10 / 10.0).alias("c"),
    )
    # one lambda: 17 structs written out are a method too long for the JVM to compile
    kp = F.transform(F.array(*[F.lit(i) for i in range(17)]), point)
    return li.select(
        F.col("l_orderkey").alias("image"), (((p * 10000 + s % 10000) * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("long")).alias("slot"), kp.alias("kp"), ((p % 100) / 100.0).alias("conf"),
        (p % 200).cast("double").alias("x1"), (s % 100).cast("double").alias("y1"), (p % 200 + F.col("l_quantity")).alias("x2"), (s % 100 + 25).cast("double").alias("y2"),
    )


def _kp(i: str) -> str:
    return f"CAST((p * (({i}) + 3)) % 640 AS DOUBLE), CAST((s * (({i}) + 7) + p) % 480 AS DOUBLE), CAST((p + s * (({i}) + 1)) % 10 AS DOUBLE) / 10"


KP_SQL = f"""lk AS (SELECT l_orderkey AS image, ((l_partkey * 10000 + l_suppkey % 10000) * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT) AS slot, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem),
kpt AS (SELECT image, slot, p, s, q, i, CAST((p * (i + 3)) % 640 AS DOUBLE) AS x, CAST((s * (i + 7) + p) % 480 AS DOUBLE) AS y, CAST((p + s * (i + 1)) % 10 AS DOUBLE) / 10 AS c
  FROM lk, (SELECT unnest(range(17)) AS i)),
an AS (SELECT image, slot, avg(x) FILTER (i IN (5, 6) AND c >= 0.2e0) AS sx, avg(y) FILTER (i IN (5, 6) AND c >= 0.2e0) AS sy,
  avg(x) FILTER (i IN (11, 12) AND c >= 0.2e0) AS hx, avg(y) FILTER (i IN (11, 12) AND c >= 0.2e0) AS hy, any_value(p) AS p, any_value(s) AS s, any_value(q) AS q,
  min(x) FILTER (c >= 0.2e0) AS mx1, max(x) FILTER (c >= 0.2e0) AS mx2, min(y) FILTER (c >= 0.2e0) AS my1, max(y) FILTER (c >= 0.2e0) AS my2, avg(c) FILTER (c >= 0.2e0) AS mc, flatten(list([x / 640, y / 480, c] ORDER BY i)) AS flat
  FROM kpt GROUP BY image, slot),
ag AS (SELECT *, abs(degrees(atan2(hy - sy, hx - sx))) AS a FROM an), ang AS (SELECT *, least(a, 180 - a) AS angle FROM ag)"""


@query("posture", f"WITH {KP_SQL} SELECT image, slot, round_even(angle, 6) AS angle, coalesce(angle < 45, false) OR q >= 25 AS lying FROM ang")
def posture(spark, d):
    k = keypoints(spark, d)
    return k.select(
        "image", "slot", F.bround(P.torso_angle(F.col("kp")), 6).alias("angle"),
        P.lying(F.col("kp"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("lying"),
    )


def _whole(v: Column, digits: int) -> Column:
    """A vector with every value rounded."""
    return F.transform(v, lambda x: F.bround(x.cast("double"), digits))


def _rounded(v: Column, digits: int) -> Column:
    """``_whole`` for a vector of floats, on arrays.

    A float shifted by up to eight digits is still exact as a double, so this
    equals ``bround``, which takes each value through a decimal text.
    """
    shift = 10.0**digits

    @F.arrow_udf("array<double>")
    def rounded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            x = v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            values = pa.array(np.rint(x * shift) / shift + 0.0, mask=np.asarray(v.values.is_null()))
            yield pa.ListArray.from_arrays(v.offsets, values, mask=v.is_null())

    return rounded(v)


def _whole_sql(values: str, digits: int) -> str:
    return f"list_transform({values}, lambda z: round_even(CAST(CAST(z AS FLOAT) AS DOUBLE), {digits}))"


@query(
    "pose_features_59",
    f"""WITH {KP_SQL} SELECT image, slot, {_whole_sql("""list_concat([p % 100 / 100e0, (p % 200 + p % 200 + q) / 2 / 640e0, (s % 100 + s % 100 + 25) / 2e0 / 480e0,
      q / 640e0, 25 / 480e0, q / 25e0, coalesce(angle, 90e0) / 90, coalesce(sy / 480, 0e0)], flat)""", 4)} AS v FROM ang""",
)
def pose_features_59(spark, d):
    k = keypoints(spark, d)
    v = P.pose_features(F.col("kp"), F.col("conf"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(640.0), F.lit(480.0))
    return k.select("image", "slot", _rounded(v, 4).alias("v"))


@query(
    "pose_features_from_points",
    f"""WITH {KP_SQL}, e AS (SELECT *, greatest(mx2 - mx1, 1e0) AS w, greatest(my2 - my1, 1e0) AS h FROM ang)
    SELECT image, slot, CASE WHEN mc IS NULL THEN list_transform(range(59), lambda z: 0e0) ELSE {_whole_sql("""list_concat([mc, (mx1 + mx2) / 2 / 640, (my1 + my2) / 2 / 480, w / 640, h / 480, w / h,
      coalesce(angle, 90e0) / 90, coalesce(sy / 480, 0e0)], flat)""", 4)} END AS v FROM e""",
)
def pose_features_from_points(spark, d):
    v = P.pose_features_from_points(F.col("kp"), F.lit(640.0), F.lit(480.0))
    return keypoints(spark, d).select("image", "slot", _whole(v, 4).alias("v"))


PHYSICAL_SQL = f"""{KP_SQL}, seen AS (SELECT image, slot, count(*) FILTER (c > 0.1e0) AS n, avg(c) FILTER (c > 0.1e0) AS mc,
  min(x) FILTER (c > 0.1e0) / 640 AS x1, max(x) FILTER (c > 0.1e0) / 640 AS x2, min(y) FILTER (c > 0.1e0) / 480 AS y1, max(y) FILTER (c > 0.1e0) / 480 AS y2,
  max(y) FILTER (c > 0.1e0 AND i = 0) / 480 AS ny, avg(x / 640) FILTER (c > 0.1e0 AND i IN (5, 6)) AS sx, avg(y / 480) FILTER (c > 0.1e0 AND i IN (5, 6)) AS sy,
  avg(x / 640) FILTER (c > 0.1e0 AND i IN (11, 12)) AS hx, avg(y / 480) FILTER (c > 0.1e0 AND i IN (11, 12)) AS hy, avg(y / 480) FILTER (c > 0.1e0 AND i IN (15, 16)) AS fy
  FROM kpt GROUP BY image, slot),
ends AS (SELECT *, abs(degrees(atan2(hy - sy, hx - sx))) AS a, greatest(x2 - x1, 1e-4) AS w, greatest(y2 - y1, 1e-4) AS h, coalesce(ny, sy, 0e0) AS nose, coalesce(fy, y2) AS foot FROM seen),
phys AS (SELECT image, slot, CASE WHEN n >= 4 THEN [1e0, mc, n / 17e0, w, h, w / h, coalesce(least(a, 180 - a), 90e0) / 90, nose, foot, nose - foot, (y1 + y2) / 2, (x1 + x2) / 2, h * w]
  ELSE list_transform(range(13), lambda z: 0e0) END AS v FROM ends)"""


# the last value is an area in whole 1 / 307,200: divided by a prime over 100,000 it never lies on the border of rounding
@query("physical_features_13", f"WITH {PHYSICAL_SQL} SELECT image, slot, list_transform(v, lambda z, i: round_even(CASE WHEN i = 13 THEN z / 3.14159e0 ELSE z END, 9)) AS v FROM phys")
def physical_features_13(spark, d):
    v = P.physical_features(F.col("kp"), F.lit(640.0), F.lit(480.0))
    shown = F.transform(v, lambda x, i: F.bround(F.when(i == 12, x / F.lit(3.14159)).otherwise(x), 9))
    return keypoints(spark, d).select("image", "slot", shown.alias("v"))


@query(
    "person_summary",
    f"""WITH {PHYSICAL_SQL} SELECT image, {', '.join(f"round_even(max(v[{i + 1}]) / 3.14159e0, 9) AS max{i}, round_even(sum(v[{i + 1}]) / 20 / 3.14159e0, 9) + 0e0 AS mean{i}" for i in range(13))}, sum(v[1]) AS valid
    FROM phys GROUP BY image""",
)
def person_summary(spark, d):
    f = keypoints(spark, d).select("image", P.physical_features(F.col("kp"), F.lit(640.0), F.lit(480.0)).alias("v"))
    s = X.person_summary(f, ["image"], "v", 13, 20)
    return s.withColumns({c: F.bround(F.col(c) / 3.14159, 9) for kind in ("max", "mean") for i in range(13) if (c := f"{kind}{i}")})


@query("keypoint_visibility", f"WITH {KP_SQL} SELECT image, slot, CAST(sum(CASE WHEN c > 0.5e0 THEN 2 WHEN c > 0.2e0 THEN 1 ELSE 0 END) AS INTEGER) AS visible, round_even(avg(x) FILTER (c >= 0.2e0), 6) AS cx FROM kpt GROUP BY image, slot")
def keypoint_visibility(spark, d):
    k = keypoints(spark, d)
    vis = F.aggregate("kp", F.lit(0), lambda a, p: a + P.visibility(p["c"]))
    return k.select("image", "slot", vis.alias("visible"), F.bround(P.center(F.col("kp"))["x"], 6).alias("cx"))


# ---- small functions over whole tables ------------------------------------------------------------


@query(
    "clock_texts",
    """WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 7 AS sec FROM orders), r AS (SELECT *, CAST(round_even(sec, 0) AS BIGINT) AS w FROM s)
    SELECT o_orderkey, lpad(CAST(w // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(w % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(w % 60 AS VARCHAR), 2, '0') AS clock, CAST(w AS INTEGER) AS back, CAST(round_even(sec * 2, 0) AS INTEGER) AS tick FROM r""",
)
def clock_texts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 7).alias("sec"))
    c = T.hms(F.col("sec"))
    return o.select("o_orderkey", c.alias("clock"), T.hms_to_s(c).alias("back"), T.tick(F.col("sec")).alias("tick"))


@query("pixel_boxes_to_yolo", """SELECT l_orderkey, l_partkey, l_suppkey, least(greatest((l_partkey % 300 - 40 + l_quantity / 2) / 200, 0e0), 1e0) AS cx, least(greatest((l_suppkey % 150 - 20 + 15e0) / 100, 0e0), 1e0) AS cy,
  least(greatest(l_quantity / 200, 0e0), 1e0) AS w, 0.3e0 AS h FROM lineitem""")
def pixel_boxes_to_yolo(spark, d):
    from ..functions.geometry import pixel_box_to_yolo

    li = table(spark, d, "lineitem")
    b = pixel_box_to_yolo((F.col("l_partkey") % 300 - 40).cast("double"), (F.col("l_suppkey") % 150 - 20).cast("double"), F.col("l_quantity"), F.lit(30.0), F.lit(200), F.lit(100))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", b.alias("b")).select("l_orderkey", "l_partkey", "l_suppkey", "b.*")


@query("corner_center_boxes", "SELECT l_orderkey, l_partkey, l_suppkey, l_discount + l_tax / 2 AS cx, l_tax + l_discount / 2 AS cy, (l_discount + l_tax / 2) - l_tax / 2 AS x FROM lineitem")
def corner_center_boxes(spark, d):
    from ..functions.geometry import center_to_corner, corner_to_center

    li = table(spark, d, "lineitem")
    x, y = F.col("l_discount"), F.col("l_tax")
    cx, cy = corner_to_center(x, y, y, x)
    back, _ = center_to_corner(cx, cy, y, x)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", cx.alias("cx"), cy.alias("cy"), back.alias("x"))


@query("hit_predicates", f"""WITH {SIGNAL_SQL} SELECT clip, count(*) FILTER (fire >= 0.4e0) AS fire_only, count(*) FILTER (fire >= 0.4e0 OR (fire >= 0.3e0 AND smoke >= 0.6e0)) AS combined,
  count(*) FILTER (fire >= 0.6e0 OR smoke >= 0.6e0) AS either_one, count(*) FILTER (fire >= 0.4e0 OR smoke >= 0.7e0) AS smoke_ok, count(*) FILTER (fire >= 0.4e0 OR (smoke >= 0.2e0 + 0.3e0 AND smoke >= 0.3e0)) AS rise FROM sig GROUP BY clip""")
def hit_predicates(spark, d):
    f, s = F.col("fire"), F.col("smoke")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return signal(spark, d).groupBy("clip").agg(
        n(S.fire_only(f, 0.4), "fire_only"), n(S.combined(f, s, 0.4, 0.6), "combined"), n(S.either(f, s, 0.6), "either_one"),
        n(S.smoke_gated(f, s, 0.4, 0.7, True), "smoke_ok"), n(S.smoke_rise(f, s, F.lit(0.2), 0.4, 0.3), "rise"),
    )


@query("daylight_classes", "SELECT CASE WHEN p_size * 4 < 60 THEN 'night' WHEN p_size * 4 <= 110 THEN 'dusk' ELSE 'day' END AS light, p_size * 4 < 65 AS dark, count(*) AS n FROM part GROUP BY ALL")
def daylight_classes(spark, d):
    b = F.col("p_size") * 4
    return table(spark, d, "part").groupBy(S.daylight(b).alias("light"), S.is_dark(b).alias("dark")).agg(F.count(F.lit(1)).alias("n"))


@query("curve_probabilities", f"WITH {CURVE_SQL} SELECT clip, track, idx, round_even(1 / (1 + exp(-z)), 3) AS p FROM cv")
def curve_probabilities(spark, d):
    return curves(spark, d).select("clip", "track", "idx", T.sigmoid(F.col("z")).alias("p"))


ITEM_SUFFIXES = ("_LOITER_x", "_person_v3", "_base", "_Fall_PoseC3D", "_roam_침입", "_쓰러짐_x", "_collapse", "_faint_loiter")
_SUFFIX_SQL = f"p_name || [{', '.join(f"'{x}'" for x in ITEM_SUFFIXES)}][p_partkey % {len(ITEM_SUFFIXES)} + 1]"


@query(
    "item_of_name",
    f"""WITH n AS (SELECT p_partkey, lower({_SUFFIX_SQL}) AS u, CASE WHEN p_partkey % 13 = 0 THEN 'fall' WHEN p_partkey % 13 = 1 THEN '' END AS stated FROM part)
    SELECT p_partkey,
      CASE WHEN u LIKE '%fall%' OR u LIKE '%posec3d%' THEN 'fall' WHEN u LIKE '%loiter%' OR u LIKE '%배회%' THEN 'loiter'
        WHEN u LIKE '%intru%' OR u LIKE '%person!_v%' ESCAPE '!' OR u LIKE '%침입%' THEN 'intrusion' ELSE 'fire' END AS item,
      coalesce(nullif(stated, ''), CASE WHEN u LIKE '%intrusion%' OR u LIKE '%침입%' THEN 'intrusion' WHEN u LIKE '%loiter%' OR u LIKE '%roam%' OR u LIKE '%배회%' THEN 'loiter'
        WHEN u LIKE '%fall%' OR u LIKE '%faint%' OR u LIKE '%collapse%' OR u LIKE '%쓰러%' THEN 'fall' ELSE 'fire' END) AS run_item FROM n""",
)
def item_of_name(spark, d):
    """The item of a result file and that of a run folder: two rule sets, which differ in words and precedence."""
    p = table(spark, d, "part")
    suffix = F.get(F.array(*[F.lit(x) for x in ITEM_SUFFIXES]), (F.col("p_partkey") % len(ITEM_SUFFIXES)).cast("int"))
    stated = F.when(F.col("p_partkey") % 13 == 0, "fall").when(F.col("p_partkey") % 13 == 1, "")
    name = F.concat("p_name", suffix)
    return p.select("p_partkey", K.item_of(name).alias("item"), K.item_of_run(name, stated).alias("run_item"))


@query("onset_classifier")
def onset_classifier(spark, d):
    """Boosted onset detector, 300 rounds in five folds by clip: totals of each threshold on samples it was not fitted on.

    ``picked`` counts the folds whose other clips choose the threshold, and
    ``adopted`` is the median of those choices.  Fitting is iterative, so there
    is no SQL form; tests compare with a plain booster.
    """
    gt = truth(spark, d)
    scored = checkpoint(classifier.out_of_fold(indexed(spark, d), gt))
    fired, levels = classifier.fired_at_thresholds(scored, gt)
    best = sweep.fold_best(fired, gt, levels, classifier.FOLDS, sweep.fold_of(F.col("clip"), classifier.FOLDS))
    picks = best.groupBy("ordinal").agg(F.count(F.lit(1)).alias("picked"))
    totals = sweep.sweep_totals(fired, gt, levels).join(picks, "ordinal", "left").na.fill(0, ["picked"])
    return totals.withColumn("adopted", sweep.adopt_median(best).select("adopted").scalar())
