"""Registered queries over file formats.

The driver's tables hold no annotation files, so each query first lets Spark
write the documents of a format from whole tables (one per order) and then
reads them back with the parser under test; the SQL computes the values
straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K, timecode as T
from ..operators import scorer
from ..sources import adapters, annotations as A, label_sets, logs as L, manifest as M, signals as G, sinks
from ..sources.text import read_documents
from ..streaming.run import shared_folder
from .inputs import table
from .registry import query

LINES_SQL = """ln AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 1000000 + l_suppkey, l_quantity, l_linenumber) - 1 AS pos FROM lineitem)"""


def order_lines(spark, d) -> DataFrame:
    """``o`` and the columns of a line, in which an order's lines are sorted."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("id"), F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n"),
    )


LINE = ["id", "p", "s", "q", "n"]


def grouped(spark, d) -> DataFrame:
    """``o`` and the order's lines, sorted; an order has a handful of lines."""
    return order_lines(spark, d).groupBy("o").agg(F.sort_array(F.collect_list(F.struct(*LINE))).alias("lines"))


def documents(spark, d, line, before: Column | str = "", after: Column | str = "", sep: str = ",", numbered: bool = False) -> DataFrame:
    """One document per order: ``line(l, i)`` for each line between two texts.

    Only a ``numbered`` line gets its place ``i``.  The others are written row by
    row where their order's lines meet, and put in order as texts.
    """
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    if numbered:
        docs = grouped(spark, d).select("o", F.transform("lines", line).alias("texts"))
    else:
        rows = order_lines(spark, d).repartition("o").withColumn("text", line({c: F.col(c) for c in LINE}, None))
        docs = rows.groupBy("o").agg(F.sort_array(F.collect_list(F.struct(*LINE, "text")))["text"].alias("texts"))
    return docs.select("o", F.concat(lit(before), F.array_join("texts", sep), lit(after)).alias("text"))


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def hundredths(c: Column, m: int = 100) -> Column:
    """``c % m`` hundredths with two digits; whole numbers are written without a formatter."""
    v = c % m
    plain = F.concat(F.floor(v / 100).cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))
    return F.when(v >= 0, plain).otherwise(F.format_string("%.2f", v / 100.0))


def clock(sec: Column) -> Column:
    return T.hms(sec)


# ---- manifests and listings ---------------------------------------------------------------


def paths(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    cls = F.element_at(F.array(*[F.lit(c) for c in (*M.CLASS_DIRS, "기타")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    frame = F.when(F.col("o_orderkey") % 9 == 0, F.lit("x")).otherwise(F.lpad((F.col("o_orderkey") % 360).cast("string"), 5, "0"))
    return o.select(
        text_of(F.lit("/data/labels/"), cls, "/plant", F.col("o_custkey") % 20, "/clip", F.floor(F.col("o_orderkey") / 100), "/JSON/F_", F.col("o_orderkey"), "_", frame, ".json").alias("path")
    )


MANIFEST_SQL = """mf AS (SELECT o_orderkey, ['불꽃', '연기', '정상', '기타'][o_orderkey % 4 + 1] AS cls_kr, ['fl', 'sm', 'none', '?'][o_orderkey % 4 + 1] AS cls_code,
  'plant' || (o_custkey % 20) AS place_kr, 'clip' || (o_orderkey // 100) AS clip, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE CAST(o_orderkey % 360 AS INTEGER) END AS frame,
  'F_' || o_orderkey || '_' || CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE lpad(CAST(o_orderkey % 360 AS VARCHAR), 5, '0') END AS stem FROM orders)"""


@query(
    "manifest_from_paths",
    rf"""WITH {MANIFEST_SQL} SELECT cls_kr, cls_code, place_kr, clip, frame, stem, '/data/labels/' || cls_kr || '/' || place_kr || '/' || clip || '/JSON/' || stem || '.json' AS json_path,
      cls_kr || '\' || place_kr || '\' || clip || '\JPG\' || stem || '.jpg' AS img_rel FROM mf""",
)
def manifest_from_paths(spark, d):
    return M.manifest(paths(spark, d))


@query(
    "manifest_stats",
    f"""WITH {MANIFEST_SQL} SELECT CAST(grouping_id(cls_kr, place_kr) AS BIGINT) AS level, cls_kr, place_kr, count(*) AS rows, count(DISTINCT (cls_kr, clip)) AS clips
    FROM mf GROUP BY GROUPING SETS ((), (cls_kr), (place_kr))""",
)
def manifest_stats(spark, d):
    return M.manifest_stats(M.manifest(paths(spark, d))).withColumn("rows", F.col("rows").cast("long"))


@query(
    "even_frames_per_clip",
    f"""WITH {MANIFEST_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cls_kr, place_kr, clip ORDER BY frame, stem) - 1 AS r, count(*) OVER (PARTITION BY cls_kr, place_kr, clip) AS n FROM mf)
    SELECT stem, frame FROM r WHERE n <= 2 OR r IN (SELECT CAST(floor(i * (r.n / 2e0)) AS BIGINT) FROM (SELECT unnest(range(2)) AS i))""",
)
def even_frames_per_clip(spark, d):
    from ..operators.curation import numeric_frames, pick_even

    rows = numeric_frames(M.manifest(paths(spark, d)))
    return pick_even(rows, ["cls_kr", "place_kr", "clip"], ["frame", "stem"], F.floor(F.col("frame") / 100).cast("long"), 2).select("stem", "frame")


@query(
    "media_listing",
    """WITH f AS (SELECT 'cat' || (o_custkey % 5) AS category, '/raw/cat' || (o_custkey % 5) || CASE WHEN o_orderkey % 10 = 0 THEN '/Infrared/' ELSE '/rgb/' END || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mp4' ELSE '.txt' END AS path, o_orderkey FROM orders),
    m AS (SELECT category, path, CASE WHEN o_orderkey % 4 IN (0, 1) AND o_orderkey % 10 <> 0 THEN 'image' WHEN o_orderkey % 4 = 2 THEN 'video' END AS kind FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY path) - 1 AS r, count(*) OVER (PARTITION BY category) AS n FROM m WHERE kind = 'image')
    SELECT category, path, kind FROM r WHERE n <= 600 OR r IN (SELECT CAST(floor(i * (r.n / 600e0)) AS BIGINT) FROM (SELECT unnest(range(600)) AS i))
    UNION ALL SELECT category, path, kind FROM m WHERE kind = 'video'""",
)
def media_listing(spark, d):
    o = table(spark, d, "orders")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".jpg", ".PNG", ".mp4", ".txt")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    folder = F.when(F.col("o_orderkey") % 10 == 0, "/Infrared/").otherwise("/rgb/")
    cat = text_of("cat", F.col("o_custkey") % 5)
    files = o.select(cat.alias("category"), text_of("/raw/", cat, folder, F.col("o_orderkey"), ext).alias("path"))
    # a bucket is the folder with as many characters of the name as leave some thousand files in it
    digits = len(str(o.count() // 4096))
    bucket = F.regexp_extract("path", f"^(.*/[^/]{{0,{digits}}})", 1)
    return M.sampled_listing(M.listing(files), ["category"], 600, bucket).select("category", "path", "kind")


WRITTEN_CONTRACT = """
Brand#11: {gt: voc_xml, media: image, mode: person, use: eval, note: scored only}
Brand#4:
  classes: {0: 1, 1: 0, smoke: drop}
  gt: yolo_txt
Brand#7: {use: none}
Brand#99: {gt: coco_json, media: image}
"""


@query(
    "contract_from_probe",
    """WITH f AS (SELECT p_brand AS category, p_partkey % 11 AS k FROM part),
    s AS (SELECT category, bool_or(k = 0) AS v, bool_or(k = 1) AS a, bool_or(k = 2) AS b, bool_or(k = 3) AS c FROM f GROUP BY category)
    SELECT category, CASE WHEN category = 'Brand#11' THEN 'person' ELSE 'fire' END AS mode,
      CASE WHEN category = 'Brand#11' THEN 'image' WHEN v THEN 'video' ELSE 'image' END AS media,
      CASE WHEN category = 'Brand#11' THEN 'voc_xml' WHEN category = 'Brand#4' THEN 'yolo_txt' WHEN a THEN 'event_xml' WHEN b THEN 'coco_json' WHEN c THEN 'yolo_txt' ELSE 'none' END AS gt,
      CASE WHEN category = 'Brand#4' THEN '0=1,1=0,smoke=drop' END AS classes,
      CASE WHEN category = 'Brand#11' THEN 'eval' WHEN category = 'Brand#7' THEN 'none' ELSE 'train' END AS use FROM s""",
)
def contract_from_probe(spark, d):
    """What is written wins over what the files show, field by field."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 11
    ext = F.when(k == 0, ".mp4").when(k == 1, ".xml").when(k == 2, ".json").when(k == 3, ".txt").otherwise(".jpg")
    head = F.when(k == 1, "<Lib><Alarm><StartTime>").when(k == 2, '{"images": [], "annotations": []')
    files = p.select(F.col("p_brand").alias("category"), text_of("/raw/", F.col("p_brand"), "/", F.col("p_partkey"), ext).alias("path"), head.alias("head"))
    found = M.resolve_contract(files, M.contract_table(spark, WRITTEN_CONTRACT), M.probe(files))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("classes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.withColumn("classes", listed)


@query("safe_paths", "SELECT page_id, url, NOT (contains(url || CASE WHEN page_id % 5 = 0 THEN '/../x' ELSE '' END, '..') OR starts_with(url, '/')) AS ok FROM pages")
def safe_paths(spark, d):
    p = table(spark, d, "pages")
    rel = F.concat("url", F.when(F.col("page_id") % 5 == 0, "/../x").otherwise(""))
    return p.select("page_id", "url", K.safe_relative(rel).alias("ok"))


@query(
    "name_keys",
    """WITH s AS (SELECT c_custkey, 'C' || (c_custkey % 7) || '_' || (c_custkey % 30) || '_P' || (c_nationkey) || '_' || c_custkey AS stem FROM customer)
    SELECT c_custkey, split_part(stem, '_', 1) || '_' || split_part(stem, '_', 2) AS loc, split_part(stem, '_', 3) AS place, split_part(stem, '_', 1) || '_' || split_part(stem, '_', 3) AS clip_place FROM s""",
)
def name_keys(spark, d):
    c = table(spark, d, "customer")
    stem = text_of("C", F.col("c_custkey") % 7, "_", F.col("c_custkey") % 30, "_P", F.col("c_nationkey"), "_", F.col("c_custkey"))
    s = c.select("c_custkey", stem.alias("stem"))
    return s.select("c_custkey", K.location(F.col("stem")).alias("loc"), K.place_code(F.col("stem")).alias("place"), K.clip_place(F.col("stem")).alias("clip_place"))


# ---- signals and tracks -------------------------------------------------------------------


def signal_docs(spark, d) -> DataFrame:
    row = lambda l, i: text_of("[", F.format_string("%.1f", i * 0.5), ", ", hundredths(l["p"]), ", ", hundredths(l["s"]), "]")
    gt = F.when(F.col("o") % 3 == 0, "null").when(F.col("o") % 3 == 1, "-1").otherwise((F.col("o") % 90).cast("string"))
    return documents(spark, d, row, text_of('{"c', F.col("o"), '": {"rows": ['), text_of('], "gt": ', gt, "}}"), numbered=True)


@query("signal_json", f"WITH {LINES_SQL} SELECT 'c' || o AS clip, pos * 0.5e0 AS t, p % 100 / 100e0 AS fire, s % 100 / 100e0 AS smoke FROM ln")
def signal_json(spark, d):
    return G.signal_json(signal_docs(spark, d))


SHAPES = (("rows", "gt"), ("sig", "gt"), ("fire_smoke", "gt_start"))


@query(
    "signal_shapes",
    f"""WITH {LINES_SQL} SELECT 'c' || o AS clip, CASE WHEN o % 5 > 1 THEN CAST(o % 90 AS DOUBLE) END AS start_s, CASE WHEN o % 7 > 0 THEN pos * 0.5e0 END AS t,
      CASE WHEN o % 7 > 0 THEN p % 100 / 100e0 END AS fire, CASE WHEN o % 7 > 0 THEN s % 100 / 100e0 END AS smoke FROM ln WHERE o % 7 > 0 OR pos = 0""",
)
def signal_shapes(spark, d):
    """Documents of all three shapes side by side, with and without an event and samples."""
    row = lambda l, i: text_of("[", F.format_string("%.1f", i * 0.5), ", ", hundredths(l["p"]), ", ", hundredths(l["s"]), "]")
    o = F.col("o")
    pick = lambda k: F.when(o % 3 == 0, SHAPES[0][k]).when(o % 3 == 1, SHAPES[1][k]).otherwise(SHAPES[2][k])
    gt = F.when(o % 5 == 0, "null").when(o % 5 == 1, "-1").otherwise((o % 90).cast("string"))
    docs = grouped(spark, d).withColumn("lines", F.when(o % 7 > 0, F.col("lines")).otherwise(F.slice("lines", 1, 0)))
    body = F.array_join(F.transform("lines", row), ",")
    return G.signal_with_truth(docs.select(text_of('{"c', o, '": {"', pick(1), '": ', gt, ', "', pick(0), '": [', body, "]}}").alias("text")))


@query("signal_truth", f"WITH {LINES_SQL} SELECT DISTINCT 'c' || o AS clip, CASE WHEN o % 3 = 2 THEN CAST(o % 90 AS DOUBLE) END AS start_s FROM ln")
def signal_truth(spark, d):
    return G.signal_truth(signal_docs(spark, d))


@query(
    "track_lines",
    f"WITH {LINES_SQL} SELECT o AS clip, o % 100 * 0.5e0 AS t, pos AS box_no, CAST(n AS INTEGER) AS id, p % 100 / 100e0 AS conf, CAST(s % 50 AS DOUBLE) AS x1, CAST(q AS DOUBLE) AS y1, CAST(s % 50 + 20 AS DOUBLE) AS x2, CAST(q + 40 AS DOUBLE) AS y2 FROM ln",
)
def track_lines(spark, d):
    box = lambda l, i: text_of("[", l["n"], ", ", hundredths(l["p"]), ", ", l["s"] % 50, ", ", l["q"], ", ", l["s"] % 50 + 20, ", ", l["q"] + 40, "]")
    docs = documents(spark, d, box, text_of('{"t": ', F.format_string("%.1f", F.col("o") % 100 * 0.5), ', "boxes": ['), "]}")
    samples = G.track_lines(docs.select(F.col("o").alias("clip"), F.col("text").alias("value")))
    return G.flat_boxes(samples).withColumn("box_no", F.col("box_no").cast("long"))


@query(
    "untracked_lines",
    f"WITH {LINES_SQL} SELECT o AS clip, count(*) FILTER (n % 2 = 0) AS fires, max(CASE WHEN n % 2 = 0 THEN p % 100 / 100e0 ELSE 0e0 END) AS fire, max(CASE WHEN n % 2 = 1 THEN p % 100 / 100e0 ELSE 0e0 END) AS smoke FROM ln GROUP BY o",
)
def untracked_lines(spark, d):
    """Class-first boxes, then the per-sample peaks straight from the nested array."""
    from ..operators.features import class_peaks_nested

    box = lambda l, i: text_of("[", l["n"] % 2, ", ", hundredths(l["p"]), ", 0, 0, 10, 10]")
    docs = documents(spark, d, box, '{"t": 1.0, "boxes": [', "]}")
    s = G.untracked_lines(docs.select(F.col("o").alias("clip"), F.col("text").alias("value")), with_class=True)
    fires = F.size(F.filter("boxes", lambda b: b["cls"] == 0)).cast("long")
    return class_peaks_nested(s).select("clip", fires.alias("fires"), "fire", "smoke")


@query(
    "keypoint_lines",
    f"WITH {LINES_SQL} SELECT o AS clip, CAST(pos AS INTEGER) AS slot, p % 100 / 100e0 AS conf, CAST(17 AS INTEGER) AS points, CAST(p % 50 + 5 AS DOUBLE) AS x5, CAST(16 + s % 50 AS DOUBLE) AS y16 FROM ln",
)
def keypoint_lines(spark, d):
    kp = lambda l: F.concat_ws(", ", *[text_of(i + l["p"] % 50, ", ", i + l["s"] % 50, ", 0.5") for i in range(17)])
    box = lambda l, i: text_of("[", hundredths(l["p"]), ", 0, 0, 10, 20, ", kp(l), "]")
    docs = documents(spark, d, box, '{"t": 2.0, "boxes": [', "]}")
    k = G.keypoint_lines(docs.select(F.col("o").alias("clip"), F.col("text").alias("value")))
    return k.select("clip", "slot", "conf", F.size("kp").alias("points"), F.get("kp", 5)["x"].cast("double").alias("x5"), F.get("kp", 16)["y"].cast("double").alias("y16"))


# ---- events ----------------------------------------------------------------------------------


def alarm_docs(spark, d) -> DataFrame:
    alarm = lambda l, i: F.when(
        l["n"] == 3, F.lit("<Alarm><AlarmDescription> none </AlarmDescription></Alarm>")
    ).otherwise(text_of("<Alarm>\n<StartTime>", clock(l["p"] * 7), "</StartTime><AlarmDescription> kind", l["n"], " </AlarmDescription><AlarmDuration>0:", l["q"], "</AlarmDuration></Alarm>"))
    return documents(spark, d, alarm, "<Library><Clip><Alarms>", "</Alarms></Clip></Library>", "\n")


@query(
    "alarm_spans",
    f"WITH {LINES_SQL} SELECT o AS clip, CAST(pos AS INTEGER) AS pos, CAST(p * 7 AS INTEGER) AS start_s, CAST(q AS INTEGER) AS dur_s, 'kind' || n AS kind FROM ln WHERE n <> 3",
)
def alarm_spans(spark, d):
    return A.alarm_spans(alarm_docs(spark, d), ["o"]).withColumnRenamed("o", "clip")


@query("earliest_alarm", f"WITH {LINES_SQL} SELECT o AS clip, CAST(min(CASE WHEN n <> 3 THEN p * 7 END) AS INTEGER) AS start_s FROM ln GROUP BY o")
def earliest_alarm(spark, d):
    return A.earliest_alarm(alarm_docs(spark, d), ["o"]).withColumnRenamed("o", "clip")


@query(
    "event_xml",
    f"WITH {LINES_SQL} SELECT o AS clip, CASE WHEN n <> 3 THEN CAST(p * 7 AS DOUBLE) END AS start_s, CAST(CASE WHEN n <> 3 THEN 3600 + q * 60 ELSE 10 END AS DOUBLE) AS dur_s FROM ln WHERE pos = 0",
)
def event_xml(spark, d):
    alarm = lambda l, i: F.when(l["n"] == 3, F.lit("<Alarm></Alarm>")).otherwise(
        text_of("<Alarm><StartTime>", clock(l["p"] * 7), "</StartTime><AlarmDuration>1:", l["q"], ":0</AlarmDuration></Alarm>"))
    return A.event_xml(documents(spark, d, alarm, "<A>", "</A>", ""), ["o"]).withColumnRenamed("o", "clip")


@query(
    "span_json",
    f"WITH {LINES_SQL}, s AS (SELECT o, pos, (p * 10) / 25e0 AS s0, (p * 10 + q * 7) / 25e0 AS e0 FROM ln) SELECT o AS clip, CAST(pos AS INTEGER) AS pos, CAST(round_even(s0, 0) AS INTEGER) AS start_s, CAST(greatest(round_even(e0 - s0, 0), 0) AS INTEGER) AS dur_s FROM s",
)
def span_json(spark, d):
    span = lambda l, i: text_of("[", l["p"] * 10, ", ", l["p"] * 10 + l["q"] * 7, "]")
    docs = documents(spark, d, span, '{"annotations": {"event_class": "fall", "event_frame": [', "]}}").withColumn("fps", F.lit(25.0))
    return A.span_json(docs, ["o"]).select(F.col("o").alias("clip"), "pos", "start_s", "dur_s")


COND_SQL = """cd AS (SELECT o_orderkey AS clip, CASE o_orderkey % 4 WHEN 0 THEN 'NIGHT' WHEN 1 THEN 'Day' WHEN 2 THEN 'night-ir' ELSE '' END AS tod,
  CASE o_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '' END AS snow, CASE o_custkey % 5 WHEN 0 THEN 'heavy rain' ELSE 'No' END AS rain, CASE o_custkey % 7 WHEN 0 THEN 'true' ELSE 'none' END AS fog,
  CASE WHEN o_orderkey % 6 < 3 THEN CAST(o_orderkey % 4000 AS INTEGER) END AS start_s FROM orders)"""


def condition_docs(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tod = F.element_at(F.array(*[F.lit(v) for v in ("NIGHT", "Day", "night-ir", "")]), (k % 4 + 1).cast("int"))
    snow = F.when(c % 3 == 0, "Yes").when(c % 3 == 1, "no").otherwise("")
    alarm = F.when(k % 6 < 3, text_of("<Alarms><Alarm><StartTime>", clock(k % 4000), "</StartTime></Alarm></Alarms>")).otherwise("")
    return o.select(
        k.alias("clip"),
        text_of("<H><TimeOfDay>", tod, "</TimeOfDay><Snow> ", snow, " </Snow><Rain>", F.when(c % 5 == 0, "heavy rain").otherwise("No"),
                "</Rain><Fog>", F.when(c % 7 == 0, "true").otherwise("none"), "</Fog>", alarm, "</H>").alias("text"),
    )


@query("conditions", f"WITH {COND_SQL} SELECT clip, tod, snow, rain, fog, start_s FROM cd WHERE tod <> '' OR start_s IS NOT NULL")
def conditions(spark, d):
    return A.conditions(condition_docs(spark, d)).drop("loc")


@query("weather_tags", f"WITH {COND_SQL} SELECT clip, (lower(snow) NOT IN ('', 'no', 'none'))::INT + (lower(rain) NOT IN ('', 'no', 'none'))::INT + (lower(fog) NOT IN ('', 'no', 'none'))::INT AS tags FROM cd WHERE tod <> '' OR start_s IS NOT NULL")
def weather_tags(spark, d):
    c = A.conditions(condition_docs(spark, d))
    return c.select("clip", F.size(A.weather_tags(c)).alias("tags"))


@query(
    "condition_facets",
    f"""WITH {COND_SQL}, y AS (SELECT tod ILIKE '%night%' AS night, tod ILIKE '%day%' AS day, snow = 'Yes' AS snow, rain = 'heavy rain' AS rain, fog = 'true' AS fog FROM cd WHERE tod <> '' OR start_s IS NOT NULL)
    SELECT count(*) AS "all", count(*) FILTER (night) AS night, count(*) FILTER (day) AS day, count(*) FILTER (snow) AS snow, count(*) FILTER (rain) AS rain, count(*) FILTER (fog) AS fog, count(*) FILTER (night OR snow OR rain OR fog) AS hard FROM y""",
)
def condition_facets(spark, d):
    from ..operators.marts import facet_counts

    return facet_counts(A.conditions(condition_docs(spark, d)))


# ---- points, zones, boxes ------------------------------------------------------------------------


def point_docs(spark, d) -> DataFrame:
    obj = lambda l, i: text_of(
        "<object><objectname>person_", l["n"], "</objectname><position><keyframe>", l["p"], "</keyframe><keypoint><x>", l["s"] % 600, "</x><y>", l["q"], "</y></keypoint></position>",
        "<action><actionname>a", l["n"], "</actionname><frame><start>", l["p"], "</start><end>", l["p"] + l["q"], "</end></frame></action></object>")
    return documents(spark, d, obj, "<annotation><size><width>600</width><height>480</height></size><header><fps>25</fps></header>", "</annotation>", "")


@query("keyframe_points", f"WITH {LINES_SQL} SELECT o AS clip, CAST(n AS INTEGER) AS obj, CAST(round_even(p / 25e0 * 2, 0) AS INTEGER) AS tick, round_even(s % 600 / 600e0, 5) AS x, round_even(q / 480e0, 5) AS y FROM ln")
def keyframe_points(spark, d):
    return A.keyframe_points(point_docs(spark, d), ["o"]).withColumnRenamed("o", "clip")


@query("action_spans", f"WITH {LINES_SQL} SELECT o AS clip, CAST(n AS INTEGER) AS obj, 'a' || n AS action, p / 25e0 AS start_s, (p + q) / 25e0 AS end_s FROM ln")
def action_spans(spark, d):
    return A.actions(point_docs(spark, d), ["o"]).withColumnRenamed("o", "clip")


@query(
    "zone_maps",
    f"WITH {LINES_SQL} SELECT o AS loc, CASE WHEN o % 2 = 0 THEN 'Loitering' ELSE 'Intrusion' END AS tag, CAST(count(*) AS INTEGER) AS corners, CAST(sum(s % 100) AS DOUBLE) AS sx, CAST(sum(q) AS DOUBLE) AS sy FROM ln GROUP BY o",
)
def zone_maps(spark, d):
    tag = F.when(F.col("o") % 2 == 0, "Loitering").otherwise("Intrusion")
    point = lambda l, i: text_of("<Point>", l["s"] % 100, ",", l["q"], "</Point>")
    docs = documents(spark, d, point, text_of("<Map><", tag, ">"), text_of("</", tag, "></Map>"), "\n")
    z = A.zone_maps(docs, ["Loitering", "Intrusion"], "o")
    total = lambda c: F.aggregate("poly", F.lit(0.0), lambda a, p: a + p[c])
    return z.select("loc", "tag", F.size("poly").alias("corners"), total("x").alias("sx"), total("y").alias("sy"))


def contract(spark) -> DataFrame:
    rows = [("plain", "fire", None), ("mapped", "fire", {"1": "0", "2": "1", "3": "drop"}), ("people", "person", None)]
    return F.broadcast(spark.createDataFrame(rows, "category string, mode string, classes map<string,string>"))


def _category(docs: DataFrame) -> DataFrame:
    return docs.withColumn("category", F.element_at(F.array(*[F.lit(c) for c in ("plain", "mapped", "people")]), (F.col("o") % 3 + 1).cast("int")))


@query(
    "yolo_txt",
    f"""WITH {LINES_SQL} SELECT o AS image, CAST(pos AS INTEGER) AS line, CASE WHEN o % 3 = 1 THEN CAST(n - 1 AS INTEGER) ELSE 0 END AS cls, round_even(p % 100 / 100e0 - q / 100e0 / 2, 5) AS x, round_even(s % 100 / 100e0 - 0.2e0 / 2, 5) AS y, q / 100e0 AS w, 0.2e0 AS h
    FROM ln WHERE n <> 5 AND ((o % 3 = 1 AND n <= 2) OR o % 3 = 2)""",
)
def yolo_txt(spark, d):
    line = lambda l, i: F.when(l["n"] == 5, F.lit("7 0.5")).otherwise(text_of(l["n"], " ", hundredths(l["p"]), " ", hundredths(l["s"]), " ", hundredths(l["q"]), " 0.2"))
    docs = _category(documents(spark, d, line, "", "", "\n"))
    return A.yolo_txt(docs, contract(spark), ["o"]).withColumnRenamed("o", "image")


@query(
    "voc_xml",
    f"""WITH {LINES_SQL} SELECT o AS image, CAST(pos AS INTEGER) AS pos, CASE WHEN o % 3 = 2 THEN 0 WHEN n % 3 = 0 THEN 0 ELSE 1 END AS cls, round_even(p % 50 / 200e0, 5) AS x, round_even(s % 50 / 100e0, 5) AS y,
      round_even((p % 50 + q - p % 50) / 200e0, 5) AS w, round_even(20 / 100e0, 5) AS h FROM ln WHERE o % 10 <> 0 AND ((o % 3 <> 2 AND n % 3 <> 2) OR (o % 3 = 2))""",
)
def voc_xml(spark, d):
    name = lambda l: F.when(l["n"] % 3 == 0, "Flame").when(l["n"] % 3 == 1, "smoke 2").otherwise("person")
    obj = lambda l, i: text_of("<object><name>", name(l), "</name><bndbox><xmin>", l["p"] % 50, "</xmin><ymin>", l["s"] % 50, "</ymin><xmax>", l["p"] % 50 + l["q"], "</xmax><ymax>", l["s"] % 50 + 20, "</ymax></bndbox></object>")
    width = F.when(F.col("o") % 10 == 0, "0").otherwise("200")
    docs = _category(documents(spark, d, obj, text_of("<annotation><size><width>", width, "</width><height>100</height></size>"), "</annotation>", ""))
    return A.voc_xml(docs, contract(spark), ["o"]).withColumnRenamed("o", "image")


@query(
    "coco_json",
    f"""WITH {LINES_SQL} SELECT 'i' || o || '.jpg' AS image, CAST(pos AS INTEGER) AS pos, CASE WHEN o % 3 = 2 THEN 0 WHEN o % 3 = 1 THEN CASE n % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE NULL END WHEN n % 4 = 1 THEN 0 ELSE 1 END AS cls,
      round_even(p % 50 / 200e0, 5) AS x, round_even(s % 50 / 100e0, 5) AS y, round_even(q / 200e0, 5) AS w, round_even(20 / 100e0, 5) AS h
    FROM ln WHERE (o % 3 = 2) OR (o % 3 = 1 AND n % 4 IN (1, 2)) OR (o % 3 = 0 AND n % 4 IN (1, 2))""",
)
def coco_json(spark, d):
    ann = lambda l, i: text_of('{"image_id": 1, "category_id": ', l["n"] % 4, ', "bbox": [', l["p"] % 50, ", ", l["s"] % 50, ", ", l["q"], ", 20]}")
    head = text_of('{"images": [{"id": 1, "file_name": "a/i', F.col("o"), '.jpg", "width": 200, "height": 100}], "categories": [{"id": 1, "name": "fire"}, {"id": 2, "name": "smoke"}, {"id": 3, "name": "cloud"}, {"id": 0, "name": "sky"}], "annotations": [')
    docs = _category(documents(spark, d, ann, head, "]}"))
    images, annotations, categories = A.coco_tables(docs, ["o", "category"])
    return A.coco_boxes(images, annotations.drop("category"), categories.drop("category"), contract(spark), ["o"]).drop("o")


@query(
    "named_json",
    f"""WITH {LINES_SQL} SELECT o AS image, CAST(count(*) FILTER (n % 4 IN (0, 2)) AS INTEGER) AS boxes, round_even(coalesce(sum(CASE WHEN n % 4 IN (0, 2) THEN (p % 50 + q / 2e0) / 200 END), 0e0), 9) AS cx, count(*) FILTER (n % 4 IN (0, 2)) = 0 AS negative FROM ln GROUP BY o""",
)
def named_json(spark, d):
    ann = lambda l, i: text_of('{"category_id": ', l["n"] % 4, ', "bbox": [', l["p"] % 50, ", ", l["s"] % 50, ", ", l["q"], ", 20]}")
    head = '{"images": [{"width": 200, "height": 100}], "categories": [{"id": 0, "name": "화염"}, {"id": 1, "name": "구름"}, {"id": 2, "name": "굴뚝연기"}, {"id": 3, "name": "안개연기"}], "annotations": ['
    n = A.named_json(documents(spark, d, ann, head, "]}"), ["o"])
    return n.select(F.col("o").alias("image"), F.size("boxes").alias("boxes"), F.bround(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["cx"]), 9).alias("cx"), "negative")


@query(
    "pixel_json",
    f"""WITH {LINES_SQL}, b AS (SELECT o, n, p, least(greatest((p % 300 - 50 + q / 2e0) / 200, 0e0), 1e0) AS cx, least(greatest(q / 200e0, 0e0), 1e0) AS w FROM ln WHERE n IN (1, 2))
    SELECT o AS stem, round_even(sum(cx), 9) AS cx, round_even(sum(w), 9) AS w, CAST(sum(n - 1) AS BIGINT) AS smoke FROM b GROUP BY o""",
)
def pixel_json(spark, d):
    ann = lambda l, i: text_of('{"categories_id": ', l["n"], ', "bbox": [', l["p"] % 300 - 50, ", ", l["s"] % 50, ", ", l["q"], ", 20]}")
    p = A.pixel_json(documents(spark, d, ann, '{"image": {"width": 200, "height": 100}, "annotations": [', "]}"), ["o"])
    b = p.select(F.col("o").alias("stem"), F.inline("boxes"))
    return b.groupBy("stem").agg(F.bround(F.sum("cx"), 9).alias("cx"), F.bround(F.sum("w"), 9).alias("w"), F.sum("cls").alias("smoke"))


def multiview_docs(spark, d) -> DataFrame:
    ids = lambda fn: F.array_join(F.transform("lines", fn), ", ")
    g = grouped(spark, d)
    return g.select(
        "o",
        text_of(
            '{"videos": [{"filename": "v', F.col("o"), '.mp4", "view": "front", "width": 200, "height": 100}], "annotations": {"event_class": "loiter", "evidence": {"front": {"frame_id": [',
            ids(lambda l: l["p"].cast("string")), '], "obj_bbox": [',
            ids(lambda l: text_of("[", l["s"] % 50, ", ", l["q"], ", ", l["s"] % 50 + 30, ", ", l["q"] + 40, "]")),
            '], "obj_id": ["1"], "evidence_text": "frames ', F.col("o") % 500, " ~ ", F.col("o") % 500 + 90, '"}}}}',
        ).alias("text"),
    )


@query(
    "multiview_boxes",
    f"WITH {LINES_SQL} SELECT 'v' || o AS clip, CAST(round_even(p / 30e0 * 2, 0) AS INTEGER) AS tick, CAST(pos + 1 AS VARCHAR) AS obj, round_even(s % 50 / 200e0, 5) AS x, round_even(q / 100e0, 5) AS y, round_even(30 / 200e0, 5) AS w, round_even(40 / 100e0, 5) AS h FROM ln",
)
def multiview_boxes(spark, d):
    docs = multiview_docs(spark, d)
    return A.multiview_boxes(docs, docs.select(text_of("v", F.col("o")).alias("clip"), F.lit(30.0).alias("fps")))


@query("multiview_events", f"WITH {LINES_SQL} SELECT DISTINCT 'v' || o AS clip, 'loiter' AS kind, round_even(o % 500 / 30e0, 1) AS start_s, round_even(90 / 30e0, 1) AS dur_s FROM ln")
def multiview_events(spark, d):
    docs = multiview_docs(spark, d)
    return A.multiview_events(docs, docs.select(text_of("v", F.col("o")).alias("clip"), F.lit(30.0).alias("fps")))


@query(
    "locate_labels",
    """WITH i AS (SELECT o_orderkey AS k, 'data/raw/set/images/s' || (o_custkey % 3) || '/f' || o_orderkey || '.jpg' AS image FROM orders)
    SELECT image, CASE k % 5 WHEN 0 THEN 'data/raw/set/images/s' || split_part(split_part(image, '/', 5), 's', 2) || '/f' || k || '.txt' WHEN 1 THEN 'data/raw/set/labels/' || split_part(image, '/', 5) || '/f' || k || '.txt'
      WHEN 2 THEN 'data/raw/set/labels/f' || k || '.txt' END AS label_path, CAST(CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS INTEGER) AS priority FROM i""",
)
def locate_labels(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    part = text_of("s", F.col("o_custkey") % 3)
    images = o.select(text_of("data/raw/set/images/", part, "/f", k, ".jpg").alias("image"))
    label = F.when(k % 5 == 0, text_of("data/raw/set/images/", part, "/f", k, ".txt")).when(k % 5 == 1, text_of("data/raw/set/labels/", part, "/f", k, ".txt")).when(k % 5 == 2, text_of("data/raw/set/labels/f", k, ".txt"))
    return A.locate_labels(images, o.select(label.alias("path")).filter(F.col("path").isNotNull()))


# ---- logs ---------------------------------------------------------------------------------------------


def log_docs(spark, d) -> DataFrame:
    """Score logs with colour codes, sections, clip lines and chatter."""
    line = lambda l, i: (
        F.when(l["n"] == 7, text_of("########## part", l["q"], " ##"))
        .when(l["n"] == 6, text_of("  클립 C", l["s"], ": ", F.when(l["q"] % 2 == 0, "정검").otherwise("미검"), " (gt=1)"))
        .when(l["n"] == 5, F.lit("loading weights"))
        .otherwise(text_of(F.when(l["n"] == 4, "신규칙 ").otherwise("  "), "r", l["n"], " \x1b[32m→ ", hundredths(l["p"], 10000), "\x1b[0m  (정검 ", l["q"], " 미검 ", l["s"] % 9, " 오검 ", l["n"], ")  f", l["n"]))
    )
    return documents(spark, d, line, "", "", "\n").select(F.col("o").alias("file"), "text")


@query(
    "score_lines",
    f"WITH {LINES_SQL} SELECT o AS file, CAST(pos AS INTEGER) AS line_no, CASE WHEN n = 4 THEN '신규칙 r4' ELSE 'r' || n END AS rule, p % 10000 / 100e0 AS f1, CAST(q AS INTEGER) AS tp, CAST(s % 9 AS INTEGER) AS fn, CAST(n AS INTEGER) AS fp FROM ln WHERE n <= 4",
)
def score_lines(spark, d):
    return L.score_lines(L.lines(log_docs(spark, d)), arrow=True)


@query(
    "best_score_per_file",
    f"WITH {LINES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY p % 10000 DESC, pos) AS r FROM ln WHERE n <= 4) SELECT o AS file, CAST(pos AS INTEGER) AS line_no, 'f' || n AS rule, p % 10000 / 100e0 AS f1, CAST(q AS INTEGER) AS tp, CAST(s % 9 AS INTEGER) AS fn, CAST(n AS INTEGER) AS fp FROM b WHERE r = 1",
)
def best_score_per_file(spark, d):
    return L.best_lines(L.score_lines(L.lines(log_docs(spark, d))))


@query("best_old_rule", f"WITH {LINES_SQL} SELECT o AS file, max(CASE WHEN n < 4 THEN p % 10000 / 100e0 END) AS score_old FROM ln WHERE n <= 4 GROUP BY o")
def best_old_rule(spark, d):
    return L.best_old_rule(L.score_lines(L.lines(log_docs(spark, d)), arrow=True))


@query(
    "log_sections",
    f"""WITH {LINES_SQL}, h AS (SELECT *, count(*) FILTER (n = 7) OVER (PARTITION BY o ORDER BY pos) AS sec FROM ln),
    g AS (SELECT h.o, h.sec, 'part' || x.q AS section, h.p, h.n FROM h JOIN h x ON x.o = h.o AND x.n = 7 AND x.sec = h.sec WHERE h.n <> 7)
    SELECT o AS file, section, CAST(sec AS INTEGER) AS section_no, count(*) AS lines, max(CASE WHEN n <= 4 THEN p % 10000 / 100e0 END) AS best FROM g GROUP BY o, sec, section""",
)
def log_sections(spark, d):
    s = L.sections(log_docs(spark, d))
    score = L.stated_score(F.col("line"))
    rank = s.groupBy("file", "section", "section_no").agg(F.count(F.lit(1)).alias("lines"), F.max(score).alias("best"))
    # a leading text without a header is section 0 of the split
    first = F.when(F.col("file").isNotNull(), F.col("section_no"))
    lead = log_docs(spark, d).select("file", F.regexp_replace("text", L.ANSI, "").startswith(L.SECTION).alias("lead"))
    return rank.join(lead, "file").select("file", "section", (first + F.col("lead").cast("int")).cast("int").alias("section_no"), "lines", "best")


@query(
    "clip_verdict_lines",
    f"WITH {LINES_SQL} SELECT o AS file, 'C' || s AS clip, arg_max(CASE WHEN q % 2 = 0 THEN '정검' ELSE '미검' END, pos) AS verdict FROM ln WHERE n = 6 GROUP BY o, s",
)
def clip_verdict_lines(spark, d):
    return L.clip_verdict_lines(L.lines(log_docs(spark, d)))


@query(
    "log_excerpts",
    f"WITH {LINES_SQL}, k AS (SELECT o, pos, row_number() OVER (PARTITION BY o ORDER BY pos DESC) AS r FROM ln WHERE n <= 4 OR (n = 6 AND q % 2 = 0)) SELECT o AS file, CAST(pos AS INTEGER) AS line_no, CAST(r AS INTEGER) AS from_end FROM k WHERE r <= 2",
)
def log_excerpts(spark, d):
    return L.excerpts(L.lines(log_docs(spark, d)), last=2).select("file", "line_no", "from_end")


@query(
    "live_scores",
    f"""WITH {LINES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY pos DESC) AS r FROM ln) SELECT o AS file, CASE WHEN n % 2 = 0 THEN 'fire' ELSE 'falldown' END AS item, p % 1000 / 10e0 AS f1, CAST(q AS INTEGER) AS tp, CAST(s % 9 AS INTEGER) AS fn, CAST(n AS INTEGER) AS fp FROM b WHERE r = 1""",
)
def live_scores(spark, d):
    line = lambda l, i: text_of("[", F.when(l["n"] % 2 == 0, "fire").otherwise("falldown"), "] 정검 ", l["q"], " 미검 ", l["s"] % 9, " 오검 ", l["n"], " → 점수 ", F.format_string("%.1f", l["p"] % 1000 / 10.0), " (합격)")
    return L.live_scores(L.lines(documents(spark, d, line, "start\n", "\ndone", "\n").withColumnRenamed("o", "file")))


@query(
    "training_progress",
    f"""WITH {LINES_SQL}, b AS (SELECT o, max(pos) AS m FROM ln GROUP BY o), v AS (SELECT ln.*, m FROM ln JOIN b USING (o) WHERE pos = m),
    c AS (SELECT o AS name, CAST(n AS INTEGER) AS epoch, 80 AS epochs, CAST(p % 100 AS INTEGER) AS pct, CAST(q AS INTEGER) AS it, 1681 AS its, round_even(CASE WHEN n % 2 = 0 THEN 1.9e0 ELSE 1e0 / 1.9e0 END, 2) AS it_s,
      1681 / CASE WHEN n % 2 = 0 THEN 1.9e0 ELSE 1e0 / 1.9e0 END / 60 AS em, s % 60 + 120 AS eta, s % 100 / 100e0 AS map50, q / 100e0 AS map5095 FROM v)
    SELECT name, epoch, epochs, pct, it, its, it_s, map50, map5095, 0.5e0 AS precision, 0.25e0 AS recall, round_even(em, 1) AS epoch_min, round_even((eta + (epochs - epoch) * em * 60) / 3600, 1) AS remain_h FROM c""",
)
def training_progress(spark, d):
    line = lambda l, i: text_of(
        "  ", l["n"], "/80  84.8G  1.132 0.926 1.191  325  640: ", l["p"] % 100, "% ━━ ", l["q"], "/1681 1.9", F.when(l["n"] % 2 == 0, "it/s").otherwise("s/it"), " 11:25<2:", F.lpad((l["s"] % 60).cast("string"), 2, "0"),
        "\n   all  601  798  0.5  0.25  ", hundredths(l["s"]), "  ", hundredths(l["q"]))
    return L.training_progress(documents(spark, d, line, "scan\r", "\n", "\r").withColumnRenamed("o", "name"))


@query("training_history", f"WITH {LINES_SQL} SELECT o AS name, count(*) AS epochs, round_even(arg_max(p % 1000 / 1000e0, pos), 4) AS map50 FROM ln GROUP BY o")
def training_history(spark, d):
    line = lambda l, i: text_of(i, ", ", F.format_string("%.3f", l["p"] % 1000 / 1000.0))
    docs = documents(spark, d, line, "", "", "\n", numbered=True)
    rows = docs.select(F.col("o").alias("name"), F.explode(F.split("text", "\n")).alias("line"))
    csv = rows.select("name", F.from_csv("line", "epoch int, map50 double").alias("r")).select("name", "r.*")
    return L.training_history(csv)


@query(
    "map_classes",
    """WITH c(category, mode) AS (VALUES ('plain', 'fire'), ('mapped', 'fire'), ('people', 'person'))
    SELECT category, p_partkey, CASE category WHEN 'people' THEN 0 WHEN 'mapped' THEN CASE p_size % 5 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN NULL ELSE CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 1 END END
      ELSE CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 1 END END AS cls FROM part, c""",
)
def map_classes(spark, d):
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, "Flame A").when(F.col("p_partkey") % 3 == 1, "white 연기").otherwise("pedestrian")
    cats = p.withColumn("category", F.explode(F.array(*[F.lit(c) for c in ("plain", "mapped", "people")]))).join(contract(spark), "category")
    return cats.select("category", "p_partkey", K.map_class((F.col("p_size") % 5), name, F.col("mode"), F.col("classes")).alias("cls"))


# ---- writing -------------------------------------------------------------------------------------------


@query(
    "alarm_documents",
    """WITH a AS (SELECT o_orderkey AS clip, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 50 END AS alarm FROM orders), s AS (SELECT clip, CAST(round_even(alarm, 0) AS BIGINT) AS s FROM a)
    SELECT clip, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, CASE WHEN s IS NULL THEN '0' ELSE '1' END AS events FROM s""",
)
def alarm_documents(spark, d):
    from ..sources.text import leaf

    o = table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("clip"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice") / 50).alias("alarm"))
    docs = sinks.alarm_documents(a, "fire")
    return docs.select("clip", leaf(F.col("text"), "StartTime").alias("clock"), leaf(F.col("text"), "AlarmEvents").alias("events"))


@query(
    "yolo_lines",
    """WITH b AS (SELECT l_orderkey AS image, printf('%d %.6f %.6f %.6f %.6f', l_linenumber % 2, (l_partkey % 97 + 0.5e0) / 128 + 1e0 / 32, (l_suppkey % 97 + 0.5e0) / 128 + 1e0 / 64, 1e0 / 16, 1e0 / 32) AS l FROM lineitem)
    SELECT image, string_agg(l, chr(10) ORDER BY l) AS text FROM b GROUP BY image""",
)
def yolo_lines(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image"), (F.col("l_linenumber") % 2).alias("cls"), ((F.col("l_partkey") % 97 + 0.5) / 128.0).alias("x"),
        ((F.col("l_suppkey") % 97 + 0.5) / 128.0).alias("y"), F.lit(1 / 16).alias("w"), F.lit(1 / 32).alias("h"),
    )
    return A.yolo_lines(li, ["image"])


@query(
    "label_set_round_trip",
    """WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'set_' || p_partkey % 3 || '/img ' || p_partkey || '.jpg' AS image, p_size FROM part),
    b AS (SELECT *, unnest(range(1, p_size % 3 + 1)) AS k FROM i)
    SELECT 'image' AS kind, split, image, NULL::INTEGER AS cls, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM i UNION ALL
    SELECT 'box', split, 'set_' || p_partkey % 3 || '_img_' || p_partkey, CAST((p_partkey + k) % 2 AS INTEGER), (p_partkey * 7 + k * 5) % 29 / 32e0, (p_partkey * 3 + k * 11) % 29 / 32e0 FROM b""",
)
def label_set_round_trip(spark, d):
    """A label set written by its commit protocol, then its lists and label files read back."""
    p = table(spark, d, "part")
    k, n = F.col("p_partkey"), F.col("p_size") % 3
    split = F.when(k % 5 == 0, "val").otherwise("train")
    image = text_of("set_", k % 3, "/img ", k, ".jpg")
    line = lambda j: F.format_string(
        "%d %.6f %.6f 0.062500 0.062500", (k + j) % 2, ((k * 7 + j * 5) % 29 + 1) / F.lit(32.0), ((k * 3 + j * 11) % 29 + 1) / F.lit(32.0)
    )
    lines = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), line), "\n"))
    path = f"{shared_folder(spark)}/set"
    label_sets.write_label_set(p.select(split.alias("split"), image.alias("image"), lines.alias("text")), path, ["fire", "smoke"])
    contract = spark.createDataFrame([("set", "fire", {"0": "0", "1": "1"})], "category string, mode string, classes map<string,string>")
    listed = [spark.read.text(f"{path}/{s}.txt").select(F.lit(s).alias("split"), F.col("value").alias("image")) for s in ("train", "val")]
    images = listed[0].unionByName(listed[1])
    # a file for each image: more than the driver could list
    docs = read_documents(spark, f"{path}/labels", "*.txt", label_sets.label_paths(images)).select(
        F.lit("set").alias("category"), F.regexp_extract("path", r"/labels/([^/]+)/", 1).alias("split"), F.col("clip").alias("image"), "text"
    )
    boxes = A.yolo_txt(docs, contract, ["split", "image"]).select(F.lit("box").alias("kind"), "split", "image", "cls", "x", "y")
    return images.select(
        F.lit("image").alias("kind"), "split", "image", F.lit(None).cast("int").alias("cls"),
        F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"),
    ).unionByName(boxes)


@query("jsonl_round_trip", "SELECT event_id, user_id AS clip, event_type, value, props FROM events")
def jsonl_round_trip(spark, d):
    """Rows as JSON lines by kind of event, read back."""
    path = f"{shared_folder(spark)}/lines"
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("clip"), "event_type", "value", "props")
    sinks.write_jsonl(rows, path, ["event_type"])
    return spark.read.schema("event_id long, clip long, value double, props string, event_type string").json(path).select(rows.columns)


@query("csv_round_trip", "SELECT doc_id, text, lang, source FROM documents")
def csv_round_trip(spark, d):
    """Texts with quotes, commas and line ends as CSV, read back."""
    path = f"{shared_folder(spark)}/table"
    rows = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    sinks.write_csv(rows, path)
    return sinks.read_csv(spark, path, "doc_id long, text string, lang string, source string")


def arithmetic_detector():
    """Stands in for a detector: boxes from the numbers of an image."""

    def predict(batch):
        return [
            [{"cls": i % 3, "conf": (k * 7 + i * 13) % 100 / 100, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0} for i in range(n % 4)]
            for k, n in zip(batch["p_partkey"].tolist(), batch["p_size"].tolist())
        ]

    return predict


@query(
    "scored_images",
    """WITH b AS (SELECT p_partkey, unnest(range(p_size % 4)) AS i FROM part), c AS (SELECT p_partkey, i % 3 AS cls, (p_partkey * 7 + i * 13) % 100 / 100e0 AS conf FROM b),
    k AS (SELECT p_partkey, count(*) AS n_det, max(conf) AS max_conf, arg_max(cls, (conf, -cls)) AS top_class FROM c WHERE conf >= 0.25e0 GROUP BY p_partkey)
    SELECT p_partkey, CAST(coalesce(n_det, 0) AS INTEGER) AS n_det, coalesce(max_conf, 0e0) AS max_conf, CAST(top_class AS INTEGER) AS top_class FROM part LEFT JOIN k USING (p_partkey)""",
)
def scored_images(spark, d):
    images = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"))
    return scorer.score_images(images, arithmetic_detector, "p_partkey long", model="arithmetic")


def _point_list(text: str):
    """``id@x,y|id@x,y``; parts that are not of this form are left out."""
    for part in text.split("|"):
        number, _, place = part.partition("@")
        x, _, y = place.partition(",")
        if number.strip().isdigit() and x and y:
            yield int(number), float(x), float(y)


def _field_list(text: str):
    """A line of ``key = value`` each."""
    for line in text.splitlines():
        key, sign, value = line.partition("=")
        if sign:
            yield key.strip(), value.strip()


OWN_FORMATS = {
    "points": adapters.Format("number bigint, x double, y double", _point_list),
    "fields": adapters.Format("key string, value string", _field_list),
}


@query(
    "own_formats",
    f"""WITH {LINES_SQL} SELECT o, n AS number, CAST(p % 640 AS DOUBLE) AS x, s % 480 + 0.5e0 AS y, NULL::VARCHAR AS key, NULL::VARCHAR AS value FROM ln
    UNION ALL SELECT o, NULL, NULL, NULL, 'part ' || n, CAST(p AS VARCHAR) FROM ln WHERE o % 2 = 0""",
)
def own_formats(spark, d):
    """Two formats of one's own through one table function, each with its columns."""
    adapters.register_formats(spark, OWN_FORMATS)
    points = documents(spark, d, lambda l, i: text_of(l["n"], "@", l["p"] % 640, ",", l["s"] % 480, ".5"), "x@|", "|7", "|")
    fields = documents(spark, d, lambda l, i: text_of("part ", l["n"], " = ", l["p"]), "# head\n", "\n", "\n").filter("o % 2 = 0")
    return adapters.parsed(points, "points", ["o"]).unionByName(adapters.parsed(fields, "fields", ["o"]), allowMissingColumns=True)
