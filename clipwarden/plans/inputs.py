"""The driver's tables read as clips, signals, tracks, boxes and labels.

The tables carry no video data, so their columns stand in for it; the mapping
is the same in the Spark code and in the SQL fragments kept next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH_MICROS = 1704067200000000  # 2024-01-01, where the event stream starts


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ts_micros(df: DataFrame) -> Column:
    if dict(df.dtypes)["ts"] == "timestamp_ntz":
        return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return F.unix_micros("ts")


def signal(spark: SparkSession, d: str) -> DataFrame:
    """clip, t (one hour of the stream counts as one second), fire, smoke."""
    ev = table(spark, d, "events")
    return ev.select(
        F.col("user_id").alias("clip"),
        ((_ts_micros(ev) - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)).alias("t"),
        (F.col("value") / 250.0).alias("fire"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("smoke"),
    )


SIGNAL_SQL = f"""sig AS (
  SELECT user_id AS clip, CAST(epoch_us(ts) - {EPOCH_MICROS} AS DOUBLE) / 3.6e9 AS t,
         value / 250e0 AS fire, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100e0 AS smoke
  FROM events)"""


def truth(spark: SparkSession, d: str) -> DataFrame:
    """clip, start_s: the first purchase; clips with none have no event."""
    ev = table(spark, d, "events")
    t = (_ts_micros(ev) - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)
    return ev.groupBy(F.col("user_id").alias("clip")).agg(
        F.min(F.when(F.col("event_type") == "purchase", t)).alias("start_s")
    )


TRUTH_SQL = f"""gt AS (
  SELECT user_id AS clip,
         min(CASE WHEN event_type = 'purchase' THEN CAST(epoch_us(ts) - {EPOCH_MICROS} AS DOUBLE) / 3.6e9 END) AS start_s
  FROM events GROUP BY user_id)"""

# samples are dense in the stand-in time axis: about one in eleven seconds, so a
# bucket of a few hundred seconds holds a few dozen of them
BUCKET_S = 1800.0

INDEXED_SQL = f"""{SIGNAL_SQL}, six AS (
  SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS idx FROM sig)"""


def f1_sql(tp: str = "tp", fn: str = "fn", fp: str = "fp", digits: int | None = 2) -> str:
    """The F1 expression in the same operation order as the Spark column."""
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fn}) ELSE 0e0 END)"
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fp}) ELSE 0e0 END)"
    f1 = f"(CASE WHEN {r} + {p} > 0 THEN 2 * {r} * {p} / ({r} + {p}) ELSE 0e0 END) * 100"
    return f1 if digits is None else f"round_even({f1}, {digits})"


VERDICT_SQL = """CASE WHEN start_s IS NULL AND alarm IS NULL THEN 'normal' WHEN start_s IS NULL THEN 'false'
  WHEN alarm IS NULL THEN 'miss' WHEN alarm >= start_s - 2 AND alarm <= start_s + 10 THEN 'hit' ELSE 'false' END"""


# ---- tracks and zones ---------------------------------------------------------------

ZONES = [
    # loc, tag, polygon
    (0, "Loitering", [(10, 10), (90, 10), (90, 90), (50, 50), (10, 90)]),
    (0, "Intrusion", [(0, 0), (100, 0), (100, 100), (0, 100)]),
    (1, "Intrusion", [(0, 0), (100, 0), (50, 120)]),
    (2, "Loitering", [(20, 0), (95, 0), (95, 70), (20, 70)]),
    (3, "Loitering", [(0, 20), (100, 20)]),
]


def zones(spark: SparkSession) -> DataFrame:
    data = [(loc, tag, [(float(x), float(y)) for x, y in poly]) for loc, tag, poly in ZONES]
    return spark.createDataFrame(data, "loc long, tag string, poly array<struct<x: double, y: double>>")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """One person box per event: clip, track, t, conf and corners around (time of day, value)."""
    ev = table(spark, d, "events")
    m = _ts_micros(ev)
    cx = F.pmod(m - F.lit(EPOCH_MICROS), F.lit(86400000000)) / F.lit(8.64e8)
    y2 = F.least(F.col("value"), F.lit(100.0))
    return ev.select(
        F.col("user_id").alias("clip"),
        (F.col("user_id") % 4).alias("loc"),
        F.when(F.col("event_type").isin("click", "view", "error"), 1).otherwise(2).alias("track"),
        ((m - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)).alias("t"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("conf"),
        F.struct(
            (cx - 5.0).alias("x1"), (y2 - 12.0).alias("y1"), (cx + 5.0).alias("x2"), y2.alias("y2")
        ).alias("box"),
    )


def _edges_sql() -> str:
    rows = []
    for loc, tag, poly in ZONES:
        for i, (x, y) in enumerate(poly):
            nx, ny = poly[(i + 1) % len(poly)]
            rows.append(f"({loc}, '{tag}', {len(poly)}, {x}e0, {y}e0, {nx}e0, {ny}e0)")
    return f"edges(loc, tag, corners, ex, ey, fx, fy) AS (VALUES {', '.join(rows)})"


BOXES_SQL = f"""bx AS (
  SELECT user_id AS clip, user_id % 4 AS loc, CASE WHEN event_type IN ('click', 'view', 'error') THEN 1 ELSE 2 END AS track,
         CAST(epoch_us(ts) - {EPOCH_MICROS} AS DOUBLE) / 3.6e9 AS t,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100e0 AS conf,
         CAST((epoch_us(ts) - {EPOCH_MICROS}) % 86400000000 AS DOUBLE) / 8.64e8 - 5e0 AS x1,
         least(value, 100e0) - 12e0 AS y1,
         CAST((epoch_us(ts) - {EPOCH_MICROS}) % 86400000000 AS DOUBLE) / 8.64e8 + 5e0 AS x2,
         least(value, 100e0) AS y2, event_id
  FROM events),
{_edges_sql()},
bix AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS idx FROM bx)"""


def inside_sql(px: str, py: str, tags: str = "'Loitering', 'Intrusion'") -> str:
    """Crossing count over the edge table of the preferred tag."""
    return f"""(SELECT count(*) % 2 = 1 FROM edges e WHERE e.loc = b.loc AND e.tag = zt.tag AND e.corners >= 3
      AND (e.ey > {py}) <> (e.fy > {py})
      AND {px} < e.ex + ({py} - e.ey) * (e.fx - e.ex) / CASE WHEN e.fy = e.ey THEN 1e0 ELSE e.fy - e.ey END)"""


ZONE_TAG_SQL = """zt AS (SELECT loc, coalesce(max(CASE WHEN tag = 'Loitering' THEN tag END), max(tag)) AS tag FROM edges GROUP BY loc)"""

# ---- detections -----------------------------------------------------------------------


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Boxes per image from order lines, by integer arithmetic."""
    li = table(spark, d, "lineitem")
    x = (F.col("l_partkey") % 37 * 2).cast("double")
    y = (F.col("l_suppkey") % 23 * 3).cast("double")
    w = 20.0 + F.col("l_quantity")
    h = 20.0 + (F.col("l_linenumber") * 5).cast("double")
    return li.select(
        F.col("l_orderkey").alias("image"),
        (
            ((F.col("l_partkey") * 10000 + F.col("l_suppkey") % 10000) * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("long")
        ).alias("det_id"),
        (F.col("l_linenumber") % 2).alias("cls"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber")) % 1000 / 1000.0).alias("conf"),
        F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")).alias("box"),
    )


def truth_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Two of three boxes count as truth, moved a little."""
    det = detections(spark, d).filter(F.col("det_id") % 3 < 2)
    shift = (F.col("det_id") % 7).cast("double")
    b = F.col("box")
    return det.select(
        "image", "cls", F.col("det_id").alias("truth_id"),
        F.struct(
            (b["x1"] + shift).alias("x1"), (b["y1"] + shift).alias("y1"),
            (b["x2"] + shift).alias("x2"), b["y2"].alias("y2"),
        ).alias("box"),
    )


DET_SQL = """det AS (
  SELECT l_orderkey AS image, ((l_partkey * 10000 + l_suppkey % 10000) * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT) AS det_id, CAST(l_linenumber % 2 AS INTEGER) AS cls,
         CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 1000 AS DOUBLE) / 1000 AS conf,
         CAST(l_partkey % 37 * 2 AS DOUBLE) AS x1, CAST(l_suppkey % 23 * 3 AS DOUBLE) AS y1,
         CAST(l_partkey % 37 * 2 AS DOUBLE) + (20e0 + l_quantity) AS x2,
         CAST(l_suppkey % 23 * 3 AS DOUBLE) + (20e0 + CAST(l_linenumber * 5 AS DOUBLE)) AS y2 FROM lineitem)"""
TRUTH_BOX_SQL = """tru AS (SELECT image, cls, det_id AS truth_id, x1 + det_id % 7 AS x1, y1 + det_id % 7 AS y1, x2 + det_id % 7 AS x2, y2
  FROM det WHERE det_id % 3 < 2)"""


def iou_sql(a: str, b: str, soft: bool = False) -> str:
    inter = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0e0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0e0))"
    area = lambda q: f"(({q}.x2 - {q}.x1) * ({q}.y2 - {q}.y1))"
    if soft:
        return f"({inter} / ({area(a)} + {area(b)} - {inter} + 1e-6))"
    return f"(CASE WHEN {area(a)} + {area(b)} - {inter} > 0 THEN {inter} / ({area(a)} + {area(b)} - {inter}) ELSE 0e0 END)"


def contain_sql(a: str, b: str) -> str:
    inter = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0e0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0e0))"
    return f"(CASE WHEN ({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) > 0 THEN {inter} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)) ELSE 0e0 END)"
