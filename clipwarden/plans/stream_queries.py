"""Registered streaming queries: the event table as a stream, results read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming import online as O, ordered
from ..streaming.run import run_available
from .inputs import BOXES_SQL, EPOCH_MICROS, INDEXED_SQL, TRUTH_SQL, table, truth
from .registry import query
from .signal_queries import frame_onset_sql


def file_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a file stream, one file per micro-batch; the table is one file or a folder of files at any depth.

    The path is a pattern, since a stream takes a plain path for a folder.
    """
    reader = spark.readStream.schema(table(spark, d, name).schema)
    return reader.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a file stream, one file per micro-batch."""
    ev = file_stream(spark, d, "events")
    if dict(ev.dtypes)["ts"] == "timestamp_ntz":
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    else:
        micros = F.unix_micros("ts")
    k = F.get_json_object("props", "$.k").cast("double") / 100.0
    return ev.select(
        F.col("user_id").alias("clip"), "event_id", "event_type", F.timestamp_micros(micros).alias("ts"), ((micros - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)).alias("t"),
        (F.col("value") / 250.0).alias("fire"), k.alias("smoke"), "value",
    )


DAY_S = 86400


def track_stream(spark: SparkSession, d: str, least: float) -> DataFrame:
    """The boxes of the event stream, marked where they are sure enough."""
    track = F.when(F.col("event_type").isin("click", "view", "error"), 1).otherwise(2).cast("long")
    return event_stream(spark, d).select("clip", "ts", "t", track.alias("track"), (F.col("smoke") >= least).alias("qualified"))


@query("stream_onset", f"WITH {INDEXED_SQL}, {frame_onset_sql('six', 'fire >= 0.2e0', 4, 6)} SELECT clip, onset, fired_at FROM onsets")
def stream_onset(spark, d):
    s = event_stream(spark, d).select("clip", "t", (F.col("fire") >= 0.2).alias("hit"))
    return run_available(O.online_onset(s, 4, 6))[0]


@query(
    "stream_entrants",
    f"""WITH {BOXES_SQL}, q AS (SELECT clip, track, idx, t FROM bix WHERE conf >= 0.5e0),
    isl AS (SELECT *, idx - row_number() OVER (PARTITION BY clip, track ORDER BY idx) AS g FROM q), pos AS (SELECT *, row_number() OVER (PARTITION BY clip, track, g ORDER BY idx) AS p FROM isl),
    entry AS (SELECT clip, track, min(t) AS det_t FROM pos WHERE p = 2 GROUP BY clip, track), times AS (SELECT clip, det_t, max(det_t) AS v FROM entry GROUP BY clip, det_t),
    nx AS (SELECT *, lead(det_t) OVER (PARTITION BY clip ORDER BY det_t) AS nxt FROM times),
    final AS (SELECT clip, min(det_t) AS stop FROM nx WHERE nxt IS NULL OR EXISTS (SELECT 1 FROM bix s WHERE s.clip = nx.clip AND s.t - nx.det_t >= 24 AND s.t < nxt) GROUP BY clip)
    SELECT times.clip, max(v) AS alarm FROM times JOIN final ON final.clip = times.clip AND det_t <= stop GROUP BY times.clip""",
)
def stream_entrants(spark, d):
    """Alarms also of clips that end while the wait for a last entrant goes on."""
    alarms, _ = ordered.run_to_the_end(lambda b: ordered.live_stays(b, 2, 0, 24.0, late_s=2 * DAY_S, idle_s=2 * DAY_S), track_stream(spark, d, 0.5))
    return alarms.filter("kind = 'alarm'").select("clip", F.col("value").alias("alarm"))


@query(
    "stream_loiterers",
    f"""WITH {BOXES_SQL}, q AS (SELECT clip, track, idx, t FROM bix WHERE conf >= 0.2e0),
    st AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY clip, track ORDER BY idx) - 1 <= 2 THEN 0 ELSE 1 END AS s FROM q), isl AS (SELECT *, sum(s) OVER (PARTITION BY clip, track ORDER BY idx) AS g FROM st),
    pos AS (SELECT *, row_number() OVER (PARTITION BY clip, track, g ORDER BY idx) AS p, min(t) OVER (PARTITION BY clip, track, g) AS since FROM isl),
    det AS (SELECT clip, track, arg_min(since, idx) AS since, min(t) AS det_t FROM pos WHERE p >= 6 GROUP BY clip, track), times AS (SELECT clip, det_t, max(since) AS v FROM det GROUP BY clip, det_t),
    nx AS (SELECT *, lead(det_t) OVER (PARTITION BY clip ORDER BY det_t) AS nxt FROM times),
    final AS (SELECT clip, min(det_t) AS stop FROM nx WHERE nxt IS NULL OR EXISTS (SELECT 1 FROM bix s WHERE s.clip = nx.clip AND s.t - nx.det_t >= 5 AND s.t < nxt) GROUP BY clip)
    SELECT times.clip, max(v) + 10 AS alarm FROM times JOIN final ON final.clip = times.clip AND det_t <= stop GROUP BY times.clip""",
)
def stream_loiterers(spark, d):
    alarms, _ = ordered.run_to_the_end(
        lambda b: ordered.live_stays(b, 6, 2, 5.0, delay=10.0, value="since", late_s=2 * DAY_S, idle_s=2 * DAY_S), track_stream(spark, d, 0.2)
    )
    return alarms.filter("kind = 'alarm'").select("clip", F.col("value").alias("alarm"))


LATE_S = 15 * DAY_S


@query(
    "stream_ordered_onset",
    f"""WITH ev AS (SELECT user_id AS clip, event_id, epoch_us(ts) AS us, CAST(epoch_us(ts) - {EPOCH_MICROS} AS DOUBLE) / 3.6e9 AS t, value / 250e0 AS fire FROM events),
    lost AS (SELECT clip, event_id, us FROM ev JOIN (SELECT clip, max(us) AS high FROM ev WHERE event_id % 97 <> 0 GROUP BY clip) USING (clip)
      WHERE event_id % 97 = 0 AND us < high - {LATE_S * 1000000}),
    six AS (SELECT clip, t, fire, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS idx FROM ev WHERE event_id NOT IN (SELECT event_id FROM lost)),
    {frame_onset_sql('six', 'fire >= 0.2e0', 4, 6)}
    SELECT clip, 'alarm' AS kind, onset AS value, fired_at, NULL::BIGINT AS us FROM onsets UNION ALL SELECT clip, 'late', NULL, NULL, us FROM lost""",
)
def stream_ordered_onset(spark, d):
    """Samples out of order, in six arrivals: onsets as if in order, and the samples that came too late for that.

    Of each half of the time, every second sample comes after the others; each
    97th sample comes after everything else.
    """
    ev = table(spark, d, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") if dict(ev.dtypes)["ts"] == "timestamp_ntz" else F.unix_micros("ts")
    t = (us - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)
    half, last = F.when(t < 360, 0).otherwise(2), F.col("event_id") % 97 == 0
    rows = ev.select(
        F.col("user_id").alias("clip"), F.timestamp_micros(us).alias("ts"), t.alias("t"), (F.col("value") / 250.0 >= 0.2).alias("hit"),
        F.when(last, 4).otherwise(half + F.col("event_id") % 2).alias("_arrival"),
    )
    arrivals = [rows.filter(F.col("_arrival") == k).drop("_arrival") for k in range(5)]
    got, _ = ordered.run_to_the_end(lambda s: ordered.live_onsets(s, 4, 6, late_s=LATE_S, idle_s=DAY_S, horizon_s=400 * DAY_S), arrivals=arrivals)
    return got.select("clip", "kind", "value", "fired_at", F.unix_micros("ts").alias("us"))


@query("stream_tracks")
def stream_tracks(spark, d):
    """Order lines as a stream of boxes, a clip per supplier and a sample per order; equals the batch tracker (see tests)."""
    li = file_stream(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 37 * 24).cast("double"), (F.col("l_orderkey") % 23 * 36).cast("double")
    b = li.select(
        F.col("l_suppkey").alias("clip"), F.col("l_orderkey").alias("idx"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("box_no"),
        (F.col("l_partkey") % 100 / 100.0).alias("conf"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 120).alias("y2"),
    )
    return run_available(O.online_tracks(b))[0]


@query(
    "stream_sample_grid",
    """SELECT user_id AS clip, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS BIGINT) AS start, coalesce(max(CASE WHEN event_type = 'click' THEN value END), 0e0) AS fire,
      coalesce(max(CASE WHEN event_type = 'view' THEN value END), 0e0) AS smoke, count(*) AS boxes FROM events GROUP BY ALL""",
)
def stream_sample_grid(spark, d):
    s = event_stream(spark, d).select(
        "clip", "ts", F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).alias("cls"), F.col("value").alias("conf")
    )
    rows, _ = run_available(O.sample_grid(s, width="1 hour", late="1 hour"), "complete")
    last = rows.agg(F.max("batch").alias("b"))
    rows = rows.withColumn("_b", last.scalar()).filter(F.col("batch") == F.col("_b"))
    return rows.select("clip", F.unix_seconds("start").alias("start"), "fire", "smoke", "boxes")


@query(
    "stream_sliding_summary",
    """WITH e AS (SELECT user_id AS clip, epoch_us(ts) // 3600000000 AS h, value / 250e0 AS fire FROM events), w AS (SELECT clip, (h // 4 - k) * 4 AS s, fire FROM e, (SELECT unnest(range(3)) AS k))
    SELECT clip, CAST((s + 12) * 3600 AS BIGINT) AS "at", max(fire) AS fire_max, round_even(avg(fire), 6) AS fire_mean, round_even(stddev_pop(fire), 6) AS fire_std, count(*) FILTER (fire >= 0.4e0) AS strong, count(*) AS n FROM w GROUP BY clip, s""",
)
def stream_sliding_summary(spark, d):
    s = event_stream(spark, d).select("clip", "ts", "fire")
    rows, _ = run_available(O.sliding_summary(s, width="12 hours", step="4 hours", late="1 hour"), "complete")
    last = rows.agg(F.max("batch").alias("b"))
    rows = rows.withColumn("_b", last.scalar()).filter(F.col("batch") == F.col("_b"))
    return rows.select("clip", F.unix_seconds("at").alias("at"), "fire_max", F.bround("fire_mean", 6).alias("fire_mean"), F.bround("fire_std", 6).alias("fire_std"), "strong", "n")


@query(
    "stream_log_follow",
    "SELECT CAST(user_id AS VARCHAR) AS name, arg_max(event_type || ' ' || event_id, event_id) AS line, count(*) AS matches FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id",
)
def stream_log_follow(spark, d):
    s = event_stream(spark, d).select(
        F.col("clip").cast("string").alias("name"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("line"), "event_id"
    )
    rows, _ = run_available(O.latest_progress(s, "^(click|error) ", F.col("event_id")), "update")
    return rows.groupBy("name").agg(F.max_by(F.struct("line", "matches"), "batch").alias("r")).select("name", "r.*")


@query(
    "stream_enriched",
    f"WITH {TRUTH_SQL} SELECT e.event_id, user_id AS clip, start_s FROM events e JOIN gt ON gt.clip = e.user_id WHERE event_type = 'view'",
)
def stream_enriched(spark, d):
    s = event_stream(spark, d).filter("event_type = 'view'").select("event_id", "clip")
    return run_available(O.enrich(s, truth(spark, d)))[0]
