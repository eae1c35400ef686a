"""Registered queries over confidence signals: rules, scores, sweeps, selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import signals as S
from ..operators import features, joins, rules, scoring, sweep
from ..session import checkpoint, passing
from . import presets
from .inputs import INDEXED_SQL, SIGNAL_SQL, TRUTH_SQL, VERDICT_SQL, f1_sql, signal, table, truth
from .registry import query

WIDTH_S = 1.0  # bucket width that bounds the samples of one bucket in the event stream


def indexed(spark: SparkSession, d: str) -> DataFrame:
    return rules.index_samples(signal(spark, d), seconds=WIDTH_S)


def with_base(spark: SparkSession, d: str) -> DataFrame:
    sig = indexed(spark, d)
    base = rules.baseline(signal(spark, d), "smoke")
    return sig.join(base, "clip", "left").na.fill(0.0, ["smoke_base"])


BASE_SQL = """heads AS (
  SELECT clip, smoke, row_number() OVER (PARTITION BY clip ORDER BY smoke) - 1 AS pos,
         count(*) OVER (PARTITION BY clip) AS n FROM sig WHERE t <= 60),
base AS (SELECT clip, smoke AS smoke_base FROM heads
         WHERE pos = least(CAST(floor(n * 0.8e0) AS BIGINT), n - 1))"""


def frame_onset_sql(source: str, hit: str, n: int, m: int, keys: str = "clip") -> str:
    """Textbook form of the N-of-M rule: count and first hit in a sliding frame."""
    return f"""framed AS (
  SELECT {keys}, idx, t,
         sum(CASE WHEN {hit} THEN 1 ELSE 0 END) OVER w AS c, min(CASE WHEN {hit} THEN t END) OVER w AS o
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW)),
onsets AS (SELECT {keys}, arg_min(o, idx) AS onset, min(t) AS fired_at FROM framed WHERE c >= {n} GROUP BY {keys})"""


@query(
    "onset_n_of_m",
    f"WITH {INDEXED_SQL}, {frame_onset_sql('six', 'fire >= 0.2e0', 4, 6)} SELECT clip, onset, fired_at FROM onsets",
)
def onset_n_of_m(spark, d):
    hits = indexed(spark, d).filter(S.fire_only(F.col("fire"), 0.2))
    return rules.n_of_m(hits, 4, 6)


ALARM_SQL = f"""{INDEXED_SQL}, {BASE_SQL},
sb AS (SELECT six.*, coalesce(smoke_base, 0e0) AS smoke_base FROM six LEFT JOIN base USING (clip)),
{frame_onset_sql('sb', '(fire >= 0.3e0 OR (smoke >= smoke_base + 0.2e0 AND smoke >= 0.3e0))', 5, 12)},
alarms AS (SELECT clip, onset + 10 AS alarm FROM onsets)"""


def fire_alarms(spark: SparkSession, d: str) -> DataFrame:
    hit = S.smoke_rise(F.col("fire"), F.col("smoke"), F.col("smoke_base"), 0.3, 0.2)
    fired = rules.n_of_m(with_base(spark, d).filter(hit), 5, 12)
    return fired.select("clip", (F.col("onset") + rules.ALARM_DELAY_S).alias("alarm"))


@query("fire_alarm", f"WITH {ALARM_SQL} SELECT clip, alarm FROM alarms")
def fire_alarm(spark, d):
    return fire_alarms(spark, d)


@query(
    "dwell_all_of_m",
    f"""WITH {INDEXED_SQL}, framed AS (
      SELECT clip, t, min(CASE WHEN smoke >= 0.25e0 THEN 1 ELSE 0 END) OVER w AS every, count(*) OVER w AS n
      FROM six WINDOW w AS (PARTITION BY clip ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT clip, min(t) AS onset FROM framed WHERE every = 1 AND n = 14 GROUP BY clip""",
)
def dwell_all_of_m(spark, d):
    hits = indexed(spark, d).filter(F.col("smoke") >= 0.25)
    return rules.all_of_m(hits, presets.CERTIFIED["loiter"]["dwell_samples"])


def curves(spark: SparkSession, d: str) -> DataFrame:
    """One curve per clip and event type; z is the scaled value."""
    sig = signal_with_track(spark, d)
    return rules.index_samples(sig, keys=("clip", "track"), seconds=WIDTH_S)


def signal_with_track(spark: SparkSession, d: str) -> DataFrame:
    from .inputs import EPOCH_MICROS, _ts_micros

    ev = table(spark, d, "events")
    return ev.select(
        F.col("user_id").alias("clip"),
        F.col("event_type").alias("track"),
        ((_ts_micros(ev) - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)).alias("t"),
        ((F.col("value") - 50.0) / 25.0).alias("z"),
    )


CURVE_SQL = """cv AS (
  SELECT user_id AS clip, event_type AS track, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 3.6e9 AS t,
         (value - 50e0) / 25e0 AS z,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) - 1 AS idx FROM events)"""


@query(
    "curve_run_length",
    f"""WITH {CURVE_SQL}, runs AS (
      SELECT clip, track, idx, sum(CASE WHEN z >= 0 THEN 1 ELSE 0 END) OVER w AS c, min(t) OVER w AS first_t
      FROM cv WINDOW w AS (PARTITION BY clip, track ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    per_track AS (SELECT clip, track, arg_min(first_t, idx) AS onset FROM runs WHERE c = 3 GROUP BY clip, track)
    SELECT clip, min(onset) AS alarm, count(*) AS tracks FROM per_track GROUP BY clip""",
)
def curve_run_length(spark, d):
    per_track = rules.run_length(curves(spark, d), 0.0, 3)
    return per_track.groupBy("clip").agg(F.min("onset").alias("alarm"), F.count("track").alias("tracks"))


@query(
    "first_crossing",
    f"WITH {SIGNAL_SQL} SELECT clip, min(t) + 10 AS onset FROM sig WHERE smoke >= 0.9e0 GROUP BY clip",
)
def first_crossing(spark, d):
    return rules.first_crossing(signal(spark, d), 0.9, z="smoke", delay=10.0)


@query(
    "baseline_share",
    f"WITH {SIGNAL_SQL}, {BASE_SQL} SELECT clip, smoke_base FROM base",
)
def baseline_share(spark, d):
    return rules.baseline(signal(spark, d), "smoke")


@query(
    "sample_peaks",
    """SELECT user_id AS clip, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS slot,
         coalesce(max(CASE WHEN event_type = 'click' THEN value END), 0e0) AS fire,
         coalesce(max(CASE WHEN event_type = 'view' THEN value END), 0e0) AS smoke, count(*) AS boxes
       FROM events GROUP BY ALL""",
)
def sample_peaks(spark, d):
    from .inputs import _ts_micros

    ev = table(spark, d, "events")
    boxes = ev.select(
        F.col("user_id").alias("clip"), F.floor(_ts_micros(ev) / 3600000000).alias("slot"),
        F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).alias("cls"),
        F.col("value").alias("conf"),
    )
    return features.class_peaks(boxes, ["clip", "slot"])


# ---- scoring -------------------------------------------------------------------


def scored(spark: SparkSession, d: str) -> DataFrame:
    t = truth(spark, d).join(fire_alarms(spark, d), "clip", "left")
    return t.withColumn("verdict", scoring.verdict(F.col("alarm"), F.col("start_s")))


SCORED_SQL = f"""{ALARM_SQL}, {TRUTH_SQL},
scored AS (SELECT clip, start_s, alarm, {VERDICT_SQL} AS verdict FROM gt LEFT JOIN alarms USING (clip))"""


@query("clip_verdicts", f"WITH {SCORED_SQL} SELECT * FROM scored ORDER BY clip")
def clip_verdicts(spark, d):
    return scored(spark, d).orderBy("clip")


def _tally_sql(lost: str) -> str:
    return f"""WITH {SCORED_SQL}, c AS (
      SELECT count(*) FILTER (verdict = 'hit') AS tp, count(*) FILTER ({lost}) AS fn,
             count(*) FILTER (verdict = 'false') AS fp FROM scored)
    SELECT tp, fn, fp, {f1_sql()} AS f1 FROM c"""


@query("tally_double_penalty", _tally_sql("verdict = 'miss' OR (verdict = 'false' AND start_s IS NOT NULL)"))
def tally_double_penalty(spark, d):
    return scoring.tally(scored(spark, d))


@query("tally_single_penalty", _tally_sql("verdict = 'miss'"))
def tally_single_penalty(spark, d):
    return scoring.tally(scored(spark, d), penalty="single")


@query(
    "tally_many_alarms",
    f"""WITH {SIGNAL_SQL}, {TRUTH_SQL}, al AS (SELECT clip, t AS alarm FROM sig WHERE fire >= 0.5e0),
    per AS (SELECT gt.clip, start_s, count(alarm) AS k,
              coalesce(bool_or(alarm >= start_s - 2 AND alarm <= start_s + 10), false) AS ok
            FROM gt LEFT JOIN al USING (clip) GROUP BY gt.clip, start_s),
    c AS (SELECT count(*) FILTER (ok) AS tp, count(*) FILTER (NOT ok AND start_s IS NOT NULL) AS fn,
                 CAST(coalesce(sum(k - CASE WHEN ok THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp FROM per)
    SELECT tp, fn, fp, {f1_sql()} AS f1 FROM c""",
)
def tally_many_alarms(spark, d):
    alarms = signal(spark, d).filter(F.col("fire") >= 0.5).select("clip", F.col("t").alias("alarm"))
    return scoring.tally_multi(alarms, truth(spark, d))


@query(
    "window_extrema",
    f"""WITH {SIGNAL_SQL}, {TRUTH_SQL}
    SELECT clip, coalesce(max(CASE WHEN t >= start_s - 2 AND t <= start_s + 10 THEN fire END), 0e0) AS in_window,
           coalesce(max(CASE WHEN t < start_s - 5 THEN fire END), 0e0) AS before,
           coalesce(max(CASE WHEN t >= start_s - 10 AND t <= start_s + 20 THEN fire END), 0e0) AS around_fire,
           coalesce(max(CASE WHEN t >= start_s - 10 AND t <= start_s + 20 THEN smoke END), 0e0) AS around_smoke,
           coalesce(max(fire), 0e0) AS overall
    FROM sig JOIN gt USING (clip) GROUP BY clip""",
)
def window_extrema(spark, d):
    return features.window_extrema(joins.with_truth(signal(spark, d), truth(spark, d)))


@query(
    "miss_diagnosis",
    f"""WITH ev AS (SELECT user_id AS clip, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 3.6e9 AS t, event_type AS view,
         value AS conf, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS area, event_id FROM events), {TRUTH_SQL},
    w AS (SELECT * FROM ev JOIN gt USING (clip) WHERE t >= start_s - 2 AND t <= start_s + 10)
    SELECT clip, max(CASE WHEN view <> 'purchase' THEN conf END) AS fire,
           arg_max(view, conf) FILTER (view <> 'purchase') AS view,
           arg_max(area, conf) FILTER (view <> 'purchase') AS area,
           max(CASE WHEN view = 'purchase' THEN conf END) AS smoke, count(*) AS samples
    FROM w GROUP BY clip""",
)
def miss_diagnosis(spark, d):
    from .inputs import EPOCH_MICROS, _ts_micros

    ev = table(spark, d, "events")
    boxes = ev.select(
        F.col("user_id").alias("clip"), ((_ts_micros(ev) - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)).alias("t"),
        F.col("event_type").alias("view"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("cls"),
        F.col("value").alias("conf"), (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("area"),
    )
    return features.miss_diagnosis(joins.with_truth(boxes, truth(spark, d)))


# ---- grids -----------------------------------------------------------------------


def _values(rules_, fields) -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)

    rows = ", ".join(f"({i}, {', '.join(lit(v) for v in r)})" for i, r in enumerate(rules_))
    return f"rules(ordinal, {', '.join(fields)}) AS (VALUES {rows})"


FIRE_FIELDS = presets.FireRule._fields
HIT_SQL = """CASE kind WHEN 'fire_only' THEN fire_v >= fire WHEN 'combined' THEN fire_v >= fire OR (fire_v >= 0.3e0 AND smoke_v >= smoke)
  WHEN 'smoke_ok' THEN fire_v >= fire OR smoke_v >= smoke WHEN 'either' THEN fire_v >= fire OR smoke_v >= fire
  ELSE fire_v >= fire OR (rise IS NOT NULL AND smoke_v >= smoke_base + rise AND smoke_v >= 0.3e0) END"""


RULE_SCORES_SQL = f"""verdicts AS (SELECT rules.ordinal, g.clip, g.start_s, alarm, {VERDICT_SQL} AS verdict
             FROM rules CROSS JOIN ev_gt g LEFT JOIN fired f ON f.ordinal = rules.ordinal AND f.clip = g.clip),
counts AS (SELECT ordinal, count(*) FILTER (verdict = 'hit') AS tp,
                  count(*) FILTER (verdict <> 'hit' AND start_s IS NOT NULL) AS fn, count(*) FILTER (verdict = 'false') AS fp
           FROM verdicts GROUP BY ordinal),
totals AS (SELECT rules.*, tp, fn, fp, {f1_sql()} AS f1 FROM rules JOIN counts USING (ordinal))"""


EVENT_CLIPS_SQL = "ev_gt AS (SELECT * FROM gt WHERE start_s IS NOT NULL)"
# nearly every clip of the stand-in has an event, so every seventh stands for a clip without one
ALL_CLIPS_SQL = "ev_gt AS (SELECT clip, CASE WHEN clip % 7 <> 3 THEN start_s END AS start_s FROM gt)"


def grid_sql(grid, delay: float = 10.0, prefix: str = INDEXED_SQL, clips: str = EVENT_CLIPS_SQL) -> str:
    """Every rule on every sample, with a frame per rule; then verdicts of fired clips."""
    return f"""{prefix}, {BASE_SQL}, {TRUTH_SQL}, {_values(grid, FIRE_FIELDS)},
{clips},
sb AS (SELECT six.clip, idx, t, fire AS fire_v, smoke AS smoke_v, coalesce(smoke_base, 0e0) AS smoke_base
       FROM six JOIN ev_gt USING (clip) LEFT JOIN base USING (clip)),
hit AS (SELECT ordinal, win, hits, clip, idx, t, CASE WHEN {HIT_SQL} THEN 1 ELSE 0 END AS h FROM sb CROSS JOIN rules),
fr AS (SELECT ordinal, clip, hits, idx, t,
         sum(h) OVER (PARTITION BY ordinal, clip ORDER BY idx ROWS BETWEEN win - 1 PRECEDING AND CURRENT ROW) AS c,
         min(CASE WHEN h = 1 THEN t END) OVER (PARTITION BY ordinal, clip ORDER BY idx ROWS BETWEEN win - 1 PRECEDING AND CURRENT ROW) AS o
       FROM hit),
fired AS (SELECT ordinal, clip, arg_min(o, idx) + {delay} AS alarm FROM fr WHERE c >= hits GROUP BY ordinal, clip),
{RULE_SCORES_SQL}"""


def events_only(spark, d) -> DataFrame:
    return truth(spark, d).filter(F.col("start_s").isNotNull())


def all_clips(spark, d) -> DataFrame:
    """Ground truth with clips that have no event: an alarm there is a false alarm."""
    return truth(spark, d).withColumn("start_s", F.when(F.col("clip") % 7 != 3, F.col("start_s")))


def grid_run(spark, d, grid, source=None, reuse: bool = False, clips=events_only, digits: int | None = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fired verdicts, ground truth and totals; ``reuse`` keeps the fired rows for a second reading."""
    sig = source if source is not None else with_base(spark, d)
    gt = clips(spark, d)
    fired = sweep.fired_verdicts(sweep.clip_onsets(sig, grid), gt, rules.ALARM_DELAY_S)
    if reuse:
        fired = checkpoint(fired)
    totals = sweep.sweep_totals(fired, gt, sweep.rule_table(spark, grid), digits)
    return fired, gt, totals


@query("fire_sweep_540", f"WITH {grid_sql(presets.rise_grid())} SELECT * FROM totals")
def fire_sweep_540(spark, d):
    return grid_run(spark, d, presets.rise_grid())[2]


@query(
    "fire_sweep_top15",
    f"WITH {grid_sql(presets.rise_grid())} SELECT ordinal, fire, rise, win, hits, tp, fn, fp, f1 FROM totals ORDER BY f1 DESC, fp, fire DESC, ordinal LIMIT 15",
)
def fire_sweep_top15(spark, d):
    totals = grid_run(spark, d, presets.rise_grid())[2]
    return sweep.rank_rise(totals).limit(15).select("ordinal", "fire", "rise", "win", "hits", "tp", "fn", "fp", "f1")


@query(
    "sweep_stability",
    f"""WITH {grid_sql(presets.rise_grid())}, b AS (SELECT max(f1) AS best FROM totals)
    SELECT best, count(*) AS settings, min(fire) AS lowest, max(fire) AS highest, count(rise) AS with_smoke
    FROM totals, b WHERE f1 >= best - 0.01e0 GROUP BY best""",
)
def sweep_stability(spark, d):
    return sweep.stability(grid_run(spark, d, presets.rise_grid(), reuse=True)[2])


@query("detail_sweep_630", f"WITH {grid_sql(presets.detail_grid())} SELECT ordinal, tp, fn, fp, f1 FROM totals ORDER BY f1 DESC, fp, ordinal LIMIT 12")
def detail_sweep_630(spark, d):
    totals = grid_run(spark, d, presets.detail_grid())[2]
    return sweep.rank_f1_fp(totals).limit(12).select("ordinal", "tp", "fn", "fp", "f1")


@query(
    "gated_sweep_best",
    f"""WITH {grid_sql(presets.gated_grid(), clips=ALL_CLIPS_SQL)}, raw AS (SELECT * REPLACE ({f1_sql(digits=None)} AS f1) FROM totals)
    SELECT ordinal, kind, fire, smoke, win, hits, tp, fn, fp, round_even(f1, 1) AS f1 FROM raw ORDER BY raw.f1 DESC, fp, ordinal LIMIT 1""",
)
def gated_sweep_best(spark, d):
    """The best of the grid by the unrounded score, false alarms of clips without an event included."""
    totals = grid_run(spark, d, presets.gated_grid(), clips=all_clips, digits=None)[2]
    best = sweep.rank_f1_fp(totals).limit(1).withColumn("f1", F.bround("f1", 1))
    return best.select("ordinal", "kind", "fire", "smoke", "win", "hits", "tp", "fn", "fp", "f1")


@query(
    "named_rules",
    f"""WITH {grid_sql(list(presets.NAMED_RULES.values()), clips=ALL_CLIPS_SQL)}
    SELECT ordinal, kind, win, hits, tp, fn, fp, f1 FROM totals""",
)
def named_rules(spark, d):
    totals = grid_run(spark, d, list(presets.NAMED_RULES.values()), clips=all_clips)[2]
    return totals.select("ordinal", "kind", "win", "hits", "tp", "fn", "fp", "f1")


@query(
    "best_rule_verdicts",
    f"""WITH {grid_sql(list(presets.NAMED_RULES.values()), clips=ALL_CLIPS_SQL)},
    b AS (SELECT ordinal FROM totals ORDER BY f1 DESC, ordinal LIMIT 1)
    SELECT clip, start_s, alarm, verdict FROM verdicts JOIN b USING (ordinal)""",
)
def best_rule_verdicts(spark, d):
    fired, gt, totals = grid_run(spark, d, list(presets.NAMED_RULES.values()), reuse=True, clips=all_clips)
    best = totals.orderBy(F.desc("f1"), "ordinal").limit(1).select("ordinal")
    own = fired.withColumn("_best", best.scalar()).filter(F.col("ordinal") == F.col("_best")).select("clip", "alarm")
    return gt.join(own, "clip", "left").withColumn("verdict", scoring.verdict(F.col("alarm"), F.col("start_s")))


HELD_SQL = f"""mine AS (SELECT ordinal, clip, CASE WHEN verdict = 'hit' THEN 1 ELSE 0 END AS m_tp,
                CASE WHEN verdict = 'hit' THEN 0 ELSE 1 END AS m_fn, CASE WHEN verdict = 'false' THEN 1 ELSE 0 END AS m_fp FROM verdicts),
rest AS (SELECT m.*, tp - m_tp AS r_tp, fn - m_fn AS r_fn, fp - m_fp AS r_fp FROM mine m JOIN counts USING (ordinal)),
ranked AS (SELECT *, {f1_sql('r_tp', 'r_fn', 'r_fp')} AS f1_rest FROM rest),
held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY f1_rest DESC, ordinal) AS rn FROM ranked) WHERE rn = 1)"""
LOO_SQL = f"{grid_sql(presets.held_out_fire_grid())}, {HELD_SQL}"


@query("leave_one_clip_out", f"WITH {LOO_SQL} SELECT clip, ordinal, f1_rest, m_tp AS tp, m_fn AS fn, m_fp AS fp FROM held")
def leave_one_clip_out(spark, d):
    fired, gt, totals = grid_run(spark, d, presets.held_out_fire_grid(), reuse=True)
    return sweep.hold_out(fired, gt, totals).withColumns({c: F.col(c).cast("int") for c in ("tp", "fn", "fp")})


@query(
    "leave_one_out_summary",
    f"""WITH {LOO_SQL}, c AS (SELECT CAST(sum(m_tp) AS BIGINT) AS tp, CAST(sum(m_fn) AS BIGINT) AS fn, CAST(sum(m_fp) AS BIGINT) AS fp FROM held)
    SELECT tp, fn, fp, {f1_sql()} AS f1 FROM c""",
)
def leave_one_out_summary(spark, d):
    fired, gt, totals = grid_run(spark, d, presets.held_out_fire_grid(), reuse=True)
    return sweep.hold_out_summary(sweep.hold_out(fired, gt, totals))


@query("pick_frequency", f"WITH {LOO_SQL} SELECT ordinal, count(*) AS picked FROM held GROUP BY ordinal ORDER BY picked DESC, ordinal")
def pick_frequency(spark, d):
    fired, gt, totals = grid_run(spark, d, presets.held_out_fire_grid(), reuse=True)
    return sweep.pick_frequency(sweep.hold_out(fired, gt, totals))


# ---- thresholds on one score ------------------------------------------------------

def cross_sql(levels=presets.CROSSING_THRESHOLDS, score: str = "smoke", clips: str = EVENT_CLIPS_SQL) -> str:
    return f"""{SIGNAL_SQL}, {TRUTH_SQL}, {clips},
rules(ordinal, threshold) AS (VALUES {', '.join(f'({i}, {t}e0)' for i, t in enumerate(levels))}),
fired AS (SELECT ordinal, clip, min(t) + 10 AS alarm FROM rules JOIN sig ON {score} >= threshold GROUP BY ordinal, clip),
verdicts AS (SELECT r.ordinal, threshold, g.clip, g.start_s, alarm, {VERDICT_SQL} AS verdict
  FROM rules r CROSS JOIN ev_gt g LEFT JOIN fired f ON f.ordinal = r.ordinal AND f.clip = g.clip),
counts AS (SELECT ordinal, threshold, count(*) FILTER (verdict = 'hit') AS tp, count(*) FILTER (verdict <> 'hit' AND start_s IS NOT NULL) AS fn,
  count(*) FILTER (verdict = 'false') AS fp FROM verdicts GROUP BY ALL)"""


CROSS_SQL = cross_sql()


def crossing_run(spark, d, levels=presets.CROSSING_THRESHOLDS, score: str = "smoke", clips=events_only):
    table_ = sweep.rule_table(spark, [(t,) for t in levels], ["threshold"])
    gt = clips(spark, d)
    # one pass: the first time above each level, then one row per level reached
    firsts = signal(spark, d).groupBy("clip").agg(
        *[F.min(F.when(F.expr(score) >= th, F.col("t"))).alias(f"t{i}") for i, th in enumerate(levels)]
    )
    fired = firsts.select(
        "clip", F.posexplode(F.array(*[F.col(f"t{i}") for i in range(len(levels))])).alias("ordinal", "onset")
    ).filter(F.col("onset").isNotNull())
    return sweep.fired_verdicts(fired, gt, 10.0), gt, table_


@query("threshold_scores", f"WITH {CROSS_SQL} SELECT ordinal, threshold, tp, fn, fp, round_even({f1_sql(digits=None)}, 6) AS f1 FROM counts")
def threshold_scores(spark, d):
    fired, gt, levels = crossing_run(spark, d)
    return sweep.sweep_totals(fired, gt, levels, None).withColumn("f1", F.bround("f1", 6))


@query(
    "leave_one_out_threshold",
    f"""WITH {cross_sql(presets.SEQUENCE_THRESHOLDS, 'fire * 10 - 2')},
    mine AS (SELECT v.clip, v.ordinal, CASE WHEN verdict = 'hit' THEN 1 ELSE 0 END AS m_tp, CASE WHEN verdict = 'hit' THEN 0 ELSE 1 END AS m_fn,
       CASE WHEN verdict = 'false' THEN 1 ELSE 0 END AS m_fp, tp, fn, fp FROM verdicts v JOIN counts c USING (ordinal)),
    ranked AS (SELECT *, {f1_sql('(tp - m_tp)', '(fn - m_fn)', '(fp - m_fp)', None)} AS f1_rest FROM mine),
    held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY f1_rest DESC, ordinal) AS rn FROM ranked) WHERE rn = 1)
    SELECT clip, ordinal, m_tp AS tp, m_fn AS fn, m_fp AS fp FROM held""",
)
def leave_one_out_threshold(spark, d):
    fired, gt, levels = crossing_run(spark, d, presets.SEQUENCE_THRESHOLDS, "fire * 10D - 2D")
    held = sweep.hold_out(fired, gt, sweep.sweep_totals(fired, gt, levels, None), None)
    return held.select("clip", "ordinal", *[F.col(c).cast("int").alias(c) for c in ("tp", "fn", "fp")])


FOLD_SQL = "CAST(('0x' || substr(md5(CAST(clip AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER)"


@query(
    "fold_median_threshold",
    f"""WITH {cross_sql(clips=ALL_CLIPS_SQL)}, vf AS (SELECT *, {FOLD_SQL} AS fold FROM verdicts),
    cell AS (SELECT f.fold, v.ordinal, v.threshold, count(*) FILTER (v.fold <> f.fold AND verdict = 'hit') AS tp,
        count(*) FILTER (v.fold <> f.fold AND verdict <> 'hit' AND start_s IS NOT NULL) AS fn, count(*) FILTER (v.fold <> f.fold AND verdict = 'false') AS fp
      FROM vf v CROSS JOIN (SELECT unnest(range(5)) AS fold) f GROUP BY ALL),
    s AS (SELECT *, {f1_sql(digits=None)} AS f1 FROM cell),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, ordinal) AS rn FROM s) WHERE rn = 1)
    SELECT median(threshold) AS adopted, round_even(avg(f1), 6) AS mean_f1, round_even(stddev_pop(f1), 6) AS std_f1,
           round_even(min(f1), 6) AS min_f1, round_even(max(f1), 6) AS max_f1 FROM b""",
)
def fold_median_threshold(spark, d):
    fired, gt, levels = crossing_run(spark, d, clips=all_clips)
    best = sweep.fold_best(fired, gt, levels, 5, sweep.fold_of(F.col("clip"), 5))
    cols = ("mean_f1", "std_f1", "min_f1", "max_f1")
    return sweep.adopt_median(best).withColumns({c: F.bround(c, 6) for c in cols})


@query(
    "leave_one_location_out",
    f"""WITH {CROSS_SQL}, v2 AS (SELECT *, clip % 10 AS loc FROM verdicts),
    per AS (SELECT loc, ordinal, count(*) FILTER (verdict = 'hit') AS m_tp, count(*) FILTER (verdict <> 'hit') AS m_fn,
       count(*) FILTER (verdict = 'false') AS m_fp FROM v2 GROUP BY ALL),
    ranked AS (SELECT p.*, {f1_sql('(tp - m_tp)', '(fn - m_fn)', '(fp - m_fp)')} AS f1_rest FROM per p JOIN counts USING (ordinal)),
    held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY f1_rest DESC, ordinal) AS rn FROM ranked) WHERE rn = 1)
    SELECT loc, ordinal, f1_rest, m_tp AS tp, m_fn AS fn, m_fp AS fp FROM held""",
)
def leave_one_location_out(spark, d):
    fired, gt, levels = crossing_run(spark, d)
    gt = gt.withColumn("loc", F.col("clip") % 10)
    totals = sweep.sweep_totals(fired, gt, levels)
    return sweep.hold_out(fired, gt, totals, group="loc")


# ---- fusing models -----------------------------------------------------------------

FUSED_SQL = f"""{SIGNAL_SQL},
models AS (SELECT clip, round_even(t, 2) AS t, fire, smoke, 0 AS model FROM sig
  UNION ALL SELECT clip, round_even(t, 2), smoke * 0.5e0, fire, 1 FROM sig WHERE fire < 0.6e0
  UNION ALL SELECT clip, round_even(t, 2), fire * 0.8e0, smoke * 0.8e0, 2 FROM sig WHERE smoke >= 0.05e0),
combos(combo, members) AS (VALUES (0, [0, 1]), (1, [0, 2]), (2, [1, 2]), (3, [0, 1, 2]))"""


def three_models(spark, d, joint: bool = False) -> list[DataFrame] | DataFrame:
    """The signal and two stand-ins for other models, which lack some samples; ``joint``: a row holds the samples of all, ``m0, m1, m2``."""
    sig = signal(spark, d)
    if joint:
        sample = lambda fire, smoke: F.struct(fire.alias("fire"), smoke.alias("smoke"))
        fire, smoke = F.col("fire"), F.col("smoke")
        return sig.select(
            "clip", "t", sample(fire, smoke).alias("m0"), F.when(fire < 0.6, sample(smoke * 0.5, fire)).alias("m1"),
            F.when(smoke >= 0.05, sample(fire * 0.8, smoke * 0.8)).alias("m2"),
        )
    second = sig.filter(F.col("fire") < 0.6).select("clip", "t", (F.col("smoke") * 0.5).alias("fire"), F.col("fire").alias("smoke"))
    third = sig.filter(F.col("smoke") >= 0.05).select("clip", "t", (F.col("fire") * 0.8).alias("fire"), (F.col("smoke") * 0.8).alias("smoke"))
    return [sig, second, third]


@query(
    "fused_signal",
    f"""WITH {FUSED_SQL}, m2 AS (SELECT clip, t, model, max(fire) AS fire, max(smoke) AS smoke FROM models GROUP BY ALL)
    SELECT combo, clip, t, max(fire) AS fire_max, max(smoke) AS smoke_max, min(fire) AS fire_min, min(smoke) AS smoke_min,
           round_even(avg(fire), 9) AS fire_mean, round_even(avg(smoke), 9) AS smoke_mean
    FROM m2 JOIN combos ON list_contains(members, model) GROUP BY combo, members, clip, t HAVING count(*) = len(members)""",
)
def fused_signal(spark, d):
    out = joins.fuse_models(three_models(spark, d))
    return out.withColumns({"fire_mean": F.bround("fire_mean", 9), "smoke_mean": F.bround("smoke_mean", 9)})


@query("fused_sweep_405", f"""WITH {grid_sql(presets.fused_grid(), prefix=f'''{SIGNAL_SQL.replace("sig AS", "sig0 AS", 1)},
sig AS (SELECT clip, round_even(t, 2) AS t, max(greatest(fire, smoke * 0.5e0)) AS fire, max(greatest(smoke, fire)) AS smoke FROM sig0 GROUP BY ALL),
six AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS idx FROM sig)''')}
SELECT ordinal, tp, fn, fp, f1 FROM totals""")
def fused_sweep_405(spark, d):
    sig = signal(spark, d)
    second = sig.select("clip", "t", (F.col("smoke") * 0.5).alias("fire"), F.col("fire").alias("smoke"))
    fused = joins.fuse_models([sig, second]).select("clip", "t", F.col("fire_max").alias("fire"), F.col("smoke_max").alias("smoke"))
    ix = rules.index_samples(fused, seconds=WIDTH_S).join(rules.baseline(fused, "smoke"), "clip", "left").na.fill(0.0, ["smoke_base"])
    return grid_run(spark, d, presets.fused_grid(), ix)[2].select("ordinal", "tp", "fn", "fp", "f1")


MODELS, COMBOS, HOWS = 3, ((0, 1), (0, 2), (1, 2), (0, 1, 2)), ("max", "mean", "min")
# variants: each model alone, then every combination in each of the three ways
VARIANTS = [str(m) for m in range(MODELS)] + ["+".join(map(str, c)) + " " + how for c in COMBOS for how in HOWS]


def _variant_sql() -> str:
    parts = [f"SELECT {m} AS variant, clip, t, fire, smoke FROM models WHERE model = {m}" for m in range(MODELS)]
    for n, (combo, how) in enumerate((c, h) for c in COMBOS for h in HOWS):
        mixed = []
        for v in ("f", "s"):
            cols = [f"{v}{m}" for m in combo]
            mixed.append(f"({' + '.join(cols)}) / {len(cols)}e0" if how == "mean" else f"{'greatest' if how == 'max' else 'least'}({', '.join(cols)})")
        present = " AND ".join(f"f{m} IS NOT NULL" for m in combo)
        parts.append(f"SELECT {MODELS + n}, clip, t, {mixed[0]}, {mixed[1]} FROM wide WHERE {present}")
    return " UNION ALL ".join(parts)


GROUP_SAMPLES = 4_000_000  # times that are searched at once: what the search itself writes does not grow with the input
CLIP_STEP = 10**12  # variant and clip as one number in the SQL
SEARCH_SQL = grid_sql(
    presets.fused_grid(),
    prefix=f"""{FUSED_SQL.replace("sig AS", "sig0 AS", 1).replace("FROM sig", "FROM sig0")},
wide AS (SELECT clip, t, {", ".join(f"max(CASE WHEN model = {m} THEN {c} END) AS {c[0]}{m}" for m in range(MODELS) for c in ("fire", "smoke"))} FROM models GROUP BY clip, t),
variants AS ({_variant_sql()}),
sig AS (SELECT CAST(variant * {CLIP_STEP} + clip AS BIGINT) AS clip, t, max(fire) AS fire, max(smoke) AS smoke FROM variants GROUP BY ALL),
six AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS idx FROM sig)""",
    clips=f"ev_gt AS (SELECT CAST(v * {CLIP_STEP} + clip AS BIGINT) AS clip, start_s FROM gt, (SELECT unnest(range({len(VARIANTS)})) AS v) WHERE start_s IS NOT NULL)",
)


@query(
    "fusion_search",
    f"""WITH {SEARCH_SQL}, per AS (SELECT clip // {CLIP_STEP} AS variant, ordinal, count(*) FILTER (verdict = 'hit') AS tp,
      count(*) FILTER (verdict <> 'hit') AS fn, count(*) FILTER (verdict = 'false') AS fp FROM verdicts GROUP BY ALL),
    sc AS (SELECT *, {f1_sql()} AS f1 FROM per),
    rk AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY f1 DESC, fp, ordinal) AS rn, max(f1) OVER (PARTITION BY variant) AS best FROM sc)
    SELECT [{", ".join(f"'{v}'" for v in VARIANTS)}][variant + 1] AS models, arg_min(ordinal, rn) AS ordinal, arg_min(tp, rn) AS tp, arg_min(fn, rn) AS fn,
      arg_min(fp, rn) AS fp, max(best) AS f1, count(*) FILTER (f1 >= best - 0.01e0) AS stable FROM rk GROUP BY variant""",
)
def fusion_search(spark, d):
    """Every model and every fusion of models over the whole grid: the best setting of each."""
    grid = presets.fused_grid()
    events = events_only(spark, d)
    # the index the sample has in a variant, its fire and smoke, and the smoke of the head; a row holds all variants
    variants = [(f"i{n}", f"f{n}", f"s{n}", f"s{n}_base") for n in range(MODELS)]
    fused = {}
    for n in range(len(COMBOS)):
        for how in HOWS:
            v = len(variants)
            fused |= {f"f{v}": F.col(f"c{n}.fire_{how}"), f"s{v}": F.col(f"c{n}.smoke_{how}")}
            variants.append((f"i{MODELS + n}", f"f{v}", f"s{v}", f"s{v}_base"))
    among = {f"i{n}": F.col(f"h{n}") for n in range(MODELS)}
    among |= {f"i{MODELS + n}": F.forall(F.array(*[F.col(f"f{m}").isNotNull() for m in c]), lambda x: x) for n, c in enumerate(COMBOS)}
    merged = lambda df: joins.fuse_models(df, models=MODELS).withColumns(fused)
    # a clip is a struct, as one without a name is a clip too
    gt = events.select(F.struct("clip").alias("clip"), "start_s")

    def counted(wide: DataFrame, about: DataFrame) -> DataFrame:
        """Counts of a group of clips; what was stored for it goes with it."""
        with passing(spark) as store:
            based = rules.index_samples(wide, among=among, reach=sweep.frame_reach(grid), about=about).filter("start_s IS NOT NULL")
            onsets = sweep.clip_onsets(merged(based.na.fill(0.0, [v[3] for v in variants])), grid, variants, store, ["start_s"])
            return checkpoint(sweep.variant_counts(sweep.fired_verdicts(onsets, None, rules.ALARM_DELAY_S)))

    with passing(spark) as store:
        # one sample per rounded time
        wide = store(joins.at_same_times(three_models(spark, d, joint=True), MODELS)).withColumn("clip", F.struct("clip"))
        # ground truth and base come along with the index
        about = store(gt.join(rules.baseline(merged(wide), [v[2] for v in variants]), "clip", "left"))
        groups = max(1, -(-wide.count() // GROUP_SAMPLES))
        group = F.pmod(F.xxhash64("clip"), F.lit(groups))
        counts = reduce(DataFrame.unionByName, [counted(wide.filter(group == g), about) for g in range(groups)])
    totals = checkpoint(sweep.variant_totals(counts, events, sweep.rule_table(spark, grid), len(VARIANTS)))
    names = F.array(*[F.lit(v) for v in VARIANTS])
    return sweep.best_of_variants(totals).select(F.get(names, F.col("variant")).alias("models"), "ordinal", "tp", "fn", "fp", "f1", "stable")
