"""Registered queries that select rules of all four items on held-out clips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..operators import joins, rules, sweep
from ..session import checkpoint
from . import presets
from .inputs import BOXES_SQL, TRUTH_SQL, ZONE_TAG_SQL, boxes, f1_sql, inside_sql, zones
from .registry import query
from .signal_queries import (
    CURVE_SQL, HELD_SQL, LOO_SQL, RULE_SCORES_SQL, WIDTH_S, _values, curves, events_only, with_base,
)


def zoned(spark, d, tags: list[str]) -> DataFrame:
    """Boxes on the sample axis with what the grids ask about their place.

    Written once: the optimizer would test the polygon anew in every predicate of a grid.
    """
    ix = rules.with_previous_time(rules.index_samples(boxes(spark, d), seconds=WIDTH_S))
    b, poly = F.col("box"), F.col("poly")
    return checkpoint(joins.zone_of_clip(ix, zones(spark), tags).select(
        "clip", "idx", "t", "prev_t", "track", "conf",
        G.foot_inside(b, poly).alias("foot"), G.corners_inside(b, poly).alias("corners"),
    ))


# item -> rule family, samples, grid, delay of the alarm
ITEMS = {
    "fire": (sweep.clip_onsets, with_base, presets.held_out_fire_grid(), rules.ALARM_DELAY_S),
    "intrusion": (sweep.sweep_entries, lambda spark, d: zoned(spark, d, ["Intrusion"]), presets.held_out_entry_grid(), 0.0),
    "loiter": (sweep.sweep_dwells, lambda spark, d: zoned(spark, d, ["Loitering", "Intrusion"]), presets.held_out_dwell_grid(), 0.0),
    "fall": (sweep.sweep_runs, curves, presets.held_out_run_grid(), 0.0),
}


def item_run(spark, d, item: str, grid=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fired verdicts, ground truth and totals of one item."""
    family, samples, own_grid, delay = ITEMS[item]
    gt = events_only(spark, d)
    fired, totals = sweep.evaluate(family, samples(spark, d), grid or own_grid, gt, delay)
    return fired, gt, totals


def held_rows(spark, d, item: str) -> DataFrame:
    """Per held-out clip the setting chosen without it and what it gives there; ``tp = 0`` marks the failures."""
    held = sweep.hold_out(*item_run(spark, d, item))
    return held.withColumns({c: F.col(c).cast("int") for c in ("tp", "fn", "fp")})


STAY_SQL = f"""{BOXES_SQL}, {{zone}},
flags AS (SELECT b.*,
  {inside_sql('(b.x1 + b.x2) / 2', 'b.y2')} AS foot,
  {inside_sql('b.x1', 'b.y1')}::INT + {inside_sql('b.x2', 'b.y1')}::INT + {inside_sql('b.x1', 'b.y2')}::INT + {inside_sql('b.x2', 'b.y2')}::INT AS n_corners
  FROM bix b LEFT JOIN zt ON zt.loc = b.loc),
{TRUTH_SQL}, ev_gt AS (SELECT * FROM gt WHERE start_s IS NOT NULL), {{rules}},
q AS (SELECT conf_at, corners, clip, track, idx, t FROM flags
  JOIN (SELECT DISTINCT conf AS conf_at, corners FROM rules) k ON foot AND flags.conf >= conf_at AND n_corners >= corners),
st AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY conf_at, corners, gap, clip, track ORDER BY idx) - 1 <= gap THEN 0 ELSE 1 END AS s
  FROM q CROSS JOIN (SELECT DISTINCT gap FROM rules)),
isl AS (SELECT *, sum(s) OVER (PARTITION BY conf_at, corners, gap, clip, track ORDER BY idx) AS g FROM st),
pos AS (SELECT *, row_number() OVER (PARTITION BY conf_at, corners, gap, clip, track, g ORDER BY idx) AS p,
  min(t) OVER (PARTITION BY conf_at, corners, gap, clip, track, g) AS since FROM isl),
det AS (SELECT conf_at, corners, gap, need, clip, track, arg_min({{value}}, idx) AS v, min(t) AS det_t
  FROM pos JOIN (SELECT DISTINCT need FROM rules) ON p >= need GROUP BY ALL),
times AS (SELECT conf_at, corners, gap, need, clip, det_t, max(v) AS v FROM det GROUP BY ALL),
nx AS (SELECT *, lead(det_t) OVER (PARTITION BY conf_at, corners, gap, need, clip ORDER BY det_t) AS next_at FROM times),
bf AS (SELECT nx.*, s.t AS before_t FROM nx ASOF LEFT JOIN bix s ON s.clip = nx.clip AND s.t < nx.next_at),
fin AS (SELECT conf_at, corners, gap, need, clip, settle, min(det_t) AS stop FROM bf CROSS JOIN (SELECT DISTINCT settle FROM rules)
  WHERE next_at IS NULL OR before_t - det_t >= settle GROUP BY ALL),
al AS (SELECT conf_at, corners, gap, need, clip, settle, max(v) AS alarm
  FROM times JOIN fin USING (conf_at, corners, gap, need, clip) WHERE det_t <= stop GROUP BY ALL),
fired AS (SELECT ordinal, clip, alarm + delay AS alarm FROM rules JOIN al
  ON conf_at = rules.conf AND al.corners = rules.corners AND al.gap = rules.gap AND al.need = rules.need AND al.settle = rules.settle),
{RULE_SCORES_SQL}"""


def _rules_sql(grid, extra: str) -> str:
    named = _values(grid, type(grid[0])._fields).replace("rules(", "given(", 1)
    return f"{named}, rules AS (SELECT *, {extra} FROM given)"


ENTRY_SQL = STAY_SQL.format(
    zone="zt AS (SELECT loc, max(CASE WHEN tag = 'Intrusion' THEN tag END) AS tag FROM edges GROUP BY loc)",
    rules=_rules_sql(presets.held_out_entry_grid(), "hold AS need, 0 AS gap, 0e0 AS delay"), value="t",
)
DWELL_SQL = STAY_SQL.format(
    zone=ZONE_TAG_SQL, rules=_rules_sql(presets.held_out_dwell_grid(), "dwell * 2 AS need"), value="since"
)


def run_sql(grid) -> str:
    """Run-length rules: the first place where all of the last ``need`` values reach the threshold."""
    return f"""{CURVE_SQL}, {TRUTH_SQL}, ev_gt AS (SELECT * FROM gt WHERE start_s IS NOT NULL), {_values(grid, presets.RunRule._fields)},
st AS (SELECT threshold, clip, track, idx, t, idx - row_number() OVER (PARTITION BY threshold, clip, track ORDER BY idx) AS g
  FROM cv JOIN (SELECT DISTINCT threshold FROM rules) ON z >= threshold),
pos AS (SELECT *, row_number() OVER (PARTITION BY threshold, clip, track, g ORDER BY idx) AS p,
  min(t) OVER (PARTITION BY threshold, clip, track, g) AS since FROM st),
fired AS (SELECT ordinal, clip, min(since) AS alarm FROM (
  SELECT ordinal, clip, track, arg_min(since, idx) AS since FROM pos JOIN rules ON rules.threshold = pos.threshold AND p >= need GROUP BY ALL)
  GROUP BY ordinal, clip),
{RULE_SCORES_SQL}"""


SCORES = {
    "fire": LOO_SQL,
    "intrusion": f"{ENTRY_SQL}, {HELD_SQL}",
    "loiter": f"{DWELL_SQL}, {HELD_SQL}",
    "fall": f"{run_sql(presets.held_out_run_grid())}, {HELD_SQL}",
}
HELD_ROWS = "SELECT clip, ordinal, f1_rest, m_tp AS tp, m_fn AS fn, m_fp AS fp FROM held"


@query("loo_intrusion", f"WITH {SCORES['intrusion']} {HELD_ROWS}")
def loo_intrusion(spark, d):
    return held_rows(spark, d, "intrusion")


@query("loo_loiter", f"WITH {SCORES['loiter']} {HELD_ROWS}")
def loo_loiter(spark, d):
    return held_rows(spark, d, "loiter")


@query("loo_fall", f"WITH {SCORES['fall']} {HELD_ROWS}")
def loo_fall(spark, d):
    return held_rows(spark, d, "fall")


@query("fall_sweep_24", f"WITH {run_sql(presets.fall_grid())} SELECT ordinal, threshold, need, tp, fn, fp, f1 FROM totals")
def fall_sweep_24(spark, d):
    return item_run(spark, d, "fall", presets.fall_grid())[2].select("ordinal", "threshold", "need", "tp", "fn", "fp", "f1")


def _report_sql(item: str) -> str:
    return f"""SELECT * FROM (WITH {SCORES[item]},
  c AS (SELECT CAST(sum(m_tp) AS BIGINT) AS tp, CAST(sum(m_fn) AS BIGINT) AS fn, CAST(sum(m_fp) AS BIGINT) AS fp FROM held),
  pk AS (SELECT ordinal, count(*) AS picked, min(clip) AS first FROM held GROUP BY ordinal)
  SELECT '{item}' AS item, (SELECT max(f1) FROM totals) AS f1_full, (SELECT ordinal FROM totals ORDER BY f1 DESC, ordinal LIMIT 1) AS best_full,
    tp, fn, fp, {f1_sql()} AS f1_held, CAST((SELECT sum(picked) FROM pk) AS BIGINT) AS clips, (SELECT max(picked) FROM pk) AS picked,
    (SELECT ordinal FROM pk ORDER BY picked DESC, first LIMIT 1) AS most_picked FROM c)"""


@query("loo_all_items", " UNION ALL ".join(_report_sql(item) for item in ITEMS))
def loo_all_items(spark, d):
    """Score on all clips against held-out score, for the four items."""
    reports = []
    for item in ITEMS:
        fired, gt, totals = item_run(spark, d, item)
        # the totals and the picks are read several times by the report
        report = sweep.held_out_report(checkpoint(sweep.hold_out(fired, gt, totals)), totals)
        reports.append(report.select(F.lit(item).alias("item"), "*"))
    return reduce(DataFrame.unionByName, reports)
