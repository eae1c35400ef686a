"""Event rules against plain state machines, with pieces small enough to be cut everywhere."""

import random

import pytest
from pyspark.sql import functions as F

from clipwarden.operators import ordered, rules, scoring, sweep
from clipwarden.plans import presets


@pytest.fixture(autouse=True)
def small_pieces(monkeypatch):
    monkeypatch.setattr(ordered, "PIECE", 7)


def signals(seed, clips=6, n=60):
    rng = random.Random(seed)
    return [
        (f"c{c}", round(i * 0.5, 1), round(rng.random(), 2), round(rng.random(), 2))
        for c in range(clips)
        for i in range(rng.randrange(1, n))
    ]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "clip string, t double, fire double, smoke double")
    return rules.index_samples(df, seconds=3.0)


def n_of_m(samples, hit, n, m):
    queue = []
    for s in samples:
        queue = (queue + [(s[1], hit(s))])[-m:]
        if sum(h for _, h in queue) >= n:
            return next(t for t, h in queue if h), s[1]
    return None


def by_clip(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (4, 6), (7, 12), (3, 3)])
def test_n_of_m(spark, n, m):
    rows = signals(n * 100 + m)
    want = {c: n_of_m(s, lambda r: r[2] >= 0.6, n, m) for c, s in by_clip(rows).items()}
    got = {r.clip: (r.onset, r.fired_at) for r in rules.n_of_m(frame(spark, rows).filter("fire >= 0.6D"), n, m).collect()}
    assert got == {c: w for c, w in want.items() if w}


def test_isolated_spike_does_not_fire(spark):
    rows = [("a", i * 0.5, 0.9 if i in (2, 10) else 0.0, 0.92) for i in range(30)]
    assert rules.n_of_m(frame(spark, rows).filter("fire >= 0.5D"), 2, 3).count() == 0


def test_baseline_index(spark):
    rows = [("five", i * 0.5, 0.0, v) for i, v in enumerate((0.1, 0.2, 0.3, 0.4, 0.5))] + [("late", 61.0, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "clip string, t double, fire double, smoke double")
    assert {r.clip: r.smoke_base for r in rules.baseline(df, "smoke").collect()} == {"five": 0.5}


def boxes(seed, clips=5, n=70, dup=False):
    rng = random.Random(seed)
    out = []
    for c in range(clips):
        for i in range(rng.randrange(5, n)):
            for b in range(rng.randrange(0, 4)):
                out.append((f"c{c}", i, round(i * 0.5, 1), -1 if dup and b < 2 else b, b, rng.random() < 0.55))
            if not any(o[0] == f"c{c}" and o[1] == i for o in out):
                out.append((f"c{c}", i, round(i * 0.5, 1), None, 0, False))
    return out


def stays(samples, need, gap, settle, delay, since):
    runs, found, latest, last_new = {}, {}, None, None
    for i in sorted({s[1] for s in samples}):
        here = [s for s in samples if s[1] == i]
        t = here[0][2]
        for s in sorted(here, key=lambda s: s[4]):
            if not s[5]:
                continue
            n, start, at = runs.get(s[3], (0, None, None))
            if n == 0 or i - at - 1 > gap:
                n, start = 0, t
            runs[s[3]] = (n + 1, start, i)
            if n + 1 >= need and s[3] not in found:
                found[s[3]] = start if since else t
                latest = found[s[3]] if latest is None else max(latest, found[s[3]])
                last_new = t
        if latest is not None and t - last_new >= settle:
            return latest + delay
    return None if latest is None else latest + delay


@pytest.mark.parametrize("seed,hold,settle,dup", [(1, 1, 2.0, False), (2, 2, 4.0, False), (3, 3, 0.0, False), (4, 2, 3.0, True)])
def test_entrants(spark, seed, hold, settle, dup):
    rows = boxes(seed, dup=dup)
    df = spark.createDataFrame(rows, "clip string, idx long, t double, track int, box_no int, ok boolean")
    axis = rules.with_previous_time(df.select("clip", "idx", "t").distinct())
    got = {r.clip: r.alarm for r in rules.entrant_alarm(df.filter("ok"), axis, hold, settle, tie=["box_no"]).collect()}
    want = {c: stays(s, hold, 0, settle, 0.0, False) for c, s in by_clip_boxes(rows).items()}
    assert got == {c: w for c, w in want.items() if w is not None}


@pytest.mark.parametrize("seed,dwell,gap,settle", [(5, 2.0, 2, 3.0), (6, 3.0, 6, 5.0), (7, 1.5, 0, 0.0)])
def test_dwell(spark, seed, dwell, gap, settle):
    rows = boxes(seed)
    df = spark.createDataFrame(rows, "clip string, idx long, t double, track int, box_no int, ok boolean")
    axis = rules.with_previous_time(df.select("clip", "idx", "t").distinct())
    got = {r.clip: r.alarm for r in rules.dwell_alarm(df.filter("ok"), axis, dwell, gap, settle, 10.0, tie=["box_no"]).collect()}
    want = {c: stays(s, int(dwell * 2), gap, settle, 10.0, True) for c, s in by_clip_boxes(rows).items()}
    assert got == {c: w for c, w in want.items() if w is not None}


def test_stay_grids(spark):
    rows = boxes(8, clips=6)
    df = spark.createDataFrame(rows, "clip string, idx long, t double, track int, box_no int, ok boolean")
    axis = rules.with_previous_time(df.select("clip", "idx", "t").distinct())
    samples = df.join(axis.select("clip", "idx", "prev_t"), ["clip", "idx"]).withColumns(
        {"conf": F.when(F.col("ok"), 0.6).otherwise(0.1), "foot": F.lit(True), "corners": F.lit(4)}
    )
    entry = [presets.EntryRule(c, 3, h, s) for c in (0.5, 0.7) for h in (1, 2, 3) for s in (0.0, 2.0, 5.0)]
    dwell = [presets.DwellRule(0.5, 0, w, 10, s, g) for w in (1, 2) for s in (0, 3) for g in (0, 2)]
    for family, grid in ((sweep.sweep_entries, entry), (sweep.sweep_dwells, dwell)):
        got = {(r.clip, r.ordinal): r.onset for r in family(samples, grid).collect()}
        want = {}
        for n, g in enumerate(grid):
            for c, s in by_clip_boxes(rows).items():
                if g.conf > 0.6:
                    continue
                if isinstance(g, presets.EntryRule):
                    alarm = stays(s, g.hold, 0, g.settle, 0.0, False)
                else:
                    alarm = stays(s, int(g.dwell * 2), g.gap, g.settle, g.delay, True)
                if alarm is not None:
                    want[c, n] = alarm
        assert got == want


def test_grid_sizes():
    sizes = {
        presets.rise_grid: 540, presets.fused_grid: 405, presets.detail_grid: 630, presets.gated_grid: 96, presets.held_out_fire_grid: 216,
        presets.held_out_entry_grid: 216, presets.held_out_dwell_grid: 864, presets.held_out_run_grid: 52, presets.fall_grid: 24,
    }
    for grid, n in sizes.items():
        assert len(grid()) == len(set(grid())) == n
    assert presets.fused_grid()[0][1:] == (0.10, None, None, 2, 2) and presets.fused_grid()[-1][1:] == (0.50, None, 0.5, 12, 6)


def by_clip_boxes(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_scorer_self_check(spark):
    truth = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0), ("d", None)], "clip string, start_s double")
    alarms = spark.createDataFrame([("a", 105.0), ("b", 200.0), ("d", 50.0)], "clip string, alarm double")
    r = scoring.score_alarms(alarms, truth).first()
    assert (r.tp, r.fn, r.fp, r.f1) == (1, 2, 2, 33.33)
    single = scoring.score_alarms(alarms, truth, penalty="single").first()
    assert (single.tp, single.fn, single.fp) == (1, 1, 2)
    edge = spark.createDataFrame([(98.0,), (110.0,), (97.99,), (110.01,)], "a double")
    assert [r.v for r in edge.select(scoring.verdict(F.col("a"), F.lit(100.0)).alias("v")).collect()] == ["hit", "hit", "false", "false"]


def test_sweep_and_hold_out_against_loops(spark):
    rows = signals(11, clips=8, n=50)
    clips = by_clip(rows)
    gt = {c: 10.0 + 3 * i for i, c in enumerate(sorted(clips))}
    grid = [presets._rise(f, r, w, h) for f in (0.5, 0.7) for w, h in ((3, 2), (6, 4)) for r in (None, 0.2)]

    def base(s):
        head = sorted(r[3] for r in s if r[1] <= 60)
        return head[min(int(len(head) * 0.8), len(head) - 1)]

    def verdict(c, g):
        b = base(clips[c])
        hit = lambda r: r[2] >= g.fire or (g.rise is not None and r[3] >= b + g.rise and r[3] >= 0.3)
        o = n_of_m(clips[c], hit, g.hits, g.win)
        if o is None:
            return "miss"
        return "hit" if gt[c] - 2 <= o[0] + 10 <= gt[c] + 10 else "false"

    table = {g: {c: verdict(c, g) for c in clips} for g in grid}

    def f1(vs):
        tp, fp = vs.count("hit"), vs.count("false")
        fn = len(vs) - tp
        r = tp / (tp + fn) if tp + fn else 0
        p = tp / (tp + fp) if tp + fp else 0
        return round(2 * r * p / (r + p) * 100, 2) if r + p else 0.0

    sig = frame(spark, rows)
    sig = sig.join(rules.baseline(sig, "smoke"), "clip", "left").na.fill(0.0, ["smoke_base"])
    truth = spark.createDataFrame(list(gt.items()), "clip string, start_s double")
    fired = sweep.fired_verdicts(sweep.sweep_onsets(sig, grid), truth, 10.0)
    totals = sweep.sweep_totals(fired, truth, sweep.rule_table(spark, grid))
    got = {r.ordinal: (r.tp, r.fn, r.fp, r.f1) for r in totals.collect()}
    for i, g in enumerate(grid):
        vs = list(table[g].values())
        assert got[i] == (vs.count("hit"), len(vs) - vs.count("hit"), vs.count("false"), f1(vs))
    held = {r.clip: r.ordinal for r in sweep.hold_out(fired, truth, totals).collect()}
    for c in clips:
        scores = [f1([v for k, v in table[g].items() if k != c]) for g in grid]
        assert held[c] == scores.index(max(scores))


def test_no_window_spans_a_whole_clip(spark):
    """Ordered work on samples is always partitioned by more than the clip."""
    rows = signals(3)
    hits = frame(spark, rows).filter("fire >= 0.6D")
    plan = rules.n_of_m(hits, 4, 6)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "lag" in line.lower()]
    assert windows and all("_piece" in w for w in windows)


def test_rounded_vectors_and_keypoints(spark):
    """Rounding equals ``bround`` on floats, ties, signs and nulls included; keypoints are written by one lambda."""
    from clipwarden.plans import feature_queries as FQ

    values = [0.03125, 0.09375, -0.03125, -0.00001, 0.0, 0.12345, 639.99995, float("inf"), None, 1e30, 3.4e-39, 0.5, 2.00005]
    df = spark.createDataFrame([(1, values), (2, None), (3, [])], "id int, v array<float>")
    got = {r.id: r.v for r in df.select("id", FQ._rounded(F.col("v"), 4).alias("v")).collect()}
    want = {r.id: r.v for r in df.select("id", FQ._whole(F.col("v"), 4).alias("v")).collect()}
    assert repr(got) == repr(want)
    kp = FQ.keypoints(spark, "/root/testdata/sf0.001")
    assert kp._jdf.queryExecution().optimizedPlan().toString().count("struct(x") == 1
    first = kp.orderBy("image", "slot").first().kp
    assert len(first) == 17 and all(0 <= p.x < 640 and 0 <= p.y < 480 and 0 <= p.c < 1 for p in first)
