"""The packed onset sweep against a plain loop."""

import random

from pyspark.sql import functions as F

from clipwarden.operators import ordered, sweep
from clipwarden.plans.presets import FireRule


def _first(samples, rule):
    """Onset of the first full frame, sample by sample; None and NaN as Spark compares them."""

    def at_least(v, level):
        return v is not None and (v != v or v >= level)

    hits = []
    for idx, t, fire, smoke in samples:
        if at_least(fire, rule.fire) or (rule.rise is not None and at_least(smoke, max(0.25 + rule.rise, sweep.S.SMOKE_FLOOR))):
            hits.append((idx, t))
            if len(hits) >= rule.hits and idx - hits[-rule.hits][0] < rule.win:
                return hits[-rule.hits][1]
    return None


def test_packed_onsets_cross_batches_and_pieces(spark, monkeypatch):
    rng = random.Random(5)
    level = lambda: rng.choice([None, float("nan"), 0.9, 0.5]) if rng.random() < 0.04 else rng.random() * 0.6
    clips = {c: [(i, i * 0.5, level(), level()) for i in range(n)] for c, n in (("a", 150), ("b", 3), ("c", 70), ("d", 1))}
    rules = [
        FireRule("smoke_rise", fire, None, rise, win, hits)
        for fire in (0.4, 0.55, 2.0) for win, hits in ((1, 1), (4, 3), (9, 5)) for rise in (None, 0.3)
    ]
    rows = [(c, *s, 0.25) for c, samples in clips.items() for s in samples]
    monkeypatch.setattr(ordered, "PIECE", 32)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "clip string, idx long, t double, fire double, smoke double, smoke_base double")
        packed = sweep.clip_onsets(df.selectExpr("struct(1 AS variant, clip) AS clip", "idx", "t", "fire", "smoke", "smoke_base"), rules)
        found = {r.clip.clip: list(r.onsets) for r in packed.collect()}
        by_row = {(r.clip, r.ordinal): r.onset for r in sweep.sweep_onsets(df, rules).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = {c: [_first(samples, r) for r in rules] for c, samples in clips.items()}
    assert found == {c: onsets for c, onsets in wanted.items() if any(o is not None for o in onsets)}
    assert by_row == {(c, i): o for c, onsets in wanted.items() for i, o in enumerate(onsets) if o is not None}


def test_hold_out_ranks_silent_rules_once(spark):
    rng = random.Random(9)
    rules, clips = 12, [f"c{i}" for i in range(14)]
    loc = {c: i % 4 for i, c in enumerate(clips)}
    # no rule fires in the first clip, all in the second and the third; one clip has no event
    start = {c: None if c == "c5" else 10.0 for c in clips}
    share = {"c0": 0.0, "c1": 1.0, "c2": 1.0}
    fired = {(c, o): rng.choice(["hit", "false"]) if start[c] else "false" for c in clips for o in range(rules) if rng.random() < share.get(c, 0.5)}
    rows = spark.createDataFrame([(c, o, v) for (c, o), v in fired.items()], "clip string, ordinal int, verdict string")
    truth = spark.createDataFrame([(c, start[c], loc[c]) for c in clips], "clip string, start_s double, loc int")
    grid = spark.createDataFrame([(o, o / 10) for o in range(rules)], "ordinal int, level double")
    totals = sweep.sweep_totals(rows, truth, grid)

    def counts(o, members):
        tp = sum(fired.get((c, o)) == "hit" for c in members)
        return tp, sum(start[c] is not None for c in members) - tp, sum(fired.get((c, o)) == "false" for c in members)

    def f1(tp, fn, fp):
        r, p = tp / (tp + fn) if tp + fn else 0.0, tp / (tp + fp) if tp + fp else 0.0
        return round(2 * r * p / (r + p) * 100 if r + p else 0.0, 2)

    for group, member in (("clip", {c: c for c in clips}), ("loc", loc)):
        held = sweep.hold_out(rows, truth, totals, group=group)
        got = {r[group]: (r.ordinal, round(r.f1_rest, 2), r.tp, r.fn, r.fp) for r in held.collect()}
        for g in set(member.values()):
            mine, others = [c for c in clips if member[c] == g], [c for c in clips if member[c] != g]
            best = max(range(rules), key=lambda o: (f1(*counts(o, others)), -o))
            assert got[g] == (best, f1(*counts(best, others)), *counts(best, mine))
        # a map of a group's rules, searched from its start for every rule, is quadratic in the grid
        assert "map_from_entries" not in held._jdf.queryExecution().toString()


def test_places_are_tested_once(spark, tmp_path):
    """The polygon test costs more than all predicates of a grid and is not repeated in each."""
    from datetime import datetime, timedelta

    from clipwarden.plans import heldout_queries as H

    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 3, "click", 50.0 + i % 40, '{"k": 60}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet"
    )
    placed = H.zoned(spark, str(tmp_path), ["Loitering", "Intrusion"])
    assert placed.count() == 60
    stays = sweep.sweep_entries(placed, H.presets.held_out_entry_grid())
    assert "poly" not in stays._jdf.queryExecution().optimizedPlan().toString()


def test_variants_of_a_row_equal_tables_of_their_own(spark):
    """Pieces, batches and rims: samples a variant lacks, clips of one and of many pieces, a clip without a name."""
    from clipwarden.operators import rules as R
    from clipwarden.session import passing

    rng = random.Random(11)
    level = lambda: rng.choice([None, float("nan"), 0.9]) if rng.random() < 0.04 else rng.random() * 0.6
    share = {"x": 1.0, "y": 0.5, "z": 0.05}
    rows = []
    for clip, n in (("a", 300), ("b", 3), (None, 120), ("c", 60), ("d", 1)):
        for i in range(n):
            rows.append((clip, i * 0.5, *[v for s in share.values() for v in (rng.random() < s, level(), level())]))
    names = ", ".join(f"h_{v} boolean, f_{v} double, s_{v} double" for v in share)
    df = spark.createDataFrame(rows, f"clip string, t double, {names}").withColumn("clip", F.struct("clip"))
    grid = [FireRule("smoke_rise", fire, None, rise, win, hits) for fire in (0.4, 0.55) for win, hits in ((1, 1), (4, 3), (9, 5)) for rise in (None, 0.1)]
    variants = [(f"i_{v}", f"f_{v}", f"s_{v}", f"s_{v}_base") for v in share]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        own = {}
        for i, v in enumerate(share):
            one = df.filter(f"h_{v}").select("clip", "t", F.col(f"f_{v}").alias("fire"), F.col(f"s_{v}").alias("smoke"))
            base = R.baseline(one, "smoke")
            onsets = sweep.clip_onsets(R.index_samples(one).join(base, "clip", "left").na.fill(0.0, ["smoke_base"]), grid)
            own |= {(i, r.clip.clip): list(r.onsets) for r in onsets.collect()}
        base = R.baseline(df.withColumns({f"s_{v}": F.when(F.col(f"h_{v}"), F.col(f"s_{v}")) for v in share}), [v[2] for v in variants])
        for seconds in (3.0, 8.0, 1800.0):
            with passing(spark) as store:
                among = {f"i_{v}": F.col(f"h_{v}") for v in share}
                placed = R.index_samples(df, seconds=seconds, among=among, reach=sweep.frame_reach(grid), about=base)
                packed = sweep.clip_onsets(placed.na.fill(0.0, [v[3] for v in variants]), grid, variants, store)
                assert {(r.clip.variant, r.clip.clip.clip): list(r.onsets) for r in packed.collect()} == own
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k for k in own if k[1] is None}


def test_fusion_search_keeps_one_row_per_sample(spark, tmp_path, monkeypatch):
    """Fifteen variants are columns: rows of their own were shuffled and stored again and again."""
    import os
    from datetime import datetime, timedelta

    from clipwarden.plans import signal_queries as Q

    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i % 4, "purchase" if i % 9 == 0 else "click", 30.0 + i % 90, f'{{"k": {i * 7 % 100}}}') for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    seen, real = [], sweep.clip_onsets
    monkeypatch.setattr(sweep, "clip_onsets", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    found = Q.fusion_search(spark, str(tmp_path))
    assert found.count() == len(Q.VARIANTS)
    assert seen == [Q.signal(spark, str(tmp_path)).select("clip", F.bround("t", 2)).distinct().count()]
    # groups of clips add up to the same
    monkeypatch.setattr(Q, "GROUP_SAMPLES", 150)
    assert sorted(map(tuple, Q.fusion_search(spark, str(tmp_path)).collect())) == sorted(map(tuple, found.collect()))
    assert len(seen) > 2 and sum(seen[1:]) == seen[0]
    # what it stored on its way is gone
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [d for d in os.listdir(top) if d.startswith("clipwarden-")]
