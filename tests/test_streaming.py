"""Streams cut into several micro-batches give the batch result."""

import random

from clipwarden.operators import rules, tracking
from clipwarden.streaming import online, ordered
from clipwarden.streaming.run import run_available


def as_stream(spark, df, folder, parts, by):
    """Writes ``df`` as several files in time order and reads them one per batch."""
    rows = sorted(df.collect(), key=lambda r: r[by])
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size : (i + 1) * size]
        if chunk:
            spark.createDataFrame(chunk, df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_onset_over_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, i * 0.5, rng.random() < 0.35) for c in range(5) for i in range(80)]
    df = spark.createDataFrame(rows, "clip long, t double, hit boolean")
    got = {r.clip: r.onset for r in run_available(online.online_onset(as_stream(spark, df, tmp_path / "s", 7, "t"), 4, 6))[0].collect()}
    batch = rules.n_of_m(rules.index_samples(df).filter("hit"), 4, 6)
    assert got == {r.clip: r.onset for r in batch.collect()} and got


def test_tracks_over_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for clip in range(2):
        at = [[rng.uniform(0, 900), rng.uniform(0, 400)] for _ in range(3)]
        for idx in range(60):
            for n, p in enumerate(at):
                p[0] += rng.uniform(-20, 20)
                if rng.random() < 0.6:
                    rows.append((clip, idx, n, rng.random(), p[0], p[1], p[0] + 40, p[1] + 80))
    df = spark.createDataFrame(rows, "clip long, idx long, box_no long, conf double, x1 double, y1 double, x2 double, y2 double")
    live, _ = run_available(online.online_tracks(as_stream(spark, df, tmp_path / "s", 5, "idx")))
    got = {(r.clip, r.idx, r.box_no): r.track for r in live.collect()}
    want = {(r.clip, r.idx, r.box_no): r.track for r in tracking.track_people(df, piece=16).collect()}
    assert got == want


def test_late_rows_are_counted(spark, tmp_path):
    ddl = "clip long, ts timestamp, cls int, conf double"
    first = spark.sql("select 1L clip, timestamp'2024-01-01 00:10:00' ts, 0 cls, 0.5D conf")
    late = spark.sql("select 1L clip, timestamp'2024-01-01 00:00:01' ts, 0 cls, 0.9D conf")
    folder = str(tmp_path / "in")
    first.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder)
    grid = online.sample_grid(stream, width="1 second", late="10 seconds")
    q = grid.writeStream.outputMode("append").format("memory").queryName("late_grid").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(folder)
    q.processAllAvailable()
    n = online.late_rows(q)
    q.stop()
    assert n == 1


def test_streams_read_a_table_stored_as_a_folder(spark, tmp_path):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    for name in ("events", "lineitem", "customer", "orders"):
        whole = spark.read.parquet(f"{sf}/{name}.parquet")
        whole.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    queries = entry.queries()
    got = queries["stream_enriched"](spark, str(tmp_path))
    want = queries["stream_enriched"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert want.count() > 0


DDL = "clip long, t double, hit boolean, ts timestamp"


def arrivals(spark, rows, parts, ddl=DDL):
    size = -(-len(rows) // parts)
    return [spark.createDataFrame(rows[i * size : (i + 1) * size], ddl).coalesce(1) for i in range(parts)]


def at(t):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t)


def test_samples_out_of_order_give_the_batch_onset(spark):
    rng = random.Random(4)
    rows = [(c, i * 0.5, rng.random() < 0.35, at(i * 0.5)) for c in range(4) for i in range(60)]
    shuffled = sorted(rows, key=lambda r: r[1] + rng.random() * 4)
    late = [(0, 0.0, True, at(0.0)), (1, 1.0, True, at(1.0))]  # long after the rest of their clips
    got, query = ordered.run_to_the_end(
        lambda s: ordered.live_onsets(s, 4, 6, late_s=5, idle_s=20, horizon_s=3600), arrivals=[*arrivals(spark, shuffled, 3), spark.createDataFrame(late, DDL)]
    )
    found = got.collect()
    batch = rules.n_of_m(rules.index_samples(spark.createDataFrame(rows, DDL)).filter("hit"), 4, 6)
    assert {r.clip: r.value for r in found if r.kind == "alarm"} == {r.clip: r.onset for r in batch.collect()}
    assert sorted((r.clip, r.ts) for r in found if r.kind == "late") == [(r[0], r[3]) for r in late]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_clips_that_end_in_the_wait_give_their_alarm(spark):
    """Two boxes in a row, then the clip ends before 24 quiet seconds have passed; another one is quiet for long enough."""
    ddl = "clip long, ts timestamp, t double, track long, qualified boolean"
    rows = [(1, at(t), t, 7 if t < 3 else None, t < 3) for t in (0.0, 1.0, 2.0, 3.0)] + [(2, at(t), t, 5, t < 2) for t in (0.0, 1.0, 30.0, 31.0)]
    rows += [(3, at(t), t, 1, False) for t in (0.0, 9.0)]
    got, query = ordered.run_to_the_end(
        lambda s: ordered.live_stays(s, 2, 0, 24.0, late_s=1, idle_s=10), arrivals=arrivals(spark, sorted(rows, key=lambda r: r[2]), 2, ddl)
    )
    assert sorted((r.clip, r.value) for r in got.collect()) == [(1, 1.0), (2, 1.0)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_boxes_of_a_clip_are_cut_into_samples_from_lists():
    import pandas as pd

    from clipwarden.streaming.online import box_samples

    rows = [(2, 5, 0.5, 1.0), (1, 9, 0.2, 2.0), (1, 3, 0.9, 3.0), (2, 4, 0.5, 4.0), (1, 7, float("nan"), 5.0)]
    frame = pd.DataFrame([(i, b, c, x, x, x + 1, x + 1) for i, b, c, x in rows], columns=["idx", "box_no", "conf", "x1", "y1", "x2", "y2"])
    corners = lambda x: (x, x, x + 1, x + 1)
    want = [(1, [(3, corners(3.0)), (9, corners(2.0)), (7, corners(5.0))]), (2, [(4, corners(4.0)), (5, corners(1.0))])]
    assert list(box_samples(iter([frame]))) == want
    assert list(box_samples(iter([frame[:2], frame[2:]]))) == want


def test_a_clip_costs_few_messages_to_the_state_store():
    """One value is read and written per clip and batch, and a clip has one timer, set anew where the clip has gone on."""
    import pandas as pd

    calls, timers = [], []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            timers.append(at)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    p = ordered._Ordered(ordered.OnsetRule(2, 3), {"t": "double", "hit": "boolean", "track": "bigint"}, "clip", 5_000_000, 20_000_000)
    p.rule = type("Seen", (ordered.OnsetRule,), {"step": lambda self, s, rows: (rows[0][1], float(len(rows))) if len(rows) > 1 else None})(2, 3)
    p.init(Handle())
    batch = lambda *s: iter([pd.DataFrame([(int(t * 1e6), t, True, k) for t, k in s], columns=["us", "t", "hit", "track"])])
    assert list(p.handleInputRows((1,), batch((3.0, 7.0), (2.0, None)), Now(0))) == []
    assert p.clip.held[-1] == "[[3000000, 3.0, true, 7], [2000000, 2.0, true, null]]"
    assert list(p.handleInputRows((1,), batch((4.0, 1)), Now(0))) == []
    assert calls == ["get", "update"] * 2 and timers == [23_000]
    assert list(p.handleExpiredTimer((1,), Now(23_500), None)) == [] and timers == [23_000, 24_000]
    (out,) = p.handleExpiredTimer((1,), Now(24_500), None)
    assert out.values.tolist()[0][:4] == [1, "alarm", 2.0, 3.0] and p.clip.held is None
