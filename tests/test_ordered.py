"""Positions, carries and rounds on one hot group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwarden.operators import curation, detection, joins, suppression
from clipwarden.operators.ordered import carry, next_value, running, with_position


def hot(spark, n=500, seed=1):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(100000), n))
    rows = [("hot", t / 10, rng.random()) for t in times] + [("cold", 5.0, 0.5)]
    return spark.createDataFrame(rows, "clip string, t double, v double"), rows


def test_position_and_running(spark):
    df, rows = hot(spark)
    bucket = F.floor("t").cast("long")
    got = [(r.t, r.idx) for r in with_position(df, ["clip"], ["t"], bucket).filter("clip = 'hot'").orderBy("t").collect()]
    assert [i for _, i in got] == list(range(500))
    top = running(df, ["clip"], ["t"], F.col("v"), bucket, "m", F.max, ahead=True, inclusive=True)
    values = [r[2] for r in rows[:-1]]
    assert [r.m for r in top.filter("clip = 'hot'").orderBy("t").collect()] == [max(values[i:]) for i in range(500)]


def test_carry_reaches_over_empty_buckets(spark):
    df, rows = hot(spark, 60)
    marked = df.withColumn("x", F.when(F.col("v") < 0.1, F.col("t")))
    bucket = F.floor(F.col("t") / 50).cast("long")
    last = carry(marked, ["clip"], ["t"], bucket, F.col("x"), "near").filter("clip = 'hot'").orderBy("t").collect()
    seen = None
    for r in last:
        seen = r.t if r.v < 0.1 else seen
        assert r.near == seen
    nxt = next_value(df, ["clip"], "t", bucket, "n").filter("clip = 'hot'").orderBy("t").collect()
    assert [r.n for r in nxt] == [r.t for r in nxt[1:]] + [None]


def test_nearest_prefers_the_earlier_one(spark):
    left = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("b", 3, 1.0)], "clip string, row_id long, t double")
    right = spark.createDataFrame([("a", 4.5, "x"), ("a", 5.5, "y"), ("a", 8.0, "z")], "clip string, t double, p string")
    got = {r.row_id: r.p for r in joins.nearest_within(left, right, ["p"]).collect()}
    assert got == {1: "x", 2: None, 3: None}


def test_keep_diverse_equals_sequential(spark):
    rng = np.random.default_rng(3)
    rows = []
    for clip, n in (("hot", 220), ("small", 3)):
        centers = rng.normal(size=(5, 8))
        for i in range(n):
            v = centers[rng.integers(5)] + rng.normal(size=8) * 0.15
            v = (v / np.linalg.norm(v)).astype(np.float32)
            rows.append((clip, i + (1000 if clip == "small" else 0), float(rng.integers(0, 40)) / 40, [float(x) for x in v]))
    df = spark.createDataFrame(rows, "clip string, id long, conf double, sig array<float>")
    got = {r.id for r in suppression.keep_diverse(df, ["clip"], [F.desc("conf"), F.asc("id")], "id", "sig", 0.9, 7, batch=4).collect()}
    want = set()
    for clip in ("hot", "small"):
        kept = []
        for r in sorted((r for r in rows if r[0] == clip), key=lambda r: (-r[2], r[1])):
            v = np.asarray(r[3], dtype=np.float32).astype(np.float64)
            if len(kept) < 7 and not any(float(v @ k) > 0.9 for k in kept):
                kept.append(v)
                want.add(r[1])
    assert got == want


def test_even_pick_positions(spark):
    df = spark.createDataFrame([(g, i) for g, n in ((3, 3), (7, 7), (12, 12)) for i in range(n)], "g int, i int")
    got = {}
    for r in curation.pick_even(df, ["g"], ["i"], F.lit(0), 6).collect():
        got.setdefault(r.g, set()).add(r.i)
    assert got == {3: {0, 1, 2}, 7: {int(i * (7 / 6)) for i in range(6)}, 12: {0, 2, 4, 6, 8, 10}}


def test_split_sizes(spark):
    rows = [(f"s{n}", f"s{n}-{i}") for n in (1, 2, 12, 13) for i in range(n)]
    df = spark.createDataFrame(rows, "stratum string, clip string")
    val = curation.stratified_split(df, ["stratum"], "clip").filter("split = 'val'").groupBy("stratum").count()
    assert {r.stratum: r["count"] for r in val.collect()} == {"s2": 1, "s12": 2, "s13": 3}


def test_average_precision_against_numpy(spark):
    rng = random.Random(5)
    dets, truths = [], []
    for image in range(60):
        for k in range(rng.randrange(0, 4)):
            x, y = rng.uniform(0, 500), rng.uniform(0, 500)
            truths.append((image, 0, image * 100 + k, (x, y, x + 50, y + 50)))
            if rng.random() < 0.7:
                s = rng.uniform(0, 20)
                dets.append((image, 0, image * 100 + k, round(rng.random(), 3), (x + s, y, x + 50 + s, y + 50)))
        for k in range(rng.randrange(0, 2)):
            dets.append((image, 0, image * 100 + 50 + k, round(rng.random(), 3), (900.0, 900.0, 950.0, 950.0)))
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    d = spark.createDataFrame(dets, f"image long, cls int, det_id long, conf double, box {box}")
    t = spark.createDataFrame(truths, f"image long, cls int, truth_id long, box {box}")
    judged = detection.match(d, t)
    ap = detection.average_precision(judged, t, (0.5,)).first().ap
    ranked = sorted(judged.collect(), key=lambda r: (-r.conf, r.image, r.det_id))
    hit = np.cumsum([len(r.hits) for r in ranked])
    recall = np.concatenate([[0.0], hit / len(truths), [1.0]])
    precision = np.concatenate([[1.0], hit / np.arange(1, len(ranked) + 1), [0.0]])
    envelope = np.flip(np.maximum.accumulate(np.flip(precision)))
    x = np.linspace(0, 1, 101)
    want = np.trapezoid(np.interp(x, recall, envelope), x)
    assert abs(ap - want) < 1e-9


def test_large_frames_are_suppressed_in_rounds(spark):
    from clipwarden.functions import geometry as G

    rng = random.Random(8)
    rows = []
    for image, n in ((0, 150), (1, 6), (2, 1)):
        for i in range(n):
            x, y = rng.uniform(0, 200), rng.uniform(0, 200)
            rows.append((image, (i, round(rng.random(), 2), x, y, x + 40, y + 40)))
    df = spark.createDataFrame(rows, "image int, b struct<id:int,conf:double,x1:double,y1:double,x2:double,y2:double>")
    order = [F.desc("b.conf"), F.asc("b.id")]
    run = lambda **k: {(r.image, r.b.id) for r in suppression.suppress_frames(df, ["image"], G.person_overlap(), order, **k).collect()}
    whole = run()
    assert run(limit=5, batch=7) == whole
    iou = lambda a, b: (lambda w, h: max(0, w) * max(0, h) / (3200 - max(0, w) * max(0, h)))(min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3]))
    contain = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3])) / 1600
    want = set()
    for image in (0, 1, 2):
        kept = []
        for b in sorted((r[1] for r in rows if r[0] == image), key=lambda b: (-b[1], b[0])):
            if all(iou(b, k) < 0.5 and contain(b, k) < 0.75 for k in kept):
                kept.append(b)
                want.add((image, b[0]))
    assert whole == want


def test_order_statistic_is_exact(spark):
    import statistics

    from clipwarden.operators.ordered import order_statistic

    rng = random.Random(8)
    groups = {
        "same": [3.25] * 50, "two": [1.0, 2.0], "one": [7.5], "odd": [rng.gauss(0, 1) for _ in range(501)], "even": [rng.gauss(0, 1e-3) for _ in range(400)],
        # most at one value, the rest over all magnitudes
        "wide": [0.5] * 300 + [10.0 ** rng.uniform(-300, 300) for _ in range(299)], None: [-1.5, 4.0, 4.0, 9.0],
        "small": [0.0, 5e-324, 1e-323, 1e-323, 1e-310], "large": [-1.7e308, -1.0, 1.0, 1.6e308, 1.7e308],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("odd", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r.quantile for r in order_statistic(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}
    low = {r.k: r.q for r in order_statistic(df, ["k"], "v", 0.0, "q").collect()}
    assert low == {k: min(v) for k, v in groups.items()}


def test_even_buckets_under_one_value(spark):
    from clipwarden.operators.ordered import in_even_buckets

    df = spark.range(20_000).selectExpr("if(id % 10 = 0, id / 20000D, 0.7D) AS conf", "id % 400 AS image", "id AS det_id")
    sizes = [r["count"] for r in in_even_buckets(df, ["conf", "image", "det_id"], "b").groupBy("b").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_order_statistic_takes_two_passes(spark, monkeypatch):
    """Also of values over all magnitudes in a group larger than a bracket may be."""
    import statistics

    from clipwarden.operators import ordered

    turns, real = [], ordered.checkpoint
    monkeypatch.setattr(ordered, "checkpoint", lambda df: turns.append(1) or real(df))
    monkeypatch.setattr(ordered, "WHOLE", 20_000, raising=False)
    rng = random.Random(9)
    values = [0.5] * 9000 + [10.0 ** rng.uniform(-300, 300) for _ in range(21_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("1 AS k", "v")
    assert ordered.order_statistic(df, ["k"], "v").first().quantile == statistics.median(values)
    assert ordered.order_statistic(df, ["k"], "v", 1.0).first().quantile == max(values)
    assert len(turns) == 2


def test_even_buckets_grow_with_the_rows(spark, monkeypatch):
    from clipwarden.operators import ordered

    monkeypatch.setattr(ordered, "BUCKET_ROWS", 2000, raising=False)
    sizes = [r["count"] for r in ordered.in_even_buckets(spark.range(40_000), ["id"], "b").groupBy("b").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 4000


def test_evaluation_matches_boxes_once(spark, monkeypatch):
    import os

    from clipwarden.operators import detection
    from clipwarden.plans import track_queries

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    turns, real = [], detection.match
    monkeypatch.setattr(detection, "match", lambda *a, **k: turns.append(1) or real(*a, **k))
    assert track_queries.evaluation_table(spark, sf).count() > 0
    assert len(turns) == 1


def test_lines_of_documents_are_written_row_by_row(spark, tmp_path):
    """Numbered or not, a document has the same text; lines without a number need no lambda."""
    from clipwarden.plans import source_queries as S

    rows = [(o, (o * 7 + n * 3) % 50 or None, n % 3, float(n), n) for o in range(30) for n in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    line = lambda l, i: S.text_of(S.hundredths(l["p"]), "/", l["n"])
    own, numbered = (S.documents(spark, str(tmp_path), line, "<", ">", ",", **k) for k in ({}, {"numbered": True}))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, numbered.collect()))
    assert "lambda" not in own._jdf.queryExecution().optimizedPlan().toString()


def _evaluation_case(spark, seed=3):
    rng = random.Random(seed)
    dets, truths = [], []
    for image in [*range(40), None]:
        for cls in (0, 1, 2, None):
            for k in range(rng.randrange(0, 5)):
                x, y = rng.uniform(0, 60), rng.uniform(0, 60)
                truths.append((image, cls, rng.choice([k, k, None]) if k == 1 else k, (x, y, x + 50, y + 50)))
                for j in range(rng.randrange(0, 3)):
                    s = rng.uniform(0, 25)
                    # class 2 is never met, ids and confidences may be null, confidences repeat
                    box = (x + s, y, x + 50 + s, y + 50) if cls != 2 else (900.0, 900.0, 950.0, 950.0)
                    dets.append((image, cls, None if rng.random() < 0.03 else 10 * k + j, rng.choice([None, 0.5, float("nan")]) if rng.random() < 0.1 else round(rng.random(), 1), box))
    # some rows come twice
    dets += dets[::7]
    truths += truths[::5]
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    d = spark.createDataFrame(dets, f"image long, cls int, det_id long, conf double, box {box}")
    return dets, truths, d, spark.createDataFrame(truths, f"image long, cls int, truth_id long, box {box}")


def test_match_deals_each_table_once(spark):
    """Against plain loops, also where ids are null and rows come twice."""
    from collections import Counter, defaultdict

    dets, truths, d, t = _evaluation_case(spark)
    levels = (0.5, 0.65, 0.8)

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / (5000 - inter)

    above = lambda v: (-1, 0) if v is None else (1, 0) if v != v else (0, v)  # as Spark orders: null, numbers, NaN
    best, conf = {}, {}
    for image, cls, det_id, c, b in dets:
        for i, k, truth_id, tb in truths:
            if (image, cls) == (i, k) and image is not None and cls is not None and iou(b, tb) >= 0.5:
                key = image, cls, det_id
                best[key] = max(best.get(key, (0, (-2, 0))), (iou(b, tb), above(None if truth_id is None else -truth_id)))
                conf[key] = max(conf.get(key, (-2, 0)), above(c))
    takers = defaultdict(list)
    for key, (o, truth) in best.items():
        takers[key[0], key[1], truth].append((conf[key], above(None if key[2] is None else -key[2]), o, key))
    hits = defaultdict(set)
    for rows in takers.values():
        for v in levels:
            if near := [r for r in rows if r[2] >= v]:
                hits[max(near)[3]].add(v)
    want = Counter((i, c, k, str(f), frozenset(hits[i, c, k] if k is not None else ())) for i, c, k, f, _ in dets)
    judged = detection.match(d, t, levels)
    assert Counter((r.image, r.cls, r.det_id, str(r.conf), frozenset(r.hits)) for r in judged.collect()) == want
    assert sum(map(len, hits.values())) > 30
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = detection.match(d, t, levels).select("image", "cls", "det_id", "conf", "hits")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # before, detections were dealt once more, and the winners as well
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("rows", [2000, 20])
def test_average_precision_stores_no_ranking(spark, monkeypatch, rows):
    """Several classes in several buckets against numpy; what is checkpointed has a row per class and level."""
    import os

    from clipwarden.operators import ordered

    dets, truths, d, t = _evaluation_case(spark, 8)
    monkeypatch.setattr(ordered, "BUCKET_ROWS", rows)
    sizes, real = [], detection.checkpoint
    monkeypatch.setattr(detection, "checkpoint", lambda df: sizes.append(df.count()) or real(df))
    levels = (0.5, 0.65, 0.99)
    judged = detection.match(d.filter("det_id IS NOT NULL"), t, levels)
    got = {(r.cls, r.level): r.ap for r in detection.average_precision(judged, t, levels).collect()}
    assert sizes == [9]
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(top) if f.startswith("clipwarden-")]
    above = lambda v: (-1, 0) if v is None else (1, 0) if v != v else (0, v)
    everything = [r for r in judged.collect() if r.cls is not None]
    rank = lambda r: (above(None if r.conf is None else -r.conf), above(r.image), r.det_id)
    for cls in (0, 1, 2):
        ranked, n = sorted((r for r in everything if r.cls == cls), key=rank), sum(x[1] == cls for x in truths)
        for v in levels:
            hit = np.cumsum([v in r.hits for r in ranked])
            recall = np.concatenate([[0.0], hit / n, [1.0]])
            precision = np.concatenate([[1.0], hit / np.arange(1, len(ranked) + 1), [0.0]])
            envelope = np.flip(np.maximum.accumulate(np.flip(precision)))
            # of points with one recall the last counts, as a step holds up to the next hit
            x = np.linspace(0, 1, 101)
            at = np.searchsorted(np.round(recall, 12), np.round(x, 12), side="right") - 1
            after = np.minimum(at + 1, len(recall) - 1)
            width = np.where(after > at, recall[after] - recall[at], 1.0)
            want = np.trapezoid(envelope[at] + (envelope[after] - envelope[at]) * (x - recall[at]) / np.where(width > 0, width, 1.0), x)
            assert abs(got.pop((cls, v)) - want) < 1e-9
    assert not got


def test_evaluation_matches_groups_of_images(spark, tmp_path, monkeypatch):
    """Each image is matched in one group, one without a name too, and the table stays the same."""
    from clipwarden.operators import detection
    from clipwarden.plans import track_queries

    rows = [(None if o == 7 else o, o * 7 % 90 + n % 2, o % 23, n, float(n)) for o in range(60) for n in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    sizes, real = [], detection.match
    monkeypatch.setattr(detection, "match", lambda d, *a, **k: sizes.append(d.count()) or real(d, *a, **k))
    whole = sorted(map(str, track_queries.evaluation_table(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(track_queries, "GROUP_BOXES", 100)
    assert sorted(map(str, track_queries.evaluation_table(spark, str(tmp_path)).collect())) == whole
    assert sizes[0] == len(rows) == sum(sizes[1:]) and len(sizes) == 6 and max(sizes[1:]) < 200
