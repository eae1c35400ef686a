"""Registered queries for result marts and dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timecode import sigmoid
from ..operators import joins, marts as M
from .curation_queries import _label_sql, label_rows
from .inputs import BOXES_SQL, DET_SQL, SIGNAL_SQL, TRUTH_SQL, boxes, detections, signal, table, truth, zones
from .registry import query
from .signal_queries import ALL_CLIPS_SQL, SCORED_SQL, all_clips, grid_run, grid_sql, scored
from . import presets


@query(
    "dataset_stats",
    f"WITH {DET_SQL}, a AS (SELECT cls, (x2 - x1) * (y2 - y1) / 100000 AS area FROM det) SELECT cls, count(*) AS boxes, round_even(quantile_cont(area, 0.5), 9) AS median_area, round_even(avg((area < 0.01e0)::INT), 9) AS small_share FROM a GROUP BY cls",
)
def dataset_stats(spark, d):
    b = F.col("box")
    a = detections(spark, d).select("cls", ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) / 100000).alias("area"))
    return M.dataset_stats(a).withColumns({c: F.bround(c, 9) for c in ("median_area", "small_share")})


@query("top_resolutions", "SELECT p_size * 16 AS width, (p_partkey % 12) * 9 AS height, count(*) AS images FROM part GROUP BY ALL ORDER BY images DESC, width, height LIMIT 4")
def top_resolutions(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") * 16).alias("width"), (F.col("p_partkey") % 12 * 9).alias("height"))
    return M.top_resolutions(p)


@query("brightness_buckets", "SELECT count(*) AS images, count(*) FILTER (p_size * 4 < 60) AS night, count(*) FILTER (p_size * 4 BETWEEN 60 AND 110) AS dusk, count(*) FILTER (p_size * 4 > 110) AS day, avg(p_size * 4) AS mean FROM part")
def brightness_buckets(spark, d):
    return M.brightness_buckets(table(spark, d, "part").select((F.col("p_size") * 4).alias("brightness")))


@query("fold_statistics", "WITH f AS (SELECT o_orderkey % 5 AS fold, avg(o_totalprice) AS f1 FROM orders GROUP BY 1) SELECT round_even(avg(f1), 4) AS mean, round_even(stddev_pop(f1), 4) AS std, round_even(min(f1), 4) AS lowest, round_even(max(f1), 4) AS highest FROM f")
def fold_statistics(spark, d):
    f = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("f1"))
    return M.fold_statistics(f).select(*[F.bround(c, 4).alias(c) for c in ("mean", "std", "lowest", "highest")])


@query("labelled_frames", f"WITH {_label_sql('hand', 'purchase', 'error')}, {_label_sql('auto', 'click')}, u AS (SELECT clip, tick FROM hand WHERE cls >= 0 UNION SELECT clip, tick FROM auto) SELECT clip, count(*) AS frames FROM u GROUP BY clip")
def labelled_frames(spark, d):
    return M.labelled_frames(label_rows(spark, d, "purchase", "error"), label_rows(spark, d, "click"))


@query("frame_kinds", f"WITH {_label_sql('hand', 'purchase', 'error')} SELECT clip, tick, CASE WHEN bool_or(cls >= 0) THEN 'box' ELSE 'empty' END AS kind FROM hand GROUP BY clip, tick")
def frame_kinds(spark, d):
    return M.frame_kinds(label_rows(spark, d, "purchase", "error"))


@query(
    "clip_documents",
    f"""WITH {SIGNAL_SQL}, {TRUTH_SQL}, {_label_sql('hand', 'purchase', 'error')}, {BOXES_SQL},
    zn AS (SELECT loc, count(*) AS corners FROM edges WHERE tag = 'Loitering' OR (tag = 'Intrusion' AND loc NOT IN (SELECT loc FROM edges WHERE tag = 'Loitering')) GROUP BY loc),
    s AS (SELECT clip, CAST(floor(t / 100) AS BIGINT) AS part, count(*) AS samples, sum(fire) AS fire, arg_min(smoke, t) AS first_smoke FROM sig GROUP BY ALL),
    k AS (SELECT clip, CAST(floor(t / 100) AS BIGINT) AS part, count(*) AS boxes, sum(conf) AS conf, arg_max(track, t) AS last_track FROM bx GROUP BY ALL),
    c AS (SELECT clip, CAST(floor(t / 100) AS BIGINT) AS part, count(*) AS points, sum(1 / (1 + exp(-(fire * 10 - 2)))) AS p FROM sig WHERE smoke >= 0.5e0 GROUP BY ALL),
    l AS (SELECT clip, CAST(floor(tick / 2e0 / 100) AS BIGINT) AS part, count(*) AS labels, sum(cls) AS classes FROM hand GROUP BY ALL),
    a AS (SELECT clip, 0::BIGINT AS part, start_s FROM gt),
    u AS (SELECT clip, part FROM s UNION SELECT clip, part FROM k UNION SELECT clip, part FROM c UNION SELECT clip, part FROM l UNION SELECT clip, part FROM a)
    SELECT clip, part, start_s, CASE WHEN part = 0 THEN CASE WHEN clip % 2 = 0 THEN 'day,fog' ELSE 'night' END END AS conditions,
      CASE WHEN part = 0 THEN corners END AS corners, coalesce(samples, 0) AS samples, round_even(coalesce(fire, 0e0), 6) AS fire, first_smoke,
      coalesce(boxes, 0) AS boxes, round_even(coalesce(conf, 0e0), 6) AS conf, last_track, coalesce(points, 0) AS points, round_even(coalesce(p, 0e0), 6) AS p,
      coalesce(labels, 0) AS labels, CAST(coalesce(classes, 0) AS BIGINT) AS classes
    FROM u LEFT JOIN s USING (clip, part) LEFT JOIN k USING (clip, part) LEFT JOIN c USING (clip, part) LEFT JOIN l USING (clip, part) LEFT JOIN a USING (clip, part)
      LEFT JOIN zn ON zn.loc = clip % 4""",
)
def clip_documents(spark, d):
    """Everything known of a clip, nested by part: read back from the documents as sums, ends and sizes."""
    gt, sig = truth(spark, d), signal(spark, d)
    zone = joins.zone_of_clip(gt.withColumn("loc", F.col("clip") % 4), zones(spark), ["Loitering", "Intrusion"])
    about = zone.select(
        "clip", "start_s", F.when(F.col("clip") % 2 == 0, F.array(F.lit("day"), F.lit("fog"))).otherwise(F.array(F.lit("night"))).alias("conditions"), "poly"
    )
    docs = M.clip_documents(
        about, part_s=100.0, signal=sig, labels=label_rows(spark, d, "purchase", "error").withColumn("t", F.col("tick") / 2).select("clip", "t", "cls"),
        tracks=boxes(spark, d).select("clip", "t", "track", "conf", "box"),
        curves=sig.filter("smoke >= 0.5D").select("clip", "t", sigmoid(F.col("fire") * 10 - 2, None).alias("p")),
    )
    n = lambda c: F.size(c).cast("long")
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, r: a + r[f])
    return docs.select(
        "clip", "part", "about.start_s", F.array_join("about.conditions", ",").alias("conditions"), F.size("about.poly").cast("long").alias("corners"),
        n("signal").alias("samples"), F.bround(total("signal", "fire"), 6).alias("fire"), F.get("signal", 0)["smoke"].alias("first_smoke"),
        n("tracks").alias("boxes"), F.bround(total("tracks", "conf"), 6).alias("conf"), F.get("tracks", F.size("tracks") - 1)["track"].alias("last_track"),
        n("curves").alias("points"), F.bround(total("curves", "p"), 6).alias("p"), n("labels").alias("labels"),
        F.aggregate("labels", F.lit(0).cast("long"), lambda a, r: a + r["cls"].cast("long")).alias("classes"),
    )


@query(
    "label_set_rollup",
    """WITH f AS (SELECT DISTINCT o_custkey AS clip, o_orderkey AS file FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_custkey AS clip, o_orderkey AS file FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT clip, count(*) FILTER (k = 1) AS frame_count, CAST(sum(n) AS BIGINT) AS box_count, CAST(sum(CASE WHEN k = 1 THEN n ELSE 0 END) AS BIGINT) AS attached FROM
      (SELECT coalesce(f.clip, c.clip) AS clip, CASE WHEN f.file IS NULL THEN 0 ELSE 1 END AS k, coalesce(n, 0) AS n FROM f FULL JOIN (SELECT clip, file, count(*) AS n FROM b GROUP BY ALL) c ON f.clip = c.clip AND f.file = c.file) GROUP BY clip""",
)
def label_set_rollup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("file"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"))
    return M.label_set_rollup(o.filter("file % 5 <> 0"), li.join(o, "file")).withColumns({c: F.col(c).cast("long") for c in ("box_count", "attached")})


FILES_SQL = """fl AS (SELECT source AS folder, 'set' || (CAST(substr(source, 4) AS INTEGER) % 4) AS dataset, CAST(substr(source, 4) AS INTEGER) AS folder_order, CAST(doc_id // 3 AS VARCHAR) AS file, doc_id % 3 = 0 AS labeled, doc_id FROM documents),
mg AS (SELECT dataset, file, arg_min(labeled, folder_order * 1000000 + doc_id) AS labeled FROM fl GROUP BY ALL)"""


def dataset_files(spark, d) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "documents")
    number = F.substring("source", 4, 10).cast("int")
    files = t.select(
        F.concat(F.lit("set"), (number % 4).cast("string")).alias("dataset"), F.col("source").alias("folder"),
        F.floor(F.col("doc_id") / 3).cast("string").alias("file"), (F.col("doc_id") % 3 == 0).alias("labeled"), (number * 1000000 + F.col("doc_id")).alias("folder_order"),
    )
    return files, M.merged_dataset(files, files.select("folder").distinct()).select("dataset", "file", "labeled")


@query("merged_dataset", f"WITH {FILES_SQL} SELECT * FROM mg")
def merged_dataset(spark, d):
    return dataset_files(spark, d)[1]


@query(
    "dataset_summary",
    f"""WITH {FILES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY file) - 1 AS r, count(*) OVER (PARTITION BY dataset) AS n FROM mg),
    sh AS (SELECT * FROM r WHERE n <= 50 OR r IN (SELECT CAST(floor(i * (r.n / 50e0)) AS BIGINT) FROM (SELECT unnest(range(50)) AS i)))
    SELECT t.dataset, total, shown, labeled_ratio FROM (SELECT dataset, count(*) AS total FROM fl GROUP BY dataset) t JOIN (SELECT dataset, count(*) AS shown, round_even(avg(labeled::INT), 2) AS labeled_ratio FROM sh GROUP BY dataset) s ON s.dataset = t.dataset""",
)
def dataset_summary(spark, d):
    from ..operators.curation import pick_even

    files, merged = dataset_files(spark, d)
    shown = pick_even(merged, ["dataset"], ["file"], F.substring("file", 1, 2), 50)
    return M.dataset_summary(files, shown)


@query(
    "verdict_matrix",
    f"""WITH {grid_sql(list(presets.NAMED_RULES.values()), clips=ALL_CLIPS_SQL)}
    SELECT clip, {', '.join(f"max(CASE WHEN ordinal = {i} THEN verdict END) AS rule{i}" for i in range(len(presets.NAMED_RULES)))} FROM verdicts GROUP BY clip""",
)
def verdict_matrix(spark, d):
    """All clips by the named rules; a rule that did not fire missed the event, if there is one."""
    names = [f"rule{i}" for i in range(len(presets.NAMED_RULES))]
    fired, gt, _ = grid_run(spark, d, list(presets.NAMED_RULES.values()), clips=all_clips)
    v = fired.select("clip", F.concat(F.lit("rule"), F.col("ordinal").cast("string")).alias("name"), "verdict")
    silent = F.when(F.col("start_s").isNull(), "normal").otherwise("miss")
    matrix = gt.join(M.verdict_matrix(v, names), "clip", "left")
    return matrix.select("clip", *[F.coalesce(n, silent).alias(n) for n in names])


@query("verdict_filter", f"WITH {SCORED_SQL} SELECT clip, alarm, verdict FROM scored WHERE verdict = 'false' ORDER BY clip")
def verdict_filter(spark, d):
    return scored(spark, d).filter("verdict = 'false'").select("clip", "alarm", "verdict").orderBy("clip")


RES_SQL = """rs AS (SELECT o_orderkey AS seq, ['fire', 'loiter', 'fall', 'intrusion'][o_custkey % 4 + 1] AS item, 'exp' || (o_orderkey % 977) AS name, CAST(o_custkey % 37 AS DOUBLE) + o_orderkey % 3 AS f1, o_custkey % 5 AS tp, o_orderkey % 2 AS fn, o_orderkey % 3 AS fp,
  CASE WHEN o_orderkey % 4 = 0 THEN 'm' END AS model, CASE o_orderkey % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'archive' ELSE 'run' END AS kind, o_orderkey % 1000 AS mtime, o_orderkey % 6 = 0 AS has_clips, o_orderkey % 7 AS n_rules FROM orders)"""


def results(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("seq"), F.element_at(F.array(*[F.lit(v) for v in ("fire", "loiter", "fall", "intrusion")]), (c % 4 + 1).cast("int")).alias("item"),
        F.concat(F.lit("exp"), (k % 977).cast("string")).alias("name"), ((c % 37).cast("double") + k % 3).alias("f1"), (c % 5).alias("tp"), (k % 2).alias("fn"), (k % 3).alias("fp"),
        F.when(k % 4 == 0, "m").alias("model"), F.when(k % 3 == 0, "live").when(k % 3 == 1, "archive").otherwise("run").alias("kind"), (k % 1000).alias("mtime"),
        F.when(k % 6 == 0, F.create_map(F.lit("c"), k.cast("string"))).alias("clips"), F.array_repeat(F.lit("r"), (k % 7).cast("int")).alias("rules"),
    )


@query("best_per_item", f"WITH {RES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY f1 DESC, seq) AS r FROM rs) SELECT item, seq, name, f1 FROM b WHERE r = 1")
def best_per_item(spark, d):
    return M.best_per_item(results(spark, d)).select("item", "seq", "name", "f1")


@query(
    "deduplicate_results",
    f"""WITH {RES_SQL}, k AS (SELECT *, CASE WHEN model IS NULL THEN 0 ELSE 4 END + CASE kind WHEN 'live' THEN 2 WHEN 'archive' THEN 0 ELSE 3 END + has_clips::INT AS rank FROM rs),
    o AS (SELECT *, row_number() OVER (PARTITION BY item, f1, tp, fn, fp ORDER BY rank DESC, mtime DESC, seq) AS r FROM k)
    SELECT item, f1, tp, fn, fp, max(CASE WHEN r = 1 THEN name END) AS name, count(DISTINCT name) AS members, CAST(arg_min(seq, r) FILTER (has_clips) AS VARCHAR) AS clip_from, coalesce(arg_min(n_rules, r) FILTER (n_rules > 1), max(CASE WHEN r = 1 THEN n_rules END)) AS rules FROM o GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY item, f1, tp, fn, fp"),
)
def deduplicate_results(spark, d):
    r = M.deduplicate_results(results(spark, d))
    return r.select("item", "f1", "tp", "fn", "fp", "name", F.size("members").cast("long").alias("members"), F.element_at("clips", F.lit("c")).alias("clip_from"), F.size("rules").cast("long").alias("rules"))


@query("results_by_score", f"WITH {RES_SQL} SELECT seq, item, f1, name FROM rs ORDER BY f1 DESC, name, seq")
def results_by_score(spark, d):
    return results(spark, d).orderBy(F.desc("f1"), "name", "seq").select("seq", "item", "f1", "name")


@query("model_comparison", "SELECT p_brand AS name, round_even(avg(p_retailprice), 4) AS map5095 FROM part GROUP BY p_brand ORDER BY map5095 DESC, name")
def model_comparison(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.bround(F.avg("p_retailprice"), 4).alias("map5095"))
    return M.compare_models(m)
