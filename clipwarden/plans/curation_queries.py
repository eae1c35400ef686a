"""Registered queries over label tables: picks, splits, merges, negatives, mining, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import keys as K, signals as S, timecode as T
from ..operators import curation as C, joins, suppression
from ..operators.ordered import hash_bucket, hash_rank_key, with_position
from .inputs import DET_SQL, SIGNAL_SQL, TRUTH_SQL, detections, signal, table, truth
from .registry import query
from .signal_queries import indexed
from .track_queries import with_ids


def docs(spark, d) -> DataFrame:
    """Documents as labelled frames: five consecutive ones make a clip."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.floor(F.col("doc_id") / 5).alias("clip"), "lang", "source", "n_chars")


DOCS_SQL = "dc AS (SELECT doc_id, doc_id // 5 AS clip, lang, source, n_chars FROM documents)"


def h_sql(key: str, seed: int = 0) -> str:
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


# ---- picking -----------------------------------------------------------------------


@query(
    "pick_even_per_clip",
    f"""WITH {SIGNAL_SQL}, r AS (SELECT clip, t, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY clip) AS n FROM sig),
    p AS (SELECT unnest(range(6)) AS i) SELECT clip, t FROM r WHERE n <= 6 OR EXISTS (SELECT 1 FROM p WHERE CAST(floor(i * (CAST(n AS DOUBLE) / 6)) AS BIGINT) = r)""",
)
def pick_even_per_clip(spark, d):
    s = signal(spark, d).select("clip", "t")
    return C.pick_even(s, ["clip"], ["t"], F.floor("t").cast("long"), 6)


@query("every_fourth_sample", f"WITH {SIGNAL_SQL}, r AS (SELECT clip, t, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS idx FROM sig) SELECT clip, t, idx FROM r WHERE idx % 4 = 0")
def every_fourth_sample(spark, d):
    return C.every_nth(indexed(spark, d), "idx", 4).select("clip", "t", "idx")


@query(
    "cap_clips_by_total",
    f"""WITH {DOCS_SQL}, g AS (SELECT lang, clip, count(*) AS n FROM dc GROUP BY ALL),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY {h_sql('clip', 42)}, clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
    SELECT lang, clip, n FROM r WHERE before < 100""",
)
def cap_clips_by_total(spark, d):
    g = docs(spark, d).groupBy("lang", "clip").agg(F.count(F.lit(1)).alias("n"))
    return C.cap_by_total(g, "n", F.lit(100), "clip", 42, ["lang"])


@query(
    "top_frames_per_clip",
    f"""WITH {SIGNAL_SQL}, lab AS (SELECT DISTINCT user_id AS clip FROM events WHERE event_type = 'purchase' AND value > 100),
    p AS (SELECT sig.*, lab.clip IS NULL AS unlabelled, greatest(fire, smoke) AS peak FROM sig LEFT JOIN lab USING (clip)),
    s AS (SELECT *, 1 - abs(peak - 0.35e0) / 0.35e0 + CASE WHEN unlabelled THEN 0.5e0 ELSE 0 END AS score FROM p
          WHERE peak BETWEEN 0.15e0 AND 0.55e0 OR (unlabelled AND peak >= 0.1e0))
    SELECT clip, t, unlabelled, round_even(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, t) AS rank FROM s) WHERE rank <= 6""",
)
def top_frames_per_clip(spark, d):
    lab = table(spark, d, "events").filter((F.col("event_type") == "purchase") & (F.col("value") > 100)).select(F.col("user_id").alias("clip"))
    out = C.label_candidates(signal(spark, d), lab)
    return out.select("clip", "t", "unlabelled", F.bround("score", 9).alias("score"), "rank")


# ---- splits -----------------------------------------------------------------------------


@query(
    "stratified_split",
    f"""WITH {DOCS_SQL}, g AS (SELECT lang, source, clip FROM dc GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {h_sql('clip', 42)}, clip) - 1 AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM g)
    SELECT lang, source, clip, CASE WHEN r < CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.2e0, 0)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, d):
    g = docs(spark, d).select("lang", "source", "clip").distinct()
    return C.stratified_split(g, ["lang", "source"], "clip", 0.2, 42)


@query(
    "leak_free_split",
    f"""WITH f AS (SELECT CAST(doc_id // 2 AS VARCHAR) || '.jpg' AS name, doc_id // 10 AS clip, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM documents),
    u AS (SELECT DISTINCT name, clip FROM f), g AS (SELECT DISTINCT clip FROM u),
    r AS (SELECT clip, row_number() OVER (ORDER BY {h_sql('clip')}, clip) - 1 AS r, count(*) OVER () AS n FROM g)
    SELECT name, u.clip, CASE WHEN r < greatest(1, floor(n * 0.2e0)) THEN 'val' ELSE 'train' END AS split FROM u JOIN r USING (clip)""",
)
def leak_free_split(spark, d):
    """Two rows a name, one in each split before; names and clips grow with the table."""
    i = F.floor(F.col("doc_id") / 2)
    files = docs(spark, d).select(
        F.concat(i.cast("string"), F.lit(".jpg")).alias("name"), F.floor(i / 5).alias("clip"),
        F.when(F.col("doc_id") % 2 == 0, "train").otherwise("val").alias("split"),
    )
    return C.leak_free_split(files, "name", "clip")


@query(
    "half_per_location",
    f"""WITH {DOCS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {h_sql('doc_id')}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM dc)
    SELECT doc_id, source FROM r WHERE r < n // 2""",
)
def half_per_location(spark, d):
    return C.half_per_group(docs(spark, d).select("doc_id", "source"), ["source"], "doc_id")


@query("one_per_clip", f"WITH {DOCS_SQL} SELECT clip, source, arg_min(doc_id, ({h_sql('doc_id')}, doc_id)) AS doc_id FROM dc GROUP BY clip, source")
def one_per_clip(spark, d):
    return C.one_per_group(docs(spark, d).select("clip", "source", "doc_id"), ["clip", "source"], "doc_id")


@query(
    "thin_smoke_only",
    f"""WITH {DET_SQL}, p AS (SELECT image, bool_or(cls = 0) AS f, bool_or(cls = 1) AS s FROM det GROUP BY image)
    SELECT image FROM p WHERE NOT (s AND NOT f AND ('0x' || substr({h_sql('image')}, 1, 8))::BIGINT / 4294967296e0 < 0.5e0)""",
)
def thin_smoke_only(spark, d):
    p = detections(spark, d).groupBy("image").agg(F.bool_or(F.col("cls") == 0).alias("with_fire"), F.bool_or(F.col("cls") == 1).alias("with_smoke"))
    return C.thin_smoke_only(p, "image").select("image")


@query("md5_split", "SELECT doc_id, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295e0 < 0.1e0 THEN 'val' ELSE 'train' END AS split FROM documents")
def md5_split(spark, d):
    return docs(spark, d).select("doc_id", K.md5_split(F.col("doc_id").cast("string"), 0.1).alias("split"))


@query(
    "md5_mod20",
    """WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents)
    SELECT doc_id, CAST(((('0x' || substr(m, 1, 15))::BIGINT % 20 * 16) + (('0x' || substr(m, 16, 15))::BIGINT % 20 * 16) + (('0x' || substr(m, 31, 2))::BIGINT % 20)) % 20 AS INTEGER) AS bucket FROM h""",
)
def md5_mod20(spark, d):
    return docs(spark, d).select("doc_id", K.md5_mod20(F.col("doc_id").cast("string")).alias("bucket"))


@query("fold_assignment", f"WITH {DOCS_SQL}, g AS (SELECT DISTINCT clip FROM dc) SELECT clip, CAST((row_number() OVER (ORDER BY {h_sql('clip')}, clip) - 1) % 5 AS INTEGER) AS fold FROM g")
def fold_assignment(spark, d):
    g = docs(spark, d).select("clip").distinct().withColumn("_h", hash_rank_key("clip"))
    ranked = with_position(g, [], ["_h", "clip"], hash_bucket("_h"), "_r")
    return ranked.select("clip", (F.col("_r") % 5).cast("int").alias("fold"))


@query(
    "ratio_sweep_members",
    f"""WITH {DOCS_SQL}, r AS (SELECT doc_id, row_number() OVER (ORDER BY {h_sql('doc_id', 1)}, doc_id) - 1 AS r, count(*) OVER () AS n FROM dc)
    SELECT share, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM r JOIN (SELECT unnest([10, 25, 50, 100]) AS share) s ON r < floor(n * (share / 100e0)) GROUP BY share""",
)
def ratio_sweep_members(spark, d):
    base = docs(spark, d).select("doc_id").withColumn("_h", hash_rank_key("doc_id", seed=1))
    n = base.agg(F.count(F.lit(1)).alias("n"))
    ranked = with_position(base, [], ["_h", "doc_id"], hash_bucket("_h"), "_r").withColumn("_n", n.scalar())
    shares = F.array(*[F.when(F.col("_r") < F.floor(F.col("_n") * (s / 100)), s) for s in (10, 25, 50, 100)])
    return ranked.select("doc_id", F.explode(F.array_compact(shares)).alias("share")).groupBy("share").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("id_sum")
    )


@query(
    "ratio_sweep_sets",
    f"""WITH {DOCS_SQL}, r AS (SELECT doc_id, row_number() OVER (ORDER BY {h_sql('doc_id', 2)}, doc_id) - 1 AS r, count(*) OVER () AS n FROM dc),
    p AS (SELECT unnest([0, 10, 25, 50, 100]) AS percent)
    SELECT percent, CASE WHEN r < 60 THEN 'val' ELSE 'train' END AS part, doc_id FROM r JOIN p ON r < 60 OR r - 60 < floor((n - 60) * percent / 100e0)""",
)
def ratio_sweep_sets(spark, d):
    """A sweep from 0 % on, with a hold-out of 60 rows that stays the same."""
    return C.ratio_members(docs(spark, d), "doc_id", hold=60, seed=2)


# ---- label sources ----------------------------------------------------------------------


def label_rows(spark, d, kind: str, marker: str | None = None) -> DataFrame:
    """Label rows on the half-second grid; the marker type stands for "looked at, empty"."""
    kinds = [kind] + ([marker] if marker else [])
    ev = with_ids(spark, d).filter(F.col("event_type").isin(*kinds))
    k = F.get_json_object("props", "$.k").cast("double") / 100.0
    cls = F.when(F.col("event_type") == (marker or ""), -1).otherwise((F.col("row_id") % 2).cast("int"))
    # a coarse grid lets the sources meet
    return ev.select("clip", T.tick(F.floor(F.col("t") / 8) / 2).alias("tick"), cls.alias("cls"), k.alias("x"), (k / 2).alias("y"), (k / 4).alias("w"), (k / 8).alias("h"))


def _label_sql(name: str, kind: str, marker: str | None = None) -> str:
    kinds = f"'{kind}'" + (f", '{marker}'" if marker else "")
    return f"""{name} AS (SELECT user_id AS clip, CAST(round_even(floor((CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 3.6e9) / 8) / 2 * 2, 0) AS INTEGER) AS tick,
      CASE WHEN event_type = '{marker or ''}' THEN -1 ELSE CAST(event_id % 2 AS INTEGER) END AS cls, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS x
      FROM events WHERE event_type IN ({kinds}))"""


MERGE_SQL = f"""{_label_sql('hand', 'purchase', 'error')}, {_label_sql('auto', 'click')}, {_label_sql('gtl', 'view')},
al AS (SELECT *, 0 AS p, 'hand' AS src FROM hand UNION ALL SELECT *, 1, 'auto' FROM auto UNION ALL SELECT *, 2, 'gt' FROM gtl),
best AS (SELECT clip, tick, min(p) AS p FROM al GROUP BY ALL),
merged AS (SELECT clip, tick, src, count(*) FILTER (cls >= 0) AS n, coalesce(sum(x) FILTER (cls >= 0), 0e0) AS sx FROM al JOIN best USING (clip, tick, p) GROUP BY ALL)"""


def merged_labels(spark, d) -> DataFrame:
    return C.merge_sources({
        "hand": label_rows(spark, d, "purchase", "error"), "auto": label_rows(spark, d, "click"), "gt": label_rows(spark, d, "view"),
    })


@query("merge_label_sources", f"WITH {MERGE_SQL} SELECT clip, tick, src, CAST(n AS INTEGER) AS n, round_even(sx, 6) AS sx FROM merged")
def merge_label_sources(spark, d):
    sx = F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b["x"])
    return merged_labels(spark, d).select("clip", "tick", "src", F.size("boxes").alias("n"), F.bround(sx, 6).alias("sx"))


@query("build_counts", f"WITH {MERGE_SQL} SELECT CASE WHEN ('0x' || substr(md5(CAST(clip AS VARCHAR)), 1, 8))::BIGINT / 4294967295e0 < 0.1e0 THEN 'val' ELSE 'train' END AS split, src, count(*) AS frames, CAST(sum(n) AS BIGINT) AS boxes FROM merged GROUP BY 1, 2")
def build_counts(spark, d):
    from ..sources.sinks import build_counts as counts

    return counts(C.frame_split(merged_labels(spark, d), F.col("clip").cast("string"), 0.1))


@query(
    "eligibility_reasons",
    """WITH c(category, mode, "use") AS (VALUES ('click', 'fire', 'train'), ('view', 'person', 'train'), ('error', 'fire', 'eval'), ('purchase', 'fire', 'none')),
    j AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'eval row' WHEN c.mode IS NULL THEN 'no category' WHEN c.mode <> 'fire' THEN 'mode ' || c.mode
      WHEN c."use" <> 'train' THEN 'use ' || c."use" ELSE 'used' END AS reason FROM events e LEFT JOIN c ON c.category = e.event_type)
    SELECT reason, count(*) AS rows FROM j GROUP BY reason""",
)
def eligibility_reasons(spark, d):
    contract = spark.createDataFrame(
        [("click", "fire", "train"), ("view", "person", "train"), ("error", "fire", "eval"), ("purchase", "fire", "none")], "category string, mode string, use string"
    )
    rows = table(spark, d, "events").select(F.col("event_type").alias("category"), (F.col("event_id") % 11 == 0).alias("is_eval"))
    return C.reason_counts(C.eligibility(rows, F.broadcast(contract), "fire"))


@query(
    "hard_negatives",
    f"""WITH {SIGNAL_SQL}, pos AS (SELECT clip, round_even(t * 2, 0) / 2 AS t, fire >= 0.3e0 AS by_hand FROM sig WHERE smoke > 0.4e0), dur AS (SELECT clip, max(t) AS dur FROM sig GROUP BY clip),
    sp AS (SELECT clip, min(t) AS f0, max(t) AS f1, count(*) FILTER (by_hand) AS hand FROM pos GROUP BY clip HAVING count(*) FILTER (by_hand) > 0),
    k AS (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS k),
    c AS (SELECT clip, hand, round_even(f0 - 5e0 - k * 0.5e0, 1) AS t, k * 2 AS o FROM sp, k UNION ALL SELECT clip, hand, round_even(f1 + 5e0 + k * 0.5e0, 1), k * 2 + 1 FROM sp, k),
    f AS (SELECT c.* FROM c JOIN dur USING (clip) WHERE (o % 2 = 0 AND t >= 0.5e0) OR (o % 2 = 1 AND t <= dur - 0.5e0)),
    g AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.clip = f.clip AND abs(f.t - p.t) < 0.5e0)),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY o) AS rank FROM g)
    SELECT clip, t, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= hand""",
)
def hard_negatives(spark, d):
    s = signal(spark, d).filter("smoke > 0.4D")
    pos = s.select("clip", T.snap(F.col("t")).alias("t"), (F.col("fire") >= 0.3).alias("by_hand"))
    clips = signal(spark, d).groupBy("clip").agg(F.max("t").alias("dur"))
    return C.hard_negatives(pos, clips)


@query(
    "range_anti_join",
    f"""WITH {SIGNAL_SQL}, p AS (SELECT * FROM sig WHERE fire >= 0.4e0), c AS (SELECT * FROM sig WHERE fire < 0.4e0)
    SELECT clip, t FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.clip = c.clip AND abs(p.t - c.t) < 2.5e0)""",
)
def range_anti_join(spark, d):
    s = signal(spark, d)
    return joins.away_from(s.filter("fire < 0.4D"), s.filter("fire >= 0.4D"), 2.5).select("clip", "t")


BG_SQL = f"""{TRUTH_SQL}, bg AS (SELECT DISTINCT clip, CAST(round_even((start_s - 5) * (i + 0.5e0) / 10 * 2, 0) AS INTEGER) AS tick
  FROM gt, (SELECT unnest(range(10)) AS i) WHERE start_s - 5 >= 2)"""


@query("background_times", f"WITH {BG_SQL} SELECT clip, tick FROM bg")
def background_times(spark, d):
    return C.background_times(truth(spark, d))


@query(
    "evaluation_set",
    f"""WITH {_label_sql('hand0', 'purchase', 'error')}, {_label_sql('auto0', 'click')}, {BG_SQL},
    hand AS (SELECT * FROM hand0 WHERE clip % 3 = 0), auto AS (SELECT * FROM auto0 WHERE clip % 3 = 0),
    al AS (SELECT clip, tick, cls, 0 AS p, 'hand' AS src FROM hand UNION ALL SELECT clip, tick, cls, 1, 'auto' FROM auto
      UNION ALL SELECT clip, tick, -1, 3, 'background' FROM bg WHERE clip % 3 = 0 AND clip IN (SELECT clip FROM hand UNION SELECT clip FROM auto)),
    best AS (SELECT clip, tick, min(p) AS p FROM al GROUP BY ALL)
    SELECT src, count(DISTINCT (clip, tick)) AS frames, count(*) FILTER (cls >= 0) AS boxes FROM al JOIN best USING (clip, tick, p) GROUP BY src""",
)
def evaluation_set(spark, d):
    clips = truth(spark, d).select("clip").filter("clip % 3 = 0")
    out = C.evaluation_set(label_rows(spark, d, "purchase", "error"), label_rows(spark, d, "click"), C.background_times(truth(spark, d)), clips)
    return out.groupBy("src").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size("boxes")).alias("boxes"))


@query(
    "propagate_labels",
    f"""WITH {SIGNAL_SQL}, l AS (SELECT clip, round_even(t, 0) AS t, CASE WHEN fire < 0.05e0 THEN -1 ELSE 0 END AS cls, smoke AS x, fire AS y, 0.2e0 AS w, 0.2e0 AS h FROM sig WHERE smoke > 0.6e0),
    p AS (SELECT l.*, o, t + o AS at_t FROM l, (SELECT unnest([-2e0, -1e0, 0e0, 1e0, 2e0]) AS o) WHERE t + o >= 0)
    SELECT clip, at_t AS "at", count(*) AS rows, count(*) FILTER (cls >= 0 AND x + w / 2 > 0 AND x + w / 2 < 1 AND y + h / 2 > 0 AND y + h / 2 < 1) AS usable FROM p GROUP BY clip, at_t""",
)
def propagate_labels(spark, d):
    s = signal(spark, d).filter(F.col("smoke") > 0.6)
    l = s.select("clip", F.bround("t", 0).alias("t"), F.when(F.col("fire") < 0.05, -1).otherwise(0).alias("cls"), F.col("smoke").alias("x"), F.col("fire").alias("y"), F.lit(0.2).alias("w"), F.lit(0.2).alias("h"))
    return C.propagate(l).groupBy("clip", "at").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("usable"), 1)).alias("usable"))


@query(
    "frame_plans",
    f"""WITH {TRUTH_SQL}, g AS (SELECT * FROM gt WHERE start_s IS NOT NULL),
    f AS (SELECT clip, unnest([greatest(0, start_s - 10) + 3, start_s, start_s + 8]) AS t FROM g), s AS (SELECT clip, unnest([start_s - 4, start_s, start_s + 5, start_s + 10, start_s + 20, start_s + 35]) AS t FROM g),
    w AS (SELECT clip, greatest(0e0, start_s - 2) + i * 2.5e0 AS t, row_number() OVER (PARTITION BY clip ORDER BY i) AS n, start_s FROM g, (SELECT unnest(range(20)) AS i))
    SELECT 'full' AS plan, clip, t FROM f WHERE t >= 0 UNION ALL SELECT 'snow', clip, t FROM s WHERE t >= 0 UNION ALL SELECT 'window', clip, t FROM w WHERE t <= start_s + 10 AND n <= 4
    UNION ALL SELECT DISTINCT 'background', clip, greatest(5e0, least(b, start_s - 10)) FROM (SELECT clip, start_s, unnest([10e0, 30e0, 60e0, start_s - 60, start_s - 30]) AS b FROM g)
    UNION ALL SELECT 'miss_' || tag, clip, t FROM (SELECT clip, 'gt' AS tag, start_s AS t FROM g UNION ALL SELECT clip, 'ign', greatest(0e0, start_s - 10) FROM g)""",
)
def frame_plans(spark, d):
    g = truth(spark, d)
    full = C.frame_plan(g, "full").select(F.lit("full").alias("plan"), "clip", "t")
    snow = C.frame_plan(g, "snow").select(F.lit("snow").alias("plan"), "clip", "t")
    window = C.window_plan(g, 2.5, 4).select(F.lit("window").alias("plan"), "clip", "t")
    background = C.background_plan(g).select(F.lit("background").alias("plan"), "clip", "t")
    miss = C.miss_plan(g).select(F.concat(F.lit("miss_"), "tag").alias("plan"), "clip", "t")
    return full.unionByName(snow).unionByName(window).unionByName(background).unionByName(miss)


@query(
    "route_pseudo_labels",
    f"""WITH {SIGNAL_SQL}, fr AS (SELECT clip, t, smoke AS c FROM sig), r AS (SELECT clip, t, CASE WHEN c >= 0.15e0 THEN c END AS max_conf FROM fr),
    q AS (SELECT *, CASE WHEN max_conf >= 0.35e0 THEN 'label' WHEN max_conf IS NULL THEN 'negative' ELSE 'ambiguous' END AS route FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY clip, route ORDER BY t) AS k FROM q WHERE route <> 'ambiguous'),
    u AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t) AS rank FROM n WHERE route = 'label' OR k <= 10)
    SELECT clip, t, max_conf, route, CAST(rank AS INTEGER) AS rank FROM u WHERE rank <= 40""",
)
def route_pseudo_labels(spark, d):
    s = signal(spark, d).select("clip", "t", F.col("smoke").alias("conf"))
    return C.route_frames(s, s.select("clip", "t"))


def mining_rows(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("label").alias("clip"), "vec_id", F.get("embedding", 0).cast("double").alias("conf"), F.col("embedding").alias("sig")
    )


@query(
    "mine_diverse",
    """WITH RECURSIVE e AS (SELECT label AS clip, vec_id, CAST(embedding[1] AS DOUBLE) AS conf, embedding AS sig, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings),
    st(clip, r, kept, ids) AS (SELECT clip, r, [sig], [vec_id] FROM e WHERE r = 1
      UNION ALL SELECT s.clip, s.r + 1,
        CASE WHEN len(ids) >= 6 OR list_bool_or(list_transform(kept, lambda k: list_inner_product(k::DOUBLE[], n.sig::DOUBLE[]) > 0.3e0)) THEN kept ELSE list_append(kept, n.sig) END,
        CASE WHEN len(ids) >= 6 OR list_bool_or(list_transform(kept, lambda k: list_inner_product(k::DOUBLE[], n.sig::DOUBLE[]) > 0.3e0)) THEN ids ELSE list_append(ids, n.vec_id) END
      FROM st s JOIN e n ON n.clip = s.clip AND n.r = s.r + 1),
    f AS (SELECT clip, arg_max(ids, r) AS ids FROM st GROUP BY clip), u AS (SELECT unnest(ids) AS vec_id FROM f)
    SELECT e.clip, e.vec_id, e.conf FROM e JOIN u USING (vec_id) ORDER BY conf DESC, vec_id LIMIT 2000""",
)
def mine_diverse(spark, d):
    kept = suppression.keep_diverse(
        mining_rows(spark, d), ["clip"], [F.desc("conf"), F.asc("vec_id")], "vec_id", "sig", 0.3, 6
    )
    return kept.orderBy(F.desc("conf"), "vec_id").limit(2000).select("clip", "vec_id", "conf")


@query(
    "mining_candidates",
    f"""WITH {DOCS_SQL}, f AS (SELECT clip, doc_id AS frame, CAST(doc_id AS VARCHAR) AS stem FROM dc WHERE clip % 4 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame, stem) - 1 AS r, count(*) OVER (PARTITION BY clip) AS n FROM f),
    p AS (SELECT * FROM r WHERE n <= 3 OR r IN (SELECT CAST(floor(i * (r.n / 3e0)) AS BIGINT) FROM (SELECT unnest(range(3)) AS i)))
    SELECT clip, frame, stem FROM p WHERE frame % 7 <> 0""",
)
def mining_candidates(spark, d):
    t = docs(spark, d)
    frames = t.select("clip", F.col("doc_id").alias("frame"), F.col("doc_id").cast("string").alias("stem"))
    val = t.filter("clip % 4 = 0").select("clip").distinct()
    used = frames.filter("frame % 7 = 0").select("stem")
    return C.mining_candidates(frames, val, used, 3, F.floor(F.col("frame") / 1000).cast("long"))


@query(
    "oversample_mix",
    f"""WITH base AS (SELECT doc_id, row_number() OVER (ORDER BY {h_sql('doc_id', 1)}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents),
    m AS (SELECT doc_id FROM base WHERE r < floor(n * 0.5e0) UNION ALL SELECT doc_id FROM labels, range(5) WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1)
    SELECT doc_id, count(*) AS copies FROM m GROUP BY doc_id""",
)
def oversample_mix(spark, d):
    lab = table(spark, d, "labels")
    base = C.sample_share(docs(spark, d).select("doc_id"), "doc_id", 0.5, 1)
    mix = C.oversample(base, {"good": (lab.filter("quality = 1").select("doc_id"), 5), "toxic": (lab.filter("toxic = 1").select("doc_id"), 1)})
    return mix.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))


@query("sample_validation", f"SELECT doc_id FROM documents ORDER BY {h_sql('doc_id')}, doc_id LIMIT 600")
def sample_validation(spark, d):
    return C.sample_rows(docs(spark, d).select("doc_id"), "doc_id", 600)


@query(
    "positive_negative_sample",
    f"""WITH {DET_SQL}, p AS (SELECT image, bool_or(cls = 0) AS f FROM det GROUP BY image)
    (SELECT image, true AS positive FROM p WHERE f ORDER BY {h_sql('image')}, image LIMIT 12000) UNION ALL (SELECT image, false FROM p WHERE NOT f ORDER BY {h_sql('image')}, image LIMIT 2000)""",
)
def positive_negative_sample(spark, d):
    p = detections(spark, d).groupBy("image").agg(F.bool_or(F.col("cls") == 0).alias("positive"))
    return C.sample_rows(p.filter("positive"), "image", 12000).unionByName(C.sample_rows(p.filter("NOT positive"), "image", 2000))


@query(
    "balance_negatives",
    f"""WITH w AS (SELECT doc_id, quality AS label FROM labels), n AS (SELECT doc_id, label, row_number() OVER (ORDER BY {h_sql('doc_id')}, doc_id) - 1 AS r FROM w WHERE label = 0)
    SELECT doc_id, label FROM w WHERE label = 1 UNION ALL SELECT doc_id, label FROM n WHERE r < 3 * (SELECT count(*) FROM w WHERE label = 1)""",
)
def balance_negatives(spark, d):
    w = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return C.balance_negatives(w, "doc_id")


@query(
    "negative_share",
    f"""WITH {DET_SQL}, p AS (SELECT image, NOT bool_or(conf >= 0.9e0) AS neg FROM det GROUP BY image)
    SELECT count(*) AS images, count(*) FILTER (neg) AS negatives, avg(neg::INT) AS share, avg(neg::INT) <= 0.1e0 AS within_limit FROM p""",
)
def negative_share(spark, d):
    p = detections(spark, d).groupBy("image").agg((~F.bool_or(F.col("conf") >= 0.9)).alias("negative"))
    return C.negative_share(p)


@query(
    "augmentation_plan",
    f"""WITH {DET_SQL}, p AS (SELECT image, NOT bool_or(conf >= 0.9e0) AS neg FROM det GROUP BY image), n AS (SELECT count(*) AS n FROM p),
    a AS (SELECT image, 'domain' AS kind, row_number() OVER (ORDER BY {h_sql('image', 0)}, image) - 1 AS r, 0.5e0 AS s FROM p WHERE NOT neg
      UNION ALL SELECT image, 'blend', row_number() OVER (ORDER BY {h_sql('image', 1)}, image) - 1, 0.3e0 FROM p
      UNION ALL SELECT image, 'paste', row_number() OVER (ORDER BY {h_sql('image', 2)}, image) - 1, 0.2e0 FROM p WHERE neg)
    SELECT image, kind FROM a, n WHERE r < floor(n * 0.25e0 * s)""",
)
def augmentation_plan(spark, d):
    p = detections(spark, d).groupBy("image").agg((~F.bool_or(F.col("conf") >= 0.9)).alias("negative"))
    return C.augmentation_plan(p, "image", 0.25)


@query(
    "scene_subset",
    """WITH s AS (SELECT o_orderkey AS image, o_orderkey % 50 / 100e0 AS white, o_custkey % 70 / 100e0 AS lower, o_orderkey % 61 / 100e0 AS upper, o_custkey % 60 AS contrast FROM orders),
    k AS (SELECT *, CASE WHEN white >= 0.18e0 THEN CASE WHEN lower > upper + 0.12e0 AND lower > 0.3e0 THEN 'snow' WHEN contrast < 32 AND white > 0.35e0 AND abs(lower - upper) < 0.2e0 THEN 'fog' END END AS kind FROM s),
    h AS (SELECT l_orderkey AS image, bool_or(l_linenumber % 2 = 0) AS with_fire FROM lineitem GROUP BY 1)
    SELECT image, kind, with_fire FROM k JOIN h USING (image) WHERE kind IS NOT NULL AND with_fire""",
)
def scene_subset(spark, d):
    o = table(spark, d, "orders")
    part = lambda c, m: F.col(c) % m / 100.0
    stats = o.select(
        F.col("o_orderkey").alias("image"), part("o_orderkey", 50).alias("white"), part("o_custkey", 70).alias("lower"),
        part("o_orderkey", 61).alias("upper"), (F.col("o_custkey") % 60).alias("contrast"),
    )
    labels = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") % 2).alias("cls"))
    return C.scene_subset(stats, labels, True).select("image", "kind", "with_fire")


@query(
    "scene_candidates",
    """WITH s AS (SELECT o_orderkey AS image, o_orderkey % 40 / 100e0 AS b, CAST(o_custkey % 160 AS DOUBLE) AS s, CAST(o_orderkey % 250 AS DOUBLE) AS v, CAST(o_custkey % 90 AS DOUBLE) AS d FROM orders),
    q AS (SELECT *, b * 2 + greatest(0, (140 - s) / 140) + greatest(0, (v - 120) / 135) AS snow, greatest(0, (70 - d) / 70) * 2 + greatest(0, (110 - s) / 110) + greatest(0, (v - 100) / 155) AS fog FROM s)
    SELECT image, CASE WHEN b >= 0.18e0 AND s <= 90 THEN 'snow' WHEN d <= 42 AND s <= 80 AND v >= 110 THEN 'fog' ELSE 'plain' END AS kind,
      round_even(CASE WHEN b >= 0.18e0 AND s <= 90 THEN snow WHEN d <= 42 AND s <= 80 AND v >= 110 THEN fog ELSE greatest(snow, fog) END, 9) AS score FROM q""",
)
def scene_candidates(spark, d):
    o = table(spark, d, "orders")
    num = lambda c, m: (F.col(c) % m).cast("double")
    c = S.scene_candidate(F.col("o_orderkey") % 40 / 100.0, num("o_custkey", 160), num("o_orderkey", 250), num("o_custkey", 90))
    return o.select(F.col("o_orderkey").alias("image"), c.alias("c")).select("image", "c.kind", F.bround("c.score", 9).alias("score"))


@query("hard_list", "SELECT c_custkey, c_name FROM customer WHERE CASE WHEN (SELECT bool_or(starts_with(c_name, '0001') OR starts_with(c_name, '0002')) FROM customer) THEN starts_with(c_name, '0001') OR starts_with(c_name, '0002') ELSE contains(c_name, '0001') OR contains(c_name, '0002') END")
def hard_list(spark, d):
    return C.named_list(table(spark, d, "customer").select("c_custkey", "c_name"), ["0001", "0002"], "c_name")


# ---- edits ------------------------------------------------------------------------------


@query(
    "apply_label_edits",
    """WITH l AS (SELECT user_id AS clip, CAST(epoch_us(ts) // 3600000000 % 50 AS INTEGER) AS cs, 0 AS cls, value AS x FROM events WHERE event_type <> 'error'),
    e AS (SELECT user_id AS clip, CAST(epoch_us(ts) // 3600000000 % 50 AS INTEGER) AS cs, event_id, event_id % 3 AS kind, value FROM events WHERE event_type = 'error'),
    last AS (SELECT clip, cs, arg_max(kind, event_id) AS kind, arg_max(value, event_id) AS value FROM e GROUP BY ALL),
    u AS (SELECT l.clip, l.cs, cls, x FROM l WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.clip = l.clip AND last.cs = l.cs)
      UNION ALL SELECT clip, cs, CASE WHEN kind = 0 THEN 1 ELSE -1 END, CASE WHEN kind = 0 THEN value ELSE 0 END FROM last WHERE kind < 2)
    SELECT clip, cs, cls, x FROM u""",
)
def apply_label_edits(spark, d):
    ev = with_ids(spark, d)
    # hours since the epoch, as in the stored labels
    cs = (F.floor(F.col("t") + 1704067200 / 3600) % 50).cast("int")
    zero = [F.lit(0.0).alias(c) for c in ("y", "w", "h")]
    labels = ev.filter("event_type <> 'error'").select("clip", cs.alias("cs"), F.lit(0).alias("cls"), F.col("value").alias("x"), *zero)
    box = F.struct(F.lit(1).alias("cls"), F.col("value").alias("x"), *zero)
    edits = ev.filter("event_type = 'error'").select(
        "clip", cs.alias("cs"), F.col("row_id").alias("saved_at"),
        F.when(F.col("row_id") % 3 == 0, F.array(box)).alias("boxes"), (F.col("row_id") % 3 == 2).alias("clear"),
    )
    return C.apply_edits(labels, edits).select("clip", "cs", "cls", "x")


@query(
    "upsert_propagated",
    """WITH s AS (SELECT user_id AS clip, CAST(epoch_us(ts) // 36000000000 AS INTEGER) % 20 AS tick, CAST(event_id % 2 AS INTEGER) AS obj, max(value) AS x FROM events WHERE event_type = 'click' GROUP BY ALL),
    i AS (SELECT user_id AS clip, CAST(epoch_us(ts) // 36000000000 AS INTEGER) % 20 AS tick, CAST(event_id % 2 AS INTEGER) AS obj, max(value) AS x FROM events WHERE event_type = 'view' GROUP BY ALL),
    h AS (SELECT DISTINCT user_id AS clip, CAST(epoch_us(ts) // 36000000000 AS INTEGER) % 20 AS tick FROM events WHERE event_type = 'purchase'),
    f AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.clip = i.clip AND h.tick = i.tick))
    SELECT coalesce(f.clip, s.clip) AS clip, coalesce(f.tick, s.tick) AS tick, coalesce(f.obj, s.obj) AS obj, coalesce(f.x, s.x) AS x FROM s FULL JOIN f ON s.clip = f.clip AND s.tick = f.tick AND s.obj = f.obj""",
)
def upsert_propagated(spark, d):
    ev = with_ids(spark, d).withColumn("tick", (F.floor((F.col("t") + 1704067200 / 3600) / 10).cast("int") % 20)).withColumn("obj", (F.col("row_id") % 2).cast("int"))
    part = lambda kind: ev.filter(F.col("event_type") == kind).groupBy("clip", "tick", "obj").agg(F.max("value").alias("x"))
    return C.upsert_auto(part("click"), part("view"), ev.filter("event_type = 'purchase'").select("clip", "tick"))


@query(
    "drop_propagated",
    """WITH s AS (SELECT user_id AS clip, event_id, CAST(event_id % 6 AS INTEGER) AS tick, CAST(event_id % 4 AS INTEGER) AS obj FROM events)
    SELECT clip, event_id, tick, obj FROM s WHERE NOT (clip % 5 = 0 AND tick = 3) AND NOT (clip % 7 = 0 AND obj = 1) AND clip % 11 <> 0""",
)
def drop_propagated(spark, d):
    ev = table(spark, d, "events")
    s = ev.select(F.col("user_id").alias("clip"), "event_id", (F.col("event_id") % 6).cast("int").alias("tick"), (F.col("event_id") % 4).cast("int").alias("obj"))
    clips = s.select("clip").distinct()
    out = C.drop_frames(s, clips.filter("clip % 5 = 0").select("clip", F.lit(3).alias("tick")))
    out = C.drop_objects(out, clips.filter("clip % 7 = 0").select("clip", F.lit(1).alias("obj")))
    return C.clear_clips(out, clips.filter("clip % 11 = 0"))


@query(
    "add_seed_boxes",
    """WITH s AS (SELECT user_id AS clip, CAST(event_id % 2 AS INTEGER) AS obj, CAST(event_id % 40 AS INTEGER) AS cs, event_type, value FROM events),
    a AS (SELECT clip, obj, cs, min(value) AS box FROM s WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT clip, obj, cs, min(value) AS box FROM s WHERE event_type = 'view' GROUP BY ALL)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.clip = b.clip AND a.obj = b.obj AND a.cs = b.cs)""",
)
def add_seed_boxes(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("clip"), (F.col("event_id") % 2).cast("int").alias("obj"), (F.col("event_id") % 40).cast("int").alias("cs"), "event_type", "value")
    part = lambda kind: ev.filter(F.col("event_type") == kind).groupBy("clip", "obj", "cs").agg(F.min("value").alias("box"))
    return C.add_seeds(part("click"), part("view"))


@query(
    "anti_join_used",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def anti_join_used(spark, d):
    return joins.without(docs(spark, d).select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query(
    "leak_check",
    f"WITH {DOCS_SQL}, tr AS (SELECT clip FROM dc WHERE clip % 4 <> 0), ev AS (SELECT clip FROM dc WHERE clip % 4 = 0) SELECT count(*) AS leaks, (SELECT count(*) FROM tr) AS train FROM tr WHERE clip IN (SELECT clip FROM ev)",
)
def leak_check(spark, d):
    """The assertion itself, then the counts it is based on."""
    t = docs(spark, d)
    train, held = t.filter("clip % 4 <> 0"), t.filter("clip % 4 = 0")
    joins.assert_disjoint(train, held)
    leaks = train.join(held.select("clip").distinct(), "clip", "left_semi").agg(F.count(F.lit(1)).alias("leaks"))
    return leaks.withColumn("train", train.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("missing_images", "SELECT count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_images(spark, d):
    sel = docs(spark, d).select(F.col("doc_id").alias("stem"))
    return joins.missing_images(sel, table(spark, d, "labels").select(F.col("doc_id").alias("stem")))


@query(
    "first_label_source",
    """WITH o AS (SELECT doc_id, 1 AS priority, 'label' AS src FROM labels UNION ALL SELECT doc_id, 2, 'text' FROM documents WHERE n_chars > 500 UNION ALL SELECT doc_id, 3, 'any' FROM documents)
    SELECT doc_id, CAST(min(priority) AS INTEGER) AS priority, arg_min(src, priority) AS src FROM o GROUP BY doc_id""",
)
def first_label_source(spark, d):
    t = table(spark, d, "documents")
    o = table(spark, d, "labels").select("doc_id", F.lit(1).alias("priority"), F.lit("label").alias("src"))
    o = o.unionByName(t.filter("n_chars > 500").select("doc_id", F.lit(2).alias("priority"), F.lit("text").alias("src")))
    o = o.unionByName(t.select("doc_id", F.lit(3).alias("priority"), F.lit("any").alias("src")))
    return joins.first_source(o, ["doc_id"])


@query(
    "evaluation_classes",
    f"""WITH b AS (SELECT event_id, user_id AS clip, event_id % 5 AS obj, CASE user_id % 4 WHEN 0 THEN '/raw/방화/x.mp4' WHEN 1 THEN '/raw/침입/x.mp4' WHEN 2 THEN '/raw/쓰러짐/방화/x.mp4' ELSE '/raw/other/x.mp4' END AS path FROM events),
    m AS (SELECT *, CASE WHEN path LIKE '%방화%' THEN 'fire' WHEN path LIKE '%침입%' OR path LIKE '%배회%' OR path LIKE '%쓰러짐%' THEN 'person' ELSE 'none' END AS mode FROM b)
    SELECT event_id, clip, mode, CAST(CASE WHEN mode = 'fire' THEN greatest(0, least(1, obj - 1)) ELSE 0 END AS INTEGER) AS cls FROM m WHERE mode <> 'none'""",
)
def evaluation_classes(spark, d):
    """Propagated objects of scoring clips, with the class of their mode; the mode comes from the clip's folders."""
    k = F.col("user_id") % 4
    path = F.when(k == 0, "/raw/방화/x.mp4").when(k == 1, "/raw/침입/x.mp4").when(k == 2, "/raw/쓰러짐/방화/x.mp4").otherwise("/raw/other/x.mp4")
    b = table(spark, d, "events").select("event_id", F.col("user_id").alias("clip"), (F.col("event_id") % 5).alias("obj"), K.clip_mode(path, F.lit("none")).alias("mode"))
    return C.classed(b.filter("mode = 'fire'"), "fire").unionByName(C.classed(b.filter("mode = 'person'"), "person"))
