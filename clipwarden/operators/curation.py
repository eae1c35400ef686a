"""Curating labelled training tables: splits, merges, negatives, sampling, edits.

Random choices use a seeded hash order instead of an in-memory shuffle: the
same sizes and the same rules, reproducible on any number of executors, with
other members than a sequential generator would pick.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import timecode as T
from .joins import away_from
from .ordered import (
    carry_both, hash_bucket, hash_rank_key, running_total, time_bucket, top_per_group, with_position,
)

# ---- picking -------------------------------------------------------------------


def evenly_spaced(r: Column, n: Column, k: int) -> Column:
    """True for the positions ``int(i * (n / k))``, i < k, of n rows; all when n <= k."""
    step = n / F.lit(k)
    guess = F.floor(r / step).cast("long")
    chosen = F.lit(False)
    for near in (-1, 0, 1):
        i = guess + near
        chosen = chosen | ((i >= 0) & (i < k) & (F.floor(i * step).cast("long") == r))
    return (n <= k) | chosen


def pick_even(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, k: int
) -> DataFrame:
    """``k`` evenly spaced rows of every group."""
    placed = with_position(df, keys, order, bucket, "_r", "_n")
    return placed.filter(evenly_spaced(F.col("_r"), F.col("_n"), k)).drop("_n", "_r")


def every_nth(df: DataFrame, position: str, step: int, offset: int = 0) -> DataFrame:
    """Fixed-step pick on an existing position."""
    return df.filter(F.pmod(F.col(position), F.lit(step)) == offset)


def numeric_frames(manifest: DataFrame) -> DataFrame:
    """Rows whose frame is a number; -1 stands for "not numeric" and passes, as its sign is ignored."""
    return manifest.filter(F.regexp_replace(F.col("frame").cast("string"), "^-", "").rlike(r"^\d+$"))


def cap_by_total(groups: DataFrame, size: str, cap: Column, key: str, seed: int = 0, strata: Sequence[str] = ()) -> DataFrame:
    """Groups in hash order while the total before them is under the cap; the overshooting one stays."""
    ranked = groups.withColumn("_h", hash_rank_key(key, seed=seed))
    total = running_total(ranked, strata, ["_h", key], F.col(size).cast("long"), hash_bucket("_h"), "_before")
    return total.filter(F.col("_before") < cap).drop("_h", "_before")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in hash order."""
    return df.withColumn("_h", hash_rank_key(key, seed=seed)).orderBy("_h", key).limit(n).drop("_h")


def sample_share(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Exactly ``int(n * share)`` rows in hash order, without sorting everything in one task."""
    ranked = with_position(
        df.withColumn("_h", hash_rank_key(key, seed=seed)), [], ["_h", key], hash_bucket("_h"), "_r", "_n"
    )
    return (
        ranked.filter(F.col("_r") < F.floor(F.col("_n") * F.lit(share)))
        .drop("_h", "_r", "_n")
    )


def ratio_members(df: DataFrame, key: str, hold: int = 1500, percents: Sequence[int] = (0, 10, 25, 50, 100), seed: int = 0) -> DataFrame:
    """(percent, part, key) of a ratio sweep: the same ``hold`` rows are ``val`` at every point, ``train`` is a share of the rest.

    A larger share holds all of a smaller one, and at 0 % there is no ``train`` row.
    """
    ranked = with_position(df.select(key).withColumn("_h", hash_rank_key(key, seed=seed)), [], ["_h", key], hash_bucket("_h"), "_r", "_n")
    rest = F.greatest(F.col("_n") - hold, F.lit(0))
    part = lambda p: F.when(F.col("_r") < hold, F.lit("val")).when(F.col("_r") - hold < F.floor(rest * p / 100), F.lit("train"))
    cells = F.array(*[F.struct(F.lit(p).alias("percent"), part(p).alias("part")) for p in percents])
    return ranked.select(key, F.inline(cells)).filter(F.col("part").isNotNull()).select("percent", "part", key)


def balance_negatives(windows: DataFrame, key: str, label: str = "label", ratio: int = 3, seed: int = 0) -> DataFrame:
    """All positives and at most ``ratio`` negatives per positive."""
    positives = windows.filter(F.col(label) == 1)
    n = positives.agg(F.count(F.lit(1)).alias("n"))
    negatives = windows.filter(F.col(label) == 0).withColumn("_h", hash_rank_key(key, seed=seed))
    ranked = with_position(negatives, [], ["_h", key], hash_bucket("_h"), "_r")
    kept = ranked.withColumn("_n", n.scalar()).filter(F.col("_r") < F.col("_n") * ratio)
    return positives.unionByName(kept.drop("_h", "_r", "_n"))


def long_lived(samples: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    """Rows of tracks with enough samples."""
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples")).filter(F.col("samples") >= at_least)
    return samples.join(counts, list(keys))


# ---- splits ---------------------------------------------------------------------


def stratified_split(
    groups: DataFrame, strata: Sequence[str], key: str, share: float = 0.2, seed: int = 0
) -> DataFrame:
    """Whole groups to train or val inside each stratum: ``max(1, round(n * share))`` to val, none of one."""
    ranked = groups.withColumn("_h", hash_rank_key(key, seed=seed))
    ranked = with_position(ranked, strata, ["_h", key], hash_bucket("_h"), "_r", "_n")
    n_val = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("long"))).otherwise(0)
    return ranked.withColumn("split", F.when(F.col("_r") < n_val, "val").otherwise("train")).drop("_n", "_r", "_h")


def leak_free_split(files: DataFrame, name: str, group: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Drops repeated file names (the train copy wins) and splits whole clips."""
    priority = F.when(F.col("split") == "train", 0).otherwise(1)
    rest = [c for c in files.columns if c != name]
    unique = files.groupBy(name).agg(F.min_by(F.struct(*rest), priority).alias("_f")).select(name, "_f.*").drop("split")
    groups = unique.select(group).distinct()
    ranked = with_position(
        groups.withColumn("_h", hash_rank_key(group, seed=seed)), [], ["_h", group], hash_bucket("_h"), "_r", "_n"
    )
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * share).cast("long"))
    split = ranked.select(group, F.when(F.col("_r") < n_val, "val").otherwise("train").alias("split"))
    return unique.join(split, group)


def half_per_group(df: DataFrame, keys: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """``n // 2`` rows of every group in hash order."""
    ranked = df.withColumn("_h", hash_rank_key(key, seed=seed))
    ranked = with_position(ranked, keys, ["_h", key], hash_bucket("_h"), "_r", "_n")
    return ranked.filter(F.col("_r") < F.floor(F.col("_n") / 2)).drop("_n", "_r", "_h")


def one_per_group(df: DataFrame, keys: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(hash_rank_key(key, seed=seed), F.col(key))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def thin_smoke_only(presence: DataFrame, key: str, share: float = 0.5, seed: int = 0) -> DataFrame:
    """Drops about half of the images that show smoke but no fire."""
    draw = F.conv(F.substring(hash_rank_key(key, seed=seed), 1, 8), 16, 10).cast("long") / 4294967296.0
    return presence.filter(~(F.col("with_smoke") & ~F.col("with_fire") & (draw < share)))


# ---- merging label sources ----------------------------------------------------------

PRIORITY = {"hand": 0, "auto": 1, "gt": 2, "background": 3}  # fixed order of trust


def merge_sources(sources: Mapping[str, DataFrame], keys: Sequence[str] = ("clip", "tick")) -> DataFrame:
    """One label source per frame: hand before auto before ground truth.

    Every source has the frame key and ``cls, x, y, w, h``.  A row with a
    negative or missing class says "looked at, nothing there": the frame
    becomes background and still blocks weaker sources.
    """
    merged = None
    for name, df in sources.items():
        one = df.select(
            *keys, "cls", "x", "y", "w", "h", F.lit(name).alias("src"), F.lit(PRIORITY[name]).alias("_p")
        )
        merged = one if merged is None else merged.unionByName(one)
    best = merged.groupBy(*keys).agg(F.min("_p").alias("_p"))
    won = merged.join(best, [*keys, "_p"])
    box = F.when(F.col("cls") >= 0, F.struct("cls", "x", "y", "w", "h"))
    # one row per frame; its boxes are bounded by what a frame can show
    return won.groupBy(*keys, "src").agg(F.sort_array(F.array_compact(F.collect_list(box))).alias("boxes"))


def eligibility(frames: DataFrame, contract: DataFrame, mode: str) -> DataFrame:
    """Adds ``reason``: NULL for rows to use, otherwise why not."""
    c = contract.select("category", F.col("mode").alias("_mode"), F.col("use").alias("_use"))
    reason = (
        F.when(F.col("is_eval"), "eval row")
        .when(F.col("_mode").isNull(), "no category")
        .when(F.col("_mode") != mode, F.concat(F.lit("mode "), F.col("_mode")))
        .when(F.col("_use") != "train", F.concat(F.lit("use "), F.col("_use")))
    )
    return frames.join(c, "category", "left").withColumn("reason", reason).drop("_mode", "_use")


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("used")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def frame_split(frames: DataFrame, key: Column, share: float) -> DataFrame:
    from ..functions.keys import md5_split

    return frames.withColumn("split", md5_split(key, share))


def hard_negatives(
    positives: DataFrame,
    clips: DataFrame,
    per_side: int = 5,
    buffer_s: float = 5.0,
    step_s: float = 0.5,
) -> DataFrame:
    """Background times around the labelled span, alternating before and after.

    ``positives`` has ``clip, t, by_hand``; ``clips`` has ``clip, dur``.  Times
    near any positive are dropped; the count is capped by the clip's number of
    hand-labelled frames, and clips without one get none.
    """
    span = positives.groupBy("clip").agg(
        F.min("t").alias("f0"), F.max("t").alias("f1"), F.count(F.when(F.col("by_hand"), 1)).alias("_hand")
    ).filter(F.col("_hand") > 0)
    k = F.explode(F.sequence(F.lit(1), F.lit(per_side))).alias("k")
    steps = span.join(clips, "clip").select("clip", "f0", "f1", "dur", "_hand", k)
    before = F.bround(F.col("f0") - buffer_s - F.col("k") * step_s, 1)
    after = F.bround(F.col("f1") + buffer_s + F.col("k") * step_s, 1)
    cand = steps.select(
        "clip", "_hand",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(before >= 0.5, F.struct(before.alias("t"), (F.col("k") * 2).alias("_o"))),
                    F.when(after <= F.col("dur") - 0.5, F.struct(after.alias("t"), (F.col("k") * 2 + 1).alias("_o"))),
                )
            )
        ).alias("_c"),
    ).select("clip", "_hand", "_c.t", "_c._o")
    clear = away_from(cand, positives.select("clip", "t"), step_s)
    # at most 2 x per_side rows per clip
    ranked = top_per_group(clear, ["clip"], [F.asc("_o")], 2 * per_side, "_rank")
    return ranked.filter(F.col("_rank") <= F.col("_hand")).select("clip", "t", F.col("_rank").alias("rank"))


def background_times(events: DataFrame, per_clip: int = 10, margin_s: float = 5.0) -> DataFrame:
    """Evenly spaced times before the event, snapped to the grid; none for short lead-ins."""
    end = F.col("start_s") - margin_s
    i = F.explode(F.sequence(F.lit(0), F.lit(per_clip - 1))).alias("i")
    return (
        events.filter(F.col("start_s").isNotNull() & (end >= 2))
        .select("clip", end.alias("_end"), i)
        .select("clip", T.tick(F.col("_end") * (F.col("i") + 0.5) / per_clip).alias("tick"))
        .distinct()
    )


def evaluation_set(hand: DataFrame, auto: DataFrame, background: DataFrame, eval_clips: DataFrame) -> DataFrame:
    """Hand over auto over background, on evaluation clips only."""
    only = lambda df: df.join(eval_clips, "clip", "left_semi")
    hand, auto = only(hand), only(auto)
    nothing = [F.lit(-1).alias("cls"), *[F.lit(0.0).alias(c) for c in ("x", "y", "w", "h")]]
    labelled = hand.select("clip").unionByName(auto.select("clip")).distinct()
    bg = background.join(labelled, "clip", "left_semi").select("clip", "tick", *nothing)
    return merge_sources({"hand": hand, "auto": auto, "background": bg})


def classed(auto: DataFrame, mode: str) -> DataFrame:
    """Propagated boxes (``obj`` instead of ``cls``) with the class their object number stands for in an evaluation set."""
    return auto.withColumn("cls", eval_class(F.col("obj"), mode).cast("int")).drop("obj")


def auto_class(obj: Column, mode: str) -> Column:
    """Class of a propagated object: in fire mode object 1 is fire, all others smoke."""
    return F.when(obj == 1, 0).otherwise(1) if mode == "fire" else F.lit(0)


def eval_class(obj: Column, mode: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(1), obj - 1)) if mode == "fire" else F.lit(0)


PROPAGATION_OFFSETS = (-2.0, -1.0, 0.0, 1.0, 2.0)  # fixed values, in seconds


def propagate(labels: DataFrame, offsets: Sequence[float] = PROPAGATION_OFFSETS) -> DataFrame:
    """Copies every labelled frame to nearby times; boxes with a centre outside are left out."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    usable = (F.col("cls") >= 0) & (cx > 0) & (cx < 1) & (cy > 0) & (cy < 1)
    return (
        labels.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
        .withColumn("at", F.col("t") + F.col("offset"))
        .filter(F.col("at") >= 0)
        .withColumn("usable", usable)
        .withColumn("cx", cx)
        .withColumn("cy", cy)
    )


# fixed values: offsets around the event start, in seconds
PLAN_OFFSETS = {
    "full": (0.0, 8.0),
    "snow": (-4.0, 0.0, 5.0, 10.0, 20.0, 35.0),
}


def frame_plan(events: DataFrame, plan: str = "full") -> DataFrame:
    """Which times of a clip to look at, around its event."""
    g = F.col("start_s")
    times = [g + o for o in PLAN_OFFSETS[plan]]
    if plan == "full":
        times.insert(0, F.greatest(F.lit(0.0), g - 10) + 3)
    return (
        events.filter(g.isNotNull())
        .select("clip", F.posexplode(F.array(*times)).alias("part", "t"))
        .filter(F.col("t") >= 0)
    )


def window_plan(events: DataFrame, stride_s: float, cap: int, before_s: float = 2.0, after_s: float = 10.0) -> DataFrame:
    """Times through the event window at a stride, at most ``cap`` of them."""
    lo = F.greatest(F.lit(0.0), F.col("start_s") - before_s)
    n = F.least(F.lit(cap), F.floor((F.col("start_s") + after_s - lo) / stride_s).cast("int") + 1)
    return events.filter(F.col("start_s").isNotNull()).select(
        "clip", lo.alias("_lo"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i")
    ).select("clip", (F.col("_lo") + F.col("i") * stride_s).alias("t"))


# fixed values: seconds after the begin of a clip, and before its event
BACKGROUND_AT, BACKGROUND_BEFORE = (10.0, 30.0, 60.0), (60.0, 30.0)


def background_plan(events: DataFrame, first_s: float = 5.0, clear_s: float = 10.0) -> DataFrame:
    """Times without the event: some fixed, some before it, moved to lie ``clear_s`` before it and not in the first seconds."""
    g = F.col("start_s")
    times = [F.lit(t) for t in BACKGROUND_AT] + [g - t for t in BACKGROUND_BEFORE]
    moved = F.array(*[F.greatest(F.lit(first_s), F.least(t, g - clear_s)) for t in times])
    return events.filter(g.isNotNull()).select("clip", F.explode(F.array_distinct(moved)).alias("t"))


def miss_plan(events: DataFrame, back_s: float = 10.0) -> DataFrame:
    """What a missed event looked like: its time, and the estimated ignition before it."""
    g = F.col("start_s")
    pair = F.array(F.struct(F.lit("gt").alias("tag"), g.alias("t")), F.struct(F.lit("ign").alias("tag"), F.greatest(F.lit(0.0), g - back_s).alias("t")))
    return events.filter(g.isNotNull()).select("clip", F.inline(pair))


# ---- pseudo labels and mining ----------------------------------------------------------


def route_frames(
    boxes: DataFrame, frames: DataFrame, keep: float = 0.35, empty: float = 0.15, cap: int = 40, cap_negative: int = 10
) -> DataFrame:
    """Strong frames become labels, empty ones negatives, the rest is dropped.

    ``frames`` is the sampled axis (``clip, t``).  Per clip at most
    ``cap_negative`` negatives and ``cap`` frames in time order.
    """
    from ..functions.signals import route

    best = boxes.filter(F.col("conf") >= empty).groupBy("clip", "t").agg(F.max("conf").alias("max_conf"))
    routed = frames.join(best, ["clip", "t"], "left").withColumn("route", route(F.col("max_conf"), keep))
    used = routed.filter(F.col("route") == "label")
    empty_frames = top_per_group(
        routed.filter(F.col("route") == "negative"), ["clip"], [F.asc("t")], cap_negative, "_n"
    ).drop("_n")
    return top_per_group(used.unionByName(empty_frames), ["clip"], [F.asc("t")], cap, "rank")


def label_candidates(peaks: DataFrame, labelled_clips: DataFrame, per_clip: int = 6) -> DataFrame:
    """Frames worth labelling next, the most uncertain of each clip."""
    from ..functions.signals import uncertainty, worth_labelling

    flagged = peaks.join(
        labelled_clips.select("clip").distinct().withColumn("_lab", F.lit(True)), "clip", "left"
    ).withColumn("unlabelled", F.col("_lab").isNull()).drop("_lab")
    peak = F.greatest("fire", "smoke")
    scored = flagged.filter(worth_labelling(peak, F.col("unlabelled"))).withColumn(
        "score", uncertainty(peak, F.col("unlabelled"))
    )
    return top_per_group(scored, ["clip"], [F.desc("score"), F.asc("t")], per_clip, "rank")


def mining_candidates(frames: DataFrame, val_clips: DataFrame, used: DataFrame, per_clip: int, bucket: Column) -> DataFrame:
    """Even pick per clip outside validation, without frames that are in use."""
    free = frames.join(val_clips, "clip", "left_anti")
    return pick_even(free, ["clip"], ["frame", "stem"], bucket, per_clip).join(used.select("stem"), "stem", "left_anti")


def oversample(base: DataFrame, extra: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """Base plus ``k`` copies of every extra set, as rows."""
    out = base
    for df, k in extra.values():
        if k > 0:
            copies = df.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(int(k))))).drop("_c")
            out = out.unionByName(copies)
    return out


def negative_share(images: DataFrame, limit: float = 0.10) -> DataFrame:
    """Share of images without boxes in a mix, and whether it keeps the limit."""
    share = F.avg(F.col("negative").cast("double"))
    return images.agg(
        F.count(F.lit(1)).alias("images"), F.count(F.when(F.col("negative"), 1)).alias("negatives"), share.alias("share")
    ).withColumn("within_limit", F.col("share") <= limit)


AUGMENT_SHARES = (("domain", 0.5, "labelled"), ("blend", 0.3, "all"), ("paste", 0.2, "empty"))  # fixed values


def augmentation_plan(images: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Which images to augment how: ``int(n * ratio * share)`` per kind from its pool."""
    n = images.agg(F.count(F.lit(1)).alias("n"))
    pools = {"labelled": ~F.col("negative"), "all": F.lit(True), "empty": F.col("negative")}
    out = None
    for i, (kind, share, pool) in enumerate(AUGMENT_SHARES):
        ranked = with_position(
            images.filter(pools[pool]).withColumn("_h", hash_rank_key(key, seed=seed + i)),
            [], ["_h", key], hash_bucket("_h"), "_r",
        ).withColumn("_n", n.scalar())
        part = ranked.filter(F.col("_r") < F.floor(F.col("_n") * ratio * share)).select(key, F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- propagated boxes -------------------------------------------------------------------


def expected_area(frames: DataFrame, seeds: DataFrame, seconds: float = 1800.0) -> DataFrame:
    """Box area interpolated between the seeds of the same object; constant outside."""
    keys = ["clip", "obj"]
    both = frames.withColumn("_seed", F.lit(None).cast("struct<t:double,area:double>")).withColumn("_side", F.lit(1))
    marks = seeds.select(
        *keys, "t", F.struct(F.col("t").cast("double").alias("t"), F.col("area").cast("double").alias("area")).alias("_seed"),
        F.lit(0).alias("_side"),
    )
    both = both.unionByName(marks, allowMissingColumns=True)
    bucket = time_bucket("t", seconds)
    # a seed at the same time sorts before the frame: it is the last one, not the next
    both = carry_both(both, keys, ["t", "_side"], bucket, F.col("_seed"), "_last", "_next")
    a, b = F.col("_last"), F.col("_next")
    w = F.when(b["t"] > a["t"], (F.col("t") - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0))).otherwise(0.0)
    value = F.when(a.isNull(), b["area"]).when(b.isNull(), a["area"]).otherwise(a["area"] + (b["area"] - a["area"]) * w)
    return both.filter("_side = 1").withColumn("expected", value).drop("_seed", "_side", "_last", "_next")


def drift_filter(boxes: DataFrame, frame_area: float) -> DataFrame:
    """Marks empty boxes and boxes whose size ran away from the seeds."""
    area = F.col("area")
    want = F.coalesce(F.when(F.col("expected") != 0, F.col("expected")), area)
    off = (area > 0.5 * frame_area) | (area > 3 * want) | (area < want / 3)
    return boxes.withColumn("dropped", F.when(area == 0, "empty").when(off, "size"))


# ---- label edits -----------------------------------------------------------------------


def apply_edits(labels: DataFrame, edits: DataFrame) -> DataFrame:
    """Latest edit per frame replaces all its boxes.

    ``labels`` are box rows on (clip, cs) with ``cs`` the time in whole
    centiseconds, so that "the same time" is an equality.  ``edits`` has
    ``clip, cs, saved_at, boxes, clear``; an edit without boxes leaves the
    "looked at, nothing there" row unless it clears the frame.
    """
    latest = edits.groupBy("clip", "cs").agg(F.max_by(F.struct("boxes", "clear"), "saved_at").alias("_e"))
    latest = latest.select("clip", "cs", "_e.boxes", "_e.clear")
    kept = labels.join(latest, ["clip", "cs"], "left_anti")
    boxes = F.coalesce("boxes", F.array())
    nothing = F.struct(F.lit(-1).alias("cls"), *[F.lit(0.0).alias(c) for c in ("x", "y", "w", "h")])
    rows = F.when(F.size(F.col("boxes")) > 0, F.col("boxes")).when(~F.col("clear"), F.array(nothing)).otherwise(F.slice(F.array(nothing), 1, 0))
    fresh = latest.select("clip", "cs", F.inline(rows))
    return kept.unionByName(fresh)


def cut_replaced(auto: DataFrame, edits: DataFrame) -> DataFrame:
    """Propagated frames give way to a hand edit of the same grid time."""
    touched = edits.select("clip", T.tick(F.col("cs") / 100).alias("tick")).distinct()
    return auto.join(touched, ["clip", "tick"], "left_anti")


def upsert_auto(stored: DataFrame, incoming: DataFrame, hand_frames: DataFrame) -> DataFrame:
    """Merges propagated boxes per (clip, tick, obj); hand frames are skipped, newer rows win."""
    keys = ["clip", "tick", "obj"]
    fresh = incoming.join(hand_frames.select("clip", "tick").distinct(), ["clip", "tick"], "left_anti")
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_r")).select(*keys, "_r.*")


def add_seeds(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Reference boxes stay unique by (clip, obj, time in centiseconds); the first one stays."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in ("clip", "obj", "cs")]
    return both.groupBy("clip", "obj", "cs").agg(F.min_by(F.struct(*rest), "_new").alias("_r")).select("clip", "obj", "cs", "_r.*")


def drop_frames(auto: DataFrame, frames: DataFrame) -> DataFrame:
    return auto.join(frames, ["clip", "tick"], "left_anti")


def drop_objects(auto: DataFrame, objects: DataFrame) -> DataFrame:
    return auto.join(objects, ["clip", "obj"], "left_anti")


def clear_clips(auto: DataFrame, clips: DataFrame) -> DataFrame:
    """Removes all propagated frames of the clips; seeds live in their own table and stay."""
    return auto.join(clips, "clip", "left_anti")


# ---- scene subsets ---------------------------------------------------------------------


def scene_subset(stats: DataFrame, labels: DataFrame, need_fire: bool = False) -> DataFrame:
    """Snow and fog images that have a label (and, on request, a fire box)."""
    from ..functions.signals import snow_or_fog

    have = labels.groupBy("image").agg(F.coalesce(F.bool_or(F.col("cls") == 0), F.lit(False)).alias("with_fire"))
    kind = snow_or_fog(F.col("white"), F.col("lower"), F.col("upper"), F.col("contrast"))
    out = stats.withColumn("kind", kind).filter(F.col("kind").isNotNull()).join(have, "image")
    return out.filter("with_fire") if need_fire else out


def named_list(images: DataFrame, prefixes: Sequence[str], name: str = "file") -> DataFrame:
    """Files that start with one of the names; when none does, files that contain one."""
    starts, holds = F.lit(False), F.lit(False)
    for p in prefixes:
        starts, holds = starts | F.col(name).startswith(p), holds | F.col(name).contains(p)
    any_start = images.agg(F.coalesce(F.bool_or(starts), F.lit(False)).alias("a"))
    return images.withColumn("_a", any_start.scalar()).filter((F.col("_a") & starts) | (~F.col("_a") & holds)).drop("_a")
