"""Joins between samples, ground truth, zones, models and label times."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import carry_both, next_value, time_bucket


def with_truth(samples: DataFrame, truth: DataFrame) -> DataFrame:
    """Left join on the clip; Spark broadcasts ground truth while it is small."""
    return samples.join(truth, "clip", "left")


def at_same_times(signals: Sequence[DataFrame] | DataFrame, models: int, digits: int = 2) -> DataFrame:
    """One row per clip and time rounded to ``digits``: ``f0, s0, h0, f1, ...``, fire and smoke of each model and whether it has a sample.

    ``signals`` has a table per model, or is one table whose rows hold a sample
    of each model as ``m0, m1, ...``, structs of fire and smoke or null: that
    is shuffled as one row instead of one per model.
    """
    if isinstance(signals, DataFrame):
        merged = signals.select("clip", F.bround("t", digits).alias("t"), *[f"m{i}" for i in range(models)])
    else:
        merged = None
        for i, s in enumerate(signals):
            sample = F.struct("fire", "smoke")
            own = [(sample if i == j else F.lit(None).cast(s.select(sample.alias("m")).schema["m"].dataType)).alias(f"m{j}") for j in range(models)]
            one = s.select("clip", F.bround("t", digits).alias("t"), *own)
            merged = one if merged is None else merged.unionByName(one)
    aggs: list[Column] = []
    for i in range(models):
        aggs += [F.max(f"m{i}.fire").alias(f"f{i}"), F.max(f"m{i}.smoke").alias(f"s{i}"), F.max(F.col(f"m{i}").isNotNull()).alias(f"h{i}")]
    return merged.groupBy("clip", "t").agg(*aggs)


def combinations_of(models: int) -> list[tuple[int, ...]]:
    """All combinations of at least two models, in the order of ``combo``."""
    return [c for k in range(2, models + 1) for c in combinations(range(models), k)]


def fuse_models(signals: Sequence[DataFrame] | DataFrame, digits: int = 2, models: int | None = None) -> DataFrame:
    """All combinations of at least two models, on clip and time rounded to ``digits``.

    Only samples every member of the combination has are kept.  Each model is
    shuffled once; a sample is then combined with a literal list of the few
    combinations it belongs to.

    With a table of ``at_same_times`` and its number of ``models`` the rows stay
    one per clip and time: each combination becomes a column ``c0, c1, ...``,
    null where a member lacks the sample.
    """
    wide = signals if models else at_same_times(signals, len(signals), digits)
    combos = combinations_of(models or len(signals))

    def cell(n: int, members: tuple[int, ...]) -> Column:
        present = F.lit(True)
        for i in members:
            present = present & F.col(f"f{i}").isNotNull()
        fires, smokes = [F.col(f"f{i}") for i in members], [F.col(f"s{i}") for i in members]
        total = lambda cols: sum(cols[1:], cols[0])
        return F.when(
            present,
            F.struct(
                F.lit(n).alias("combo"),
                F.greatest(*fires).alias("fire_max"), F.greatest(*smokes).alias("smoke_max"),
                F.least(*fires).alias("fire_min"), F.least(*smokes).alias("smoke_min"),
                (total(fires) / len(members)).alias("fire_mean"), (total(smokes) / len(members)).alias("smoke_mean"),
            ),
        )

    if models:
        return wide.withColumns({f"c{n}": cell(n, c) for n, c in enumerate(combos)})
    cells = F.array_compact(F.array(*[cell(n, c) for n, c in enumerate(combos)]))
    return wide.select("clip", "t", F.inline(cells))


def nearest_within(
    left: DataFrame, right: DataFrame, payload: Sequence[str], keys: Sequence[str] = ("clip",), t: str = "t", limit: float = 1.0
) -> DataFrame:
    """Nearest right row closer than ``limit``; the earlier one wins on equal distance.

    The limit bounds the search, so both sides meet on buckets of its width.
    Needs a unique ``row_id`` on the left.
    """
    bucket = lambda c: F.floor(c / F.lit(limit)).cast("long")
    probes = left.withColumn("_b", bucket(F.col(t))).withColumn(
        "_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))
    )
    other = right.select(*keys, F.col(t).alias("_rt"), *payload).withColumn("_b", bucket(F.col("_rt")))
    near = probes.select(*keys, "row_id", t, "_b").join(other, [*keys, "_b"]).withColumn("_d", F.abs(F.col(t) - F.col("_rt")))
    best = (
        near.filter(F.col("_d") < limit)
        .groupBy("row_id")
        .agg(F.min_by(F.struct(F.col("_rt").alias("near_t"), *payload), F.struct("_d", "_rt")).alias("_best"))
    )
    return left.join(best, "row_id", "left").select(
        *left.columns, F.col("_best.near_t").alias("near_t"), *[F.col(f"_best.{p}").alias(p) for p in payload]
    )


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("clip",), t: str = "t", seconds: float = 1800.0
) -> DataFrame:
    """Nearest right time without a limit, through the last and the next one."""
    both = left.select(*keys, "row_id", t).withColumn("_rt", F.lit(None).cast("double")).unionByName(
        right.select(*keys, F.lit(None).cast("long").alias("row_id"), t, F.col(t).alias("_rt"))
    ).withColumn("_side", F.when(F.col("_rt").isNull(), 1).otherwise(0))
    bucket = time_bucket(t, seconds)
    both = carry_both(both, keys, [t, "_side"], bucket, F.col("_rt"), "_last", "_next")
    gap_last, gap_next = F.col(t) - F.col("_last"), F.col("_next") - F.col(t)
    pick = F.when(F.col("_last").isNull(), F.col("_next")).when(
        F.col("_next").isNull() | (gap_last <= gap_next), F.col("_last")
    ).otherwise(F.col("_next"))
    return both.filter("_side = 1").select(*keys, "row_id", t, pick.alias("near_t"))


def seed_segments(seeds: DataFrame, keys: Sequence[str] = ("clip", "obj"), t: str = "t", seconds: float = 1800.0) -> DataFrame:
    """Each seed owns the time up to the next one; of two at the same time the later row counts."""
    last = seeds.groupBy(*keys, t).agg(F.max_by(F.struct(*[c for c in seeds.columns if c not in (*keys, t)]), "seed").alias("_s"))
    last = last.select(*keys, t, "_s.*")
    return next_value(last, keys, t, time_bucket(t, seconds), "until")


def away_from(
    candidates: DataFrame, positives: DataFrame, gap: float, keys: Sequence[str] = ("clip",), t: str = "t"
) -> DataFrame:
    """Drops candidates closer than ``gap`` to any positive of the clip.

    An equi-join on buckets of width ``gap`` replaces the range condition: a
    positive that close lies in the same or a neighbouring bucket.
    """
    bucket = F.floor(F.col(t) / F.lit(gap)).cast("long")
    near = positives.select(*keys, F.col(t).alias("_q")).withColumn(
        "_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col("_q") / F.lit(gap)).cast("long") + o))
    )
    c = candidates.withColumn("_b", bucket)
    cond = [c[k] == near[k] for k in keys] + [c["_b"] == near["_b"], F.abs(c[t] - near["_q"]) < gap]
    return c.join(near, cond, "left_anti").drop("_b")


def without(df: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(used.select(*keys), list(keys), "left_anti")


def assert_disjoint(train: DataFrame, held_out: DataFrame, key: str = "clip", show: int = 5) -> None:
    """Fails the job when held-out clips appear in the training set."""
    leak = train.select(key).join(held_out.select(key), key, "left_semi").distinct().limit(show).collect()
    if leak:
        raise ValueError(f"held-out {key} values in the training set: {sorted(r[0] for r in leak)}")


def zone_of_clip(clips: DataFrame, zones: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Zone polygon of each clip's location, the first tag that exists wins."""
    rank = F.lit(None).cast("int")
    for i, tag in reversed(list(enumerate(tags))):
        rank = F.when(F.col("tag") == tag, i).otherwise(rank)
    best = (
        zones.withColumn("_rank", rank)
        .filter(F.col("_rank").isNotNull())
        .groupBy("loc")
        .agg(F.min_by(F.struct("tag", "poly"), "_rank").alias("_zone"))
        .select("loc", "_zone.tag", "_zone.poly")
    )
    return clips.join(best, "loc", "left")


def first_source(options: DataFrame, keys: Sequence[str], priority: str = "priority") -> DataFrame:
    """Ordered candidates: the lowest priority per key, in one aggregation."""
    rest = [c for c in options.columns if c not in (*keys, priority)]
    return options.groupBy(*keys).agg(
        F.min(F.struct(priority, *rest)).alias("_best")
    ).select(*keys, f"_best.{priority}", *[f"_best.{c}" for c in rest])


def missing_images(selected: DataFrame, images: DataFrame, key: str = "stem") -> DataFrame:
    """Selected rows with and without an image, counted."""
    have = images.select(key).distinct().withColumn("_have", F.lit(True))
    return selected.join(have, key, "left").agg(
        F.count("_have").alias("found"), F.count(F.when(F.col("_have").isNull(), 1)).alias("missing")
    )
