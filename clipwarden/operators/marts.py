"""Result marts, dataset statistics and nested clip documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .ordered import order_statistic


def dataset_stats(boxes: DataFrame, by: Sequence[str] = ("cls",), area: str = "area", small: float = 0.01) -> DataFrame:
    """Boxes per class: count, median area, share of small ones."""
    counts = boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("boxes"), F.avg((F.col(area) < small).cast("double")).alias("small_share"))
    median = order_statistic(boxes, by, area, 0.5, "median_area").select(F.struct(*by).alias("_key"), "median_area")
    return counts.withColumn("_key", F.struct(*by)).join(median, "_key", "left").select(*by, "boxes", "median_area", "small_share")


def top_resolutions(images: DataFrame, k: int = 4) -> DataFrame:
    return images.groupBy("width", "height").agg(F.count(F.lit(1)).alias("images")).orderBy(
        F.desc("images"), "width", "height"
    ).limit(k)


def brightness_buckets(stats: DataFrame, value: str = "brightness") -> DataFrame:
    from ..functions.signals import daylight

    day = daylight(F.col(value))
    n = lambda name: F.count(F.when(day == name, 1))
    return stats.agg(
        F.count(F.lit(1)).alias("images"), n("night").alias("night"), n("dusk").alias("dusk"), n("day").alias("day"),
        F.avg(value).alias("mean"),
    )


def fold_statistics(folds: DataFrame, value: str = "f1", by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and range over folds."""
    return folds.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )


def labelled_frames(hand: DataFrame, auto: DataFrame) -> DataFrame:
    """Distinct labelled half-second frames per clip, hand boxes and propagated ones together."""
    both = hand.filter(F.col("cls") >= 0).select("clip", "tick").unionByName(auto.select("clip", "tick"))
    return both.groupBy("clip").agg(F.countDistinct("tick").alias("frames"))


def frame_kinds(hand: DataFrame) -> DataFrame:
    """Hand frames by kind: ``box`` with any box, ``empty`` when only looked at."""
    kind = F.when(F.bool_or(F.col("cls") >= 0), "box").otherwise("empty")
    return hand.groupBy("clip", "tick").agg(kind.alias("kind"))


def clip_documents(clips: DataFrame, part_s: float = 600.0, **tables: DataFrame) -> DataFrame:
    """Nested documents: (clip, part, about, one array per table).

    ``about`` is a struct of the columns of ``clips`` (one row per clip, such as
    its event, conditions and zone), in part 0.  Every table has ``clip, t`` and
    columns of its own; its rows become an array of structs in time order, empty
    where a part has none.  All tables go through one exchange as a tagged
    union.  A document covers ``part_s`` seconds, so a clip of any length
    becomes several rows of bounded size.  Clips without rows have part 0;
    clips that only tables know have no ``about``.
    """
    kinds = {name: [c for c in df.columns if c != "clip"] for name, df in tables.items()}
    own = [c for c in clips.columns if c != "clip"]
    rows = [clips.select("clip", F.lit(0).cast("long").alias("part"), F.struct(*own).alias("about"))]
    for name, df in tables.items():
        fields = ["t", *[c for c in kinds[name] if c != "t"]]
        rows.append(df.select("clip", F.floor(F.col("t") / F.lit(part_s)).cast("long").alias("part"), F.struct(*fields).alias(name)))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    nested = [F.array_sort(F.collect_list(name)).alias(name) for name in kinds]
    return union.groupBy("clip", "part").agg(F.first("about", ignorenulls=True).alias("about"), *nested)


def label_set_rollup(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per clip: files, boxes on known files, and all boxes including those on unknown files."""
    per_file = boxes.groupBy("clip", "file").agg(F.count(F.lit(1)).alias("_n"))
    known = frames.select("clip", "file").distinct().withColumn("_known", F.lit(1))
    both = known.join(per_file, ["clip", "file"], "full")
    return both.groupBy("clip").agg(
        F.count("_known").alias("frame_count"), F.coalesce(F.sum("_n"), F.lit(0)).alias("box_count"),
        F.coalesce(F.sum(F.when(F.col("_known").isNotNull(), F.col("_n"))), F.lit(0)).alias("attached"),
    )


def merged_dataset(files: DataFrame, folders: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Files of a dataset spread over folders: a name counts once, the first folder owns it."""
    rest = [c for c in files.columns if c not in (*keys, "file")]
    ranked = files.join(folders, "folder")
    return ranked.groupBy(*keys, "file").agg(F.min_by(F.struct(*rest), "folder_order").alias("_f")).select(*keys, "file", "_f.*")


def dataset_summary(files: DataFrame, shown: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Total files, shown files and the labelled share of the shown ones."""
    total = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    part = shown.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shown"), F.bround(F.avg(F.col("labeled").cast("double")), 2).alias("labeled_ratio")
    )
    return total.join(part, list(keys))


def verdict_matrix(verdicts: DataFrame, experiments: Sequence[str], row: str = "clip", name: str = "name") -> DataFrame:
    """Verdict heat map: clips by experiments.

    Experiments are few and become the columns, named by the caller so that no
    extra pass looks for them; clips grow with the data and stay rows.
    """
    return verdicts.groupBy(row).pivot(name, list(experiments)).agg(F.first("verdict"))


def best_per_item(results: DataFrame) -> DataFrame:
    """Highest F1 per item; the first listed wins on ties."""
    rest = [c for c in results.columns if c != "item"]
    return results.groupBy("item").agg(F.max_by(F.struct(*rest), F.struct("f1", -F.col("seq"))).alias("_b")).select("item", "_b.*")


def deduplicate_results(results: DataFrame) -> DataFrame:
    """Runs with the same item, score and counts are one result.

    The best-documented, newest run stands for it; names of all runs are kept,
    and per-clip verdicts or rules are borrowed from another run when missing.
    """
    rank = (
        F.when(F.col("model").isNotNull(), 4).otherwise(0)
        + F.when(F.col("kind") == "live", 2).when(F.col("kind") == "archive", 0).otherwise(3)
        + F.when(F.coalesce(F.size("clips"), F.lit(0)) > 0, 1).otherwise(0)
    )
    order = F.struct(rank, "mtime", F.col("seq") * -1)
    keys = ["item", "f1", "tp", "fn", "fp"]
    has_clips = F.when(F.coalesce(F.size("clips"), F.lit(0)) > 0, order)
    has_rules = F.when(F.coalesce(F.size("rules"), F.lit(0)) > 1, order)
    return (
        results.groupBy(*keys)
        .agg(
            F.max_by(F.struct("name", "rules", "mtime"), order).alias("_r"),
            F.sort_array(F.collect_set("name")).alias("members"),
            F.max_by("clips", has_clips).alias("clips"),
            F.max_by("rules", has_rules).alias("_rules"),
        )
        .select(*keys, "_r.name", "_r.mtime", "members", "clips", F.coalesce("_rules", "_r.rules").alias("rules"))
    )


def facet_counts(cond: DataFrame) -> DataFrame:
    """How many clips pass each condition filter, in one aggregation."""
    from ..functions.signals import CONDITION_FILTERS, condition_filter

    c = [F.col(n) for n in ("tod", "snow", "rain", "fog")]
    return cond.agg(
        F.count(F.lit(1)).alias("all"), *[F.count(F.when(condition_filter(n, *c), 1)).alias(n) for n in CONDITION_FILTERS]
    )


def compare_models(metrics: DataFrame) -> DataFrame:
    """Models by mAP50-95, best first."""
    return metrics.orderBy(F.desc("map5095"), "name")


def evaluation_table(per_class: DataFrame, alarms: DataFrame) -> DataFrame:
    """(section, name, metric, value): what an evaluation report shows.

    ``per_class`` has ``cls`` and a column per metric; ``alarms`` is the one row
    of image-level counts and rates.
    """
    def long(df: DataFrame, section: str, name, columns: Sequence[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.inline(cells))

    classes = long(per_class, "class", F.col("cls").cast("string"), [c for c in per_class.columns if c != "cls"])
    return classes.unionByName(long(alarms, "alarm", F.lit("images"), alarms.columns))
