"""Detection quality: matching boxes to truth, average precision, hard lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.geometry import iou
from ..session import checkpoint, passing
from .ordered import in_even_buckets

IOU_LEVELS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))  # fixed values


def match(
    detections: DataFrame, truths: DataFrame, levels: Sequence[float] = (0.5,), keys: Sequence[str] = ("image", "cls")
) -> DataFrame:
    """Adds ``hits``: the overlap levels at which a detection is a true positive.

    Needs ``det_id`` and ``truth_id``, unique in their image and class, and
    corner boxes ``box``.  Each detection takes the truth it overlaps most, and
    a truth goes to its most confident taker among those that overlap it
    enough.  Both tables are dealt by image and class once, and a detection
    stays one row.
    """
    keys = list(keys)
    rest = [c for c in detections.columns if c not in (*keys, "det_id")]
    boxes = truths.groupBy(*keys).agg(F.collect_list(F.struct("truth_id", F.col("box").alias("_t"))).alias("_truths"))
    overlaps = F.transform("_truths", lambda t: F.struct(iou(F.col("box"), t["_t"]).alias("_iou"), (-t["truth_id"]).alias("_neg")))
    taken = detections.join(boxes, keys, "left").select(
        *detections.columns, F.array_max(F.filter(overlaps, lambda o: o["_iou"] >= min(levels))).alias("_best")
    )
    takers = taken.groupBy(*keys, "det_id").agg(
        F.collect_list(F.struct(*rest)).alias("_rows"), F.max("_best").alias("_best"),
        F.max(F.when(F.col("_best").isNotNull(), F.col("conf"))).alias("_conf"),
    )
    # a taker wins the levels that it reaches and no more confident one does
    order = [F.desc("_conf"), F.asc_nulls_last("det_id")]
    ahead = Window.partitionBy(*keys, "_best._neg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reached, before = F.col("_best._iou"), F.max("_best._iou").over(ahead)
    takers = takers.withColumn("_before", before)
    won = F.filter(
        F.array(*[F.lit(float(v)) for v in levels]), lambda v: (reached >= v) & ~F.coalesce(F.col("_before") >= v, F.lit(False))
    )
    known = reached.isNotNull() & F.col("det_id").isNotNull()
    judged = takers.withColumn("hits", F.when(known, won).otherwise(F.array().cast("array<double>")))
    return judged.select(*keys, "det_id", "hits", F.inline("_rows")).select(*detections.columns, "hits")


def level_counts(judged: DataFrame, levels: Sequence[float] = IOU_LEVELS) -> DataFrame:
    """True and false positives per class and level."""
    hit = lambda v: F.array_contains("hits", F.lit(v))
    wide = judged.groupBy("cls").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.when(hit(v), 1)).alias(f"h{i}") for i, v in enumerate(levels)]
    )
    cells = F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"h{i}").alias("tp"), (F.col("_n") - F.col(f"h{i}")).alias("fp")) for i, v in enumerate(levels)])
    return wide.select("cls", F.inline(cells))


def _hits_in_order(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a partition in ranking order: each hit with its place and its number per level, then the sums of each class."""
    names = ["cls", "_part", "_sums", "found", *[f"c{i}" for i in range(levels)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found, counts = None, 0, np.zeros(levels, dtype=np.int64)

        def sums() -> pa.RecordBatch:
            cells = [pa.array([True]), pa.array([found]), *[pa.array([int(c)]) for c in counts]]
            return pa.RecordBatch.from_arrays([*last, *cells], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cls, part = batch.column("cls"), batch.column("_part")
            masks = batch.column("_mask").to_numpy(zero_copy_only=False)
            differs = np.flatnonzero(pc.not_equal(cls[1:], cls[:-1]).to_numpy(zero_copy_only=False)) + 1
            for start, end in pairwise([0, *differs.tolist(), len(cls)]):
                if last is None or last[0][0] != cls[start]:
                    if last is not None:
                        yield sums()
                    last, found, counts = (cls.slice(start, 1), part.slice(start, 1)), 0, np.zeros(levels, dtype=np.int64)
                bits = (masks[start:end, None] >> np.arange(levels)) & 1
                hit = np.flatnonzero(masks[start:end])
                numbers = (counts + bits.cumsum(axis=0))[hit]
                cells = [pa.array(numbers[:, i], mask=bits[hit, i] == 0) for i in range(levels)]
                at = pa.array(hit + start)
                yield pa.RecordBatch.from_arrays(
                    [cls.take(at), part.take(at), pa.array(np.zeros(len(hit), dtype=bool)), pa.array(hit + found + 1), *cells], names
                )
                found, counts = found + end - start, counts + bits.sum(axis=0)
        if last is not None:
            yield sums()

    return run


def average_precision(
    judged: DataFrame, truths: DataFrame, levels: Sequence[float] = IOU_LEVELS, points: int = 100, stored: bool = False
) -> DataFrame:
    """Area under the interpolated precision envelope per class and level.

    The recall-precision curve starts at (0, 1), ends at (1, 0), is read at 101
    evenly spaced recalls and integrated by trapezoids.  Detections are ranked
    in buckets of about equal size, whatever their confidences: a class or a
    single confidence that holds most of them is still spread over many tasks.
    All levels share the ranking.  It is dealt once, only hits are kept of it,
    and their precisions meet in one row per evaluation point.  ``stored`` says
    that ``judged`` is a table that can be read again at little cost.
    """
    n = truths.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    spread = range(len(levels))
    mask = reduce(Column.bitwiseOR, [F.when(F.array_contains("hits", F.lit(v)), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(levels)])
    order = ["cls", "_rank", "image", "det_id"]
    counts = [f"c{i}" for i in spread]
    long = LongType()
    with passing(judged.sparkSession) as store:
        ranking = judged.filter(F.col("cls").isNotNull()).select(
            "cls", (-F.col("conf")).alias("_rank"), "image", "det_id", mask.cast("long").alias("_mask")
        )
        ranking = in_even_buckets(ranking if stored else store(ranking), order, "_part")
        schema = StructType([
            ranking.schema["cls"], StructField("_part", long), StructField("_sums", BooleanType()), *[StructField(c, long) for c in ("found", *counts)]
        ])
        ranked = ranking.sortWithinPartitions(*order).select("cls", "_part", "_mask").mapInArrow(_hits_in_order(len(levels)), schema)
        ranked = store(ranked)
        sums = ranked.filter("_sums")
        before = Window.partitionBy("cls").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        ahead = {f"_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("found", *counts)}
        # one row per bucket and class in it
        offsets = sums.withColumns(ahead).join(F.broadcast(n), "cls").select("cls", "_part", "n", *ahead)
        hits = ranked.filter(~F.col("_sums")).join(F.broadcast(offsets), ["cls", "_part"])
        found = (F.col("_found") + F.col("found")).alias("found")
        cell = lambda i: F.when(
            F.col(counts[i]).isNotNull(), F.struct(F.lit(i).alias("level"), (F.col(f"_{counts[i]}") + F.col(counts[i])).alias("ctp"), found)
        )
        hits = hits.select("cls", "n", F.inline(F.array_compact(F.array(*[cell(i) for i in spread]))))
        # the last point whose step of recall begins before this hit: the envelope there and before takes its precision
        point = F.least(F.ceil(F.col("ctp") * points / F.col("n")) - 1, F.lit(points))
        near = hits.groupBy("cls", "level", point.alias("x")).agg(F.max(F.col("ctp") / F.col("found")).alias("p"), F.min("found").alias("f"))
        near = near.groupBy("cls", "level").agg(F.collect_list(F.struct("x", "p", "f")).alias("_near"))
        whole = sums.groupBy("cls").agg(F.sum("found").alias("_all"), *[F.sum(c).alias(c) for c in counts]).join(n, "cls")
        cells = F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("_ctp")) for i, c in enumerate(counts)])
        curve = checkpoint(whole.select("cls", "n", "_all", F.inline(cells)).join(near, ["cls", "level"], "left"))
    total, ctp = F.col("n"), F.col("_ctp")

    def at(x: Column) -> Column:
        pos = x * total / points
        step = F.floor(pos).cast("long")
        later = F.filter("_near", lambda e: e["x"] >= x)
        # the next hit: its place, and the envelope from there on
        following, place = F.array_max(F.transform(later, lambda e: e["p"])), F.array_min(F.transform(later, lambda e: e["f"]))
        # before the first detection the precision is one, past the last it falls to zero at recall one
        p0 = F.when((step == 0) & (place == 1), 1.0).otherwise(F.greatest(F.try_divide(step, place - 1), following))
        end, left = ctp / F.col("_all"), F.nullif(total - ctp, F.lit(0))
        tail = F.coalesce(end * (1 - (pos - ctp) / left), F.lit(0.0))
        value = F.when(step >= ctp, tail).otherwise(p0 + (following - p0) * (pos - step))
        return value * F.when(x.isin(0, points), 0.5).otherwise(1.0)

    total_area = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(points)), at), F.lit(0.0), lambda s, v: s + v)
    level = F.get(F.array(*[F.lit(float(v)) for v in levels]), F.col("level"))
    return curve.select("cls", level.alias("level"), (total_area / points).alias("ap"))


def detection_summary(ap: DataFrame) -> DataFrame:
    """mAP50 and mAP50-95 per class."""
    return ap.groupBy("cls").agg(
        F.max(F.when(F.col("level") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map5095")
    )


def precision_recall(judged: DataFrame, truths: DataFrame, conf: float, level: float = 0.5) -> DataFrame:
    """Precision and recall per class at one confidence."""
    hit = F.array_contains("hits", F.lit(level))
    n = truths.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    c = judged.filter(F.col("conf") >= conf).groupBy("cls").agg(
        F.count(F.when(hit, 1)).alias("tp"), F.count(F.lit(1)).alias("found")
    )
    return n.join(c, "cls", "left").na.fill(0, ["tp", "found"]).select(
        "cls",
        F.coalesce(F.try_divide("tp", "found"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)).alias("recall"),
    )


def image_presence(boxes: DataFrame, image: str = "image", small: float = 0.01) -> DataFrame:
    """Per image: which classes it shows and whether it is a small-fire image."""
    fire = F.col("cls") == 0
    return boxes.groupBy(image).agg(
        F.coalesce(F.bool_or(fire), F.lit(False)).alias("with_fire"),
        F.coalesce(F.bool_or(F.col("cls") == 1), F.lit(False)).alias("with_smoke"),
        (F.count("cls") == 0).alias("negative"),
        F.coalesce(F.min(F.when(fire, F.col("w") * F.col("h"))) <= small, F.lit(False)).alias("small_fire"),
    )
