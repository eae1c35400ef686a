"""Mixing sources to target weights over a time-varying curriculum.

Each source has a schedule of weights over training time 0 to 1, a polyline.
Its integral up to a time says which share of the source's demand is due by
then.  A source's documents stand in a seeded random order, copy after copy;
the words before a copy are its cumulative demand, and inverting the integral
gives the time at which the copy is due.  Sorting by time makes the mix.

A source may hold a third of all rows, so running sums go over buckets of the
random order and then over the bucket table, never over a source in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clipwarden.operators.ordered import running_many

from .text import LAST_ID, blank_words, plain_id, row_key, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SLOPE = 0.5
BUCKET_ROWS = 2_000


@dataclass(frozen=True)
class Schedule:
    """Weight knots (time, weight): times rise from 0 to 1, weights are not negative."""

    knots: tuple[tuple[float, float], ...]

    @property
    def total(self) -> float:
        return sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(self.knots, self.knots[1:]))


def tilted(weight: float, number: int, slope: float = SLOPE) -> Schedule:
    """A weight that falls, or for odd numbers rises, around ``weight``, which is its integral."""
    tilt = slope if number % 2 == 0 else -slope
    return Schedule(((0.0, weight * (1 + tilt)), (1.0, weight * (1 - tilt))))


def targets(sizes: list[tuple[float, float]], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words each source gives; ``sizes`` are (size, weight).

    ``share`` times all sizes is dealt out by weight; what is above ``most``
    times a source's size is dealt out again among the others until none is.
    """
    out = [0.0] * len(sizes)
    open_ = [i for i, (s, w) in enumerate(sizes) if s > 0 and w > 0]
    rest = share * sum(s for s, _ in sizes)
    while open_ and rest > 0:
        weight = sum(sizes[i][1] for i in open_)
        full = [i for i in open_ if rest * sizes[i][1] / weight > most * sizes[i][0]]
        if not full:
            for i in open_:
                out[i] = rest * sizes[i][1] / weight
            break
        for i in full:
            out[i] = most * sizes[i][0]
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def plan(spark: SparkSession, measured: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, schedules=None) -> DataFrame:
    """(source, source_size, target, knots) with one row per source.

    Sources by code point, null last, take ``weights`` in turn.  The list of
    sources is read to the driver; it is the mix's own table of settings.
    """
    rows = measured.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(((r["source"], int(r["n"] or 0)) for r in rows), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    wants = [schedules(name, i) if schedules else tilted(weights[i % len(weights)], i) for i, (name, _) in enumerate(rows)]
    goal = targets([(n, w.total) for (_, n), w in zip(rows, wants)], share, most)
    return spark.createDataFrame(
        [(name, n, float(t), [list(map(float, k)) for k in w.knots]) for (name, n), t, w in zip(rows, goal, wants)],
        "source string, source_size long, target double, knots array<array<double>>",
    )


def due_time(share: Column, knots: Column) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of its total."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.get(F.get(knots, i - 1), F.lit(0)).alias("t"), F.get(F.get(knots, i - 1), F.lit(1)).alias("w"),
            (F.get(F.get(knots, i), F.lit(0)) - F.get(F.get(knots, i - 1), F.lit(0))).alias("d"),
            F.get(F.get(knots, i), F.lit(1)).alias("v"),
        ),
    )
    area = lambda p: p["d"] * (p["w"] + p["v"]) / 2
    total = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + area(p))

    def step(a, p):
        # inside a piece the integral is w x + (v - w) x^2 / (2 d); solved without cancellation
        need = a["need"]
        slope = F.when(p["d"] > 0, (p["v"] - p["w"]) / p["d"]).otherwise(0.0)
        root = F.sqrt(F.greatest(p["w"] * p["w"] + 2 * slope * need, F.lit(0.0)))
        x = F.when(need <= 0, F.lit(0.0)).otherwise(F.try_divide(2 * need, p["w"] + root))
        inside = (~a["found"]) & (need <= area(p))
        return F.struct(
            F.when(a["found"], need).otherwise(need - area(p)).alias("need"),
            F.when(inside, p["t"] + F.least(F.coalesce(x, F.lit(0.0)), p["d"])).otherwise(a["at"]).alias("at"),
            (a["found"] | inside).alias("found"),
        )

    start = F.struct((share * total).alias("need"), F.lit(1.0).alias("at"), F.lit(False).alias("found"))
    return F.aggregate(pieces, start, step, lambda a: a["at"])


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    schedules=None,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per document: doc_id, rk, size, source, source_size, target, copies, taken, positions.

    ``positions`` has the training time (0 to 1) of each copy; ``copies`` is at
    most ``ceil(most)`` and ``taken`` the words of all copies.  A copy is taken
    if its middle lies before the target, so a source misses its target by half
    a document at most.  Null and empty texts have size 0 and are never taken;
    documents without a source are a source of their own; equal rows stand next
    to each other in the order.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    measured = stored(
        docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), row_key(id_col, text_col).alias("rk"),
            source.alias("source"), F.size(blank_words(F.col(text_col))).cast("long").alias("size"),
        )
    )
    goals = plan(spark, measured, weights, share, most, schedules)
    rows = measured.count()
    buckets = 1 << max(0, math.ceil(math.log2(max(1, rows / bucket_rows))))
    # equal rows have equal keys, so the order of the rest does not depend on how Spark reads them
    order = F.xxhash64(F.lit(seed), "id", "rk")
    named = measured.withColumns({
        "_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull(), "_o": order,
    })
    bucket = F.floor((F.col("_o") / F.lit(2.0**64) + 0.5) * buckets)
    walked = running_many(named, ["_s", "_null"], ["_o", "id", "rk"], {"_before": F.col("size")}, bucket)
    known = walked.join(
        goals.withColumns({"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}).drop("source"), ["_s", "_null"]
    )
    taken = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)),
            lambda c: (c * F.col("source_size") + F.col("_before")).cast("double"),
        ),
        lambda start: (F.col("size") > 0) & (start + F.col("size") / 2.0 <= F.col("target")),
    )
    return known.withColumn("_starts", taken).select(
        plain_id().alias("doc_id"), "rk", "size", "source", "source_size", "target",
        F.size("_starts").alias("copies"), (F.size("_starts") * F.col("size")).cast("long").alias("taken"),
        F.transform("_starts", lambda s: due_time(s / F.col("target"), F.col("knots"))).alias("positions"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in training order, a row per copy, with their own columns.

    Rows that agree in id, text and source have equal claims; they are numbered
    and take the lists of positions by number, so that each keeps its columns.
    """
    source_col = options.get("source_col", "source")
    keys = ["_cw_id", "_cw_rk", "_cw_source"]
    found = mix(docs, id_col, text_col, **options).select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("_cw_id"), F.col("rk").alias("_cw_rk"),
        F.struct("source").alias("_cw_source"), F.col("positions").alias("_cw_at"),
    )
    tagged = docs.withColumns({
        "_cw_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), "_cw_rk": row_key(id_col, text_col),
        "_cw_source": F.struct(F.col(source_col).cast("string").alias("source")),
    })
    # maps have no hash; rows that differ in nothing else may take either number
    others = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    by = Window.partitionBy(*keys)
    numbered = found.withColumn("_cw_no", F.row_number().over(by.orderBy("_cw_at"))).filter(F.size("_cw_at") > 0)
    return (
        tagged.withColumn("_cw_no", F.row_number().over(by.orderBy(F.xxhash64(*others)))).join(numbered, [*keys, "_cw_no"])
        .withColumn("_cw_t", F.explode("_cw_at"))
        .repartitionByRange("_cw_t", "_cw_id", "_cw_rk").sortWithinPartitions("_cw_t", "_cw_id", "_cw_rk").select(*docs.columns)
    )
