"""Skew-safe building blocks for ordered work inside a clip.

A plain ``Window.partitionBy("clip")`` sends a whole clip to one task, which
fails when one clip holds a large share of all rows.  The helpers below cut a
clip into pieces of bounded size that any executor can process on its own:

* ``running_total`` / ``with_position`` number rows in two levels: inside a
  coarse, order-preserving bucket, plus an offset from a small bucket table.
* ``chunked`` copies the rows near a piece border into the neighbouring piece,
  so that a frame of known reach never has to leave its piece.
* ``carry`` and ``next_value`` look arbitrarily far back or ahead through the
  bucket table, with one row per bucket instead of one row per sample.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint

ACCURACY = 10_000  # of the approximate quantiles that bracket an order statistic
WHOLE = 50_000  # values up to which a group is its own bracket
FEW = 50_000  # groups whose brackets all tasks get
BUCKET_ROWS = 250_000  # of an even bucket, about
PIECE = 4096  # samples in a piece: about 34 minutes at two samples a second


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def time_bucket(t: str | Column, seconds: float = 1800.0) -> Column:
    """Order-preserving bucket of a clip time, bounded by the sample rate."""
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(float(seconds))).cast("long")


def hash_rank_key(*cols: str | Column, seed: int = 0) -> Column:
    """A reproducible pseudo-random order key (replaces an in-memory shuffle)."""
    parts = [c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_bucket(key: str | Column, hex_digits: int = 3) -> Column:
    """Leading digits of a ``hash_rank_key``: uniform and order-preserving."""
    return F.substring(key if isinstance(key, Column) else F.col(key), 1, hex_digits)


def in_even_buckets(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds a bucket number that never decreases along ``order``, with about as many rows in each bucket.

    The number of buckets is stated and grows with the rows: left to adaptive
    execution, they would be merged by their bytes.  Counting, sampling and
    dealing each read ``df``; put ``session.checkpoint`` before it when it is the
    result of heavy work.  Store the result before it is used twice, as another
    run may draw other borders.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    return df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id().cast("long"))


def running_many(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: dict[str, Column],
    bucket: Column,
    combine=F.sum,
    ahead: bool = False,
    inclusive: bool = False,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Adds ``combine`` of each value over the earlier (later) rows of the group.

    ``bucket`` must never decrease along ``order``.  The big side is shuffled
    once, on (keys, bucket); what comes from other buckets is read from a table
    with one row per bucket.  ``combine`` is ``sum``, ``max`` or ``min``.
    ``totals`` maps an output to the column for the value of the whole group,
    which the bucket table gives for free.

    The bucket table reads the input a second time, with a few columns.  That
    is cheap on a scan; put ``session.checkpoint`` before it when the input is
    itself the result of heavy work.
    """
    ranked = [c.desc() if ahead else c.asc() for c in _cols(order)]
    border = F.col("_ord_bucket").desc() if ahead else F.col("_ord_bucket").asc()
    names = {f"_ord_value{i}": out for i, out in enumerate(values)}
    totals = totals or {}
    tagged = df.withColumns({"_ord_bucket": bucket, **{n: values[out] for n, out in names.items()}})
    inside = (
        Window.partitionBy(*keys, "_ord_bucket")
        .orderBy(*ranked)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    before = Window.partitionBy(*keys).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        tagged.groupBy(*keys, "_ord_bucket")
        .agg(*[combine(n).alias(n) for n in names])
        .select(
            *keys, "_ord_bucket",
            *[combine(n).over(before).alias(f"{n}_before") for n in names],
            *[combine(n).over(Window.partitionBy(*keys)).alias(totals[o]) for n, o in names.items() if o in totals],
        )
    )

    def total(n: str) -> Column:
        outer, inner = F.col(f"{n}_before"), F.col(f"{n}_inside")
        if combine is F.sum:
            return F.coalesce(outer, F.lit(0)) + F.coalesce(inner, F.lit(0))
        return F.greatest(outer, inner) if combine is F.max else F.least(outer, inner)

    scratch = ["_ord_bucket", *names, *[f"{n}_inside" for n in names], *[f"{n}_before" for n in names]]
    return (
        tagged.withColumns({f"{n}_inside": combine(n).over(inside) for n in names})
        .join(edges, [*keys, "_ord_bucket"])
        .withColumns({out: total(n) for n, out in names.items()})
        .drop(*scratch)
    )


def running(df, keys, order, value, bucket, out, combine=F.sum, ahead=False, inclusive=False) -> DataFrame:
    """``running_many`` for one value."""
    return running_many(df, keys, order, {out: value}, bucket, combine, ahead, inclusive)


def running_total(df, keys, order, value, bucket, out) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group."""
    return running(df, keys, order, value, bucket, out)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    out: str = "idx",
    size: str | None = None,
) -> DataFrame:
    """Adds the dense zero-based position of each row inside its group, and the group's size on request."""
    one = F.lit(1).cast("long")
    return running_many(df, keys, order, {out: one}, bucket, totals={out: size} if size else None)


def positions_among(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sets: dict[str, Column],
    bucket: Column,
    reach: int,
    about: DataFrame | None = None,
) -> DataFrame:
    """``with_position`` among the rows of each of several sets at once, null outside of the set.

    A row travels once, with the columns of ``df`` alone, whatever the number of
    sets; ``about`` (one row per group) comes along through the bucket table.
    ``_piece`` is the bucket, and the rows of a piece are in one task in order.
    ``_many`` tells whether the group has more pieces than one; there ``_rim``
    marks the rows within ``reach`` of an end of their piece in one of the sets.
    """
    tagged = df.withColumn("_piece", bucket)
    names = {f"_in{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(sets.values())}
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    edges = tagged.groupBy(*keys, "_piece").agg(*[F.count_if(c).alias(f"{n}_size") for n, c in names.items()]).select(
        "*", (F.count(F.lit(1)).over(whole) > 1).alias("_many"),
        *[F.coalesce(F.sum(f"{n}_size").over(before), F.lit(0)).alias(f"{n}_before") for n in names],
    )
    if about is not None:
        edges = edges.join(about, list(keys), "left")
    inside = Window.partitionBy(*keys, "_piece").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, -1)
    # the windows come last: they hold the rows of a piece together, also when a skewed join was split
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = tagged.repartition(n, *keys, "_piece").join(edges, [*keys, "_piece"]).withColumns(
        {f"{n}_inside": F.count_if(c).over(inside) for n, c in names.items()}
    )
    near = [c & ((F.col(f"{n}_inside") < reach) | (F.col(f"{n}_size") - F.col(f"{n}_inside") <= reach)) for n, c in names.items()]
    found = {out: F.when(c, F.col(f"{n}_before") + F.col(f"{n}_inside")) for out, (n, c) in zip(sets, names.items())}
    scratch = [f"{n}_{part}" for n in names for part in ("size", "before", "inside")]
    return placed.withColumns({**found, "_rim": F.col("_many") & reduce(or_, near)}).drop(*scratch)


def chunked(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "idx",
    back: int = 0,
    ahead: int = 0,
    size: int | None = None,
    expands: bool = False,
) -> DataFrame:
    """Cuts each group into pieces of ``size`` positions with a border copy.

    Returns the rows with ``_piece`` (the piece that processes the row) and
    ``_own`` (false for border copies, which serve as context only), already
    distributed by (keys, _piece) so that later windows need no shuffle.
    ``expands`` keeps all shuffle partitions: adaptive coalescing judges by the
    bytes before the rows are multiplied and would leave too few tasks.
    """
    size = max(size or PIECE, back + ahead + 1)
    piece = F.floor(F.col(pos) / F.lit(size)).cast("long")
    offset = F.pmod(F.col(pos), F.lit(size))
    targets = [piece]
    if back:
        targets.append(F.when(offset >= size - back, piece + 1))
    if ahead:
        targets.append(F.when(offset < ahead, piece - 1))
    cut = df.withColumn("_piece", F.explode(F.array_compact(F.array(*targets)))).withColumn(
        "_own", F.col("_piece") == piece
    )
    if expands:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cut.repartition(n, *keys, "_piece")
    return cut.repartition(*keys, "_piece")


def piece_window(keys: Sequence[str], *order: str | Column, extra: Sequence[str] = ()):
    """The window that belongs to ``chunked``."""
    return Window.partitionBy(*keys, "_piece", *extra).orderBy(*_cols(order))


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    value: Column,
    out: str,
    *,
    ahead: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Adds the nearest non-null ``value`` at or before (after) each row."""
    ranked = [c.desc() for c in _cols(order)] if ahead else [c.asc() for c in _cols(order)]
    tagged = df.withColumn("_ord_bucket", bucket).withColumn("_ord_value", value)
    inside = (
        Window.partitionBy(*keys, "_ord_bucket")
        .orderBy(*ranked)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    step = F.struct(*_cols(order))
    pick = F.min_by if ahead else F.max_by
    # one row per bucket: the value nearest to the next bucket
    edge = tagged.groupBy(*keys, "_ord_bucket").agg(
        pick("_ord_value", F.when(F.col("_ord_value").isNotNull(), step)).alias("_ord_edge")
    )
    border = F.col("_ord_bucket").desc() if ahead else F.col("_ord_bucket").asc()
    before = Window.partitionBy(*keys).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        *keys, "_ord_bucket", F.last("_ord_edge", ignorenulls=True).over(before).alias("_ord_edge")
    )
    return (
        tagged.withColumn("_ord_near", F.last("_ord_value", ignorenulls=True).over(inside))
        .join(edge, [*keys, "_ord_bucket"])
        .withColumn(out, F.coalesce("_ord_near", "_ord_edge"))
        .drop("_ord_bucket", "_ord_value", "_ord_near", "_ord_edge")
    )


def carry_both(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    value: Column,
    last: str,
    following: str,
) -> DataFrame:
    """Nearest non-null values at or before and at or after each row, in one pass."""
    tagged = df.withColumn("_ord_bucket", bucket).withColumn("_ord_value", value)
    cols = _cols(order)
    inside = Window.partitionBy(*keys, "_ord_bucket")
    up = inside.orderBy(*[c.asc() for c in cols]).rowsBetween(Window.unboundedPreceding, 0)
    down = inside.orderBy(*[c.desc() for c in cols]).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("_ord_value").isNotNull(), F.struct(*cols))
    edge = tagged.groupBy(*keys, "_ord_bucket").agg(
        F.max_by("_ord_value", step).alias("_ord_high"), F.min_by("_ord_value", step).alias("_ord_low")
    )
    across = Window.partitionBy(*keys)
    before = across.orderBy(F.asc("_ord_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    after = across.orderBy(F.desc("_ord_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        *keys, "_ord_bucket",
        F.last("_ord_high", ignorenulls=True).over(before).alias("_ord_before"),
        F.last("_ord_low", ignorenulls=True).over(after).alias("_ord_after"),
    )
    return (
        tagged.withColumn("_ord_up", F.last("_ord_value", ignorenulls=True).over(up))
        .withColumn("_ord_down", F.last("_ord_value", ignorenulls=True).over(down))
        .join(edge, [*keys, "_ord_bucket"])
        .withColumn(last, F.coalesce("_ord_up", "_ord_before"))
        .withColumn(following, F.coalesce("_ord_down", "_ord_after"))
        .drop("_ord_bucket", "_ord_value", "_ord_up", "_ord_down", "_ord_before", "_ord_after")
    )


def next_value(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, out: str
) -> DataFrame:
    """Adds the next larger value of ``order`` in the group (``lead``)."""
    return carry(df, keys, [order], bucket, F.col(order), out, ahead=True, inclusive=False)


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.5, out: str = "quantile") -> DataFrame:
    """Exact quantile of a group, interpolated between neighbours: (keys, out).

    A first pass brackets the wanted rank by approximate quantiles, a second one
    counts what lies below the bracket and each value inside it.  The bracket
    holds a thousandth of a group's ranks or ``WHOLE`` values, so few rows leave
    the tasks and none are sorted, however many a group has and however they are
    spread.  Nulls and NaN do not count, infinite values count as the largest
    finite ones; a group without values gets none.
    """
    # one struct as key: groups whose keys hold nulls join like others
    rows = df.select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    rows = rows.withColumn("_x", F.greatest(F.least("_x", F.lit(sys.float_info.max)), F.lit(-sys.float_info.max)))
    # a quantile is off by a rank in ACCURACY at most: a bracket this much wider on both sides is safe beyond WHOLE values
    around = [max(share - 3 / ACCURACY, 0.0), min(share + 3 / ACCURACY, 1.0)]
    first = rows.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), F.percentile_approx("_x", around, ACCURACY).alias("_q")
    )
    at = (F.col("_n") - 1) * F.lit(share)
    bound = lambda end, i, side: F.when((F.col("_n") <= WHOLE) | F.lit(side), F.col(end)).otherwise(F.get("_q", F.lit(i)))
    state = checkpoint(first.select(
        "_key", (at - F.floor(at)).alias("_part"), F.floor(at).alias("_rank0"), F.ceil(at).alias("_rank1"),
        bound("_least", 0, around[0] == 0.0).alias("_low"), bound("_most", 1, around[1] == 1.0).alias("_high"),
    ))
    bracket = state.select("_key", "_low", "_high")
    if state.count() <= FEW:
        bracket = F.broadcast(bracket)
    # what lies below counts as null, which comes first
    counted = (
        rows.join(bracket, "_key").filter(F.col("_x") <= F.col("_high"))
        .groupBy("_key", F.when(F.col("_x") >= F.col("_low"), F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = F.sum("_c").over(Window.partitionBy("_key").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto).join(state.select("_key", "_part", "_rank0", "_rank1"), "_key")
    ends = placed.groupBy("_key").agg(
        *[F.min(F.when(F.col("_upto") > F.col(f"_rank{k}"), F.col("_v"))).alias(f"_v{k}") for k in (0, 1)], F.max("_part").alias("_part")
    )
    return ends.select("_key.*", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_part")).alias(out))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The ``k`` first rows of each group, ``rank`` counted from one.

    The filter on ``row_number`` makes Spark keep at most ``k`` rows per group
    and map task before the shuffle, so a hot group does not hurt for small k.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
