"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .text import remove, shared_folder, stored_at


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each node's neighbours (large star: the larger ones) to the least node around it."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        # neighbours not above the node
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = around.join(least, "u")
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): label is the least node of the component; nodes without an edge are not listed.

    Each round writes its edges to the shared folder and removes those of the
    round before; rounds end when the edges stay the same, after about log of
    the longest path.
    """
    spark, turn = edges.sparkSession, 0
    folder = shared_folder(spark)
    first = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, state = stored_at(first, f"{folder}/{turn}"), None
    while True:
        after = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state or not after[0]:
            break
        state, turn = after, turn + 1
        e = stored_at(_star(_star(e, True), False), f"{folder}/{turn}")
        remove(spark, f"{folder}/{turn - 1}")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
