"""Exact top-k by inner product with MaxScore.

Dimensions are terms, vectors are documents, and a shard holds the postings of
some thousand vectors.  For a query the largest possible contribution of each
dimension in the shard bounds its part of the score.  The dimensions whose
bounds together stay below the k-th best score so far are non-essential: a
vector is only worth a look for the others.  Essential postings are added up
first; the remaining ones are probed, largest bound first, only for vectors
whose score so far plus the remaining bounds still competes.  Shards hand on
their k best, and the k best of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD = 4096
QUERIES_AT_ONCE = 512
K = 5
_STEP = 8  # dimensions probed before competitors are counted again


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null for a null vector or one with null, NaN or infinite components."""
    fine = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))
    )
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale))))


def matrix(rows) -> np.ndarray:
    """Rows of any length as one matrix; missing components are zero."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Shard:
    """Postings by dimension, with the largest and smallest value of each."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(values[order].T)  # one row per dimension
        self.most = self.postings.max(axis=1) if len(ids) else np.zeros(len(self.postings), np.int64)
        self.least = self.postings.min(axis=1) if len(ids) else np.zeros(len(self.postings), np.int64)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, the query's own row left out."""
        n, dims = len(self.ids), min(len(query), len(self.postings))
        q = query[:dims]
        bound = np.maximum(np.maximum(q * self.most[:dims], q * self.least[:dims]), 0)
        order = np.argsort(-bound, kind="stable")
        left = np.r_[np.cumsum(bound[order][::-1])[::-1], 0]  # what the dimensions from here on can add
        alive = np.flatnonzero(self.ids != query_id)
        # a first threshold: the k best of a few vectors, scored in full
        few = alive[: max(64, k)]
        full = q @ self.postings[:dims][:, few] if len(few) else np.empty(0, np.int64)
        need = np.partition(full, len(full) - k)[len(full) - k] if len(full) >= k else None
        essential = dims if need is None else int(np.searchsorted(-left[:-1], -need, side="right"))
        # vectors are dense: each has a posting in every dimension, so the essential ones name all as candidates
        score = q[order[:essential]] @ self.postings[order[:essential]][:, alive] if essential else np.zeros(len(alive), np.int64)
        done = essential
        while done < dims and len(alive):
            if need is not None:
                stay = score + left[done] >= need
                alive, score = alive[stay], score[stay]
            some = order[done : done + _STEP]
            score = score + q[some] @ self.postings[np.ix_(some, alive)]
            done += _STEP
        if len(alive) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            stay = score >= cut
            alive, score = alive[stay], score[stay]
        first = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][first], score[first]


def _search(k: int):
    def run(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            shard = Shard(vectors["vec_id"].to_numpy(np.int64), matrix(vectors["v"].values))
            for query_id, query in zip(queries["vec_id"].to_numpy(np.int64), queries["v"].values):
                ids, scores = shard.best(query_id, np.asarray(query, np.int64), k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    shard: int = SHARD,
    queries_at_once: int = QUERIES_AT_ONCE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest inner product, ties to smaller ids.

    A row's own id is no candidate for it.  Rows with a null id, a null vector,
    or a component that is null or not finite take no part.  Every other row is
    a candidate, also several with one id, which may fill several ranks; as a
    query, of several rows with one id the first by vector counts.  A shorter
    vector is filled up with zeros.  Query blocks meet vector shards; both are
    bounded in rows.
    """
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("v"), is_query.alias("_q"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    )
    asked = rows.filter("_q").groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // queries_at_once))
    spread = F.xxhash64("vec_id", "v")
    left = rows.select(
        "vec_id", "v", F.pmod(spread, F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    right = asked.select(
        "vec_id", "v", F.pmod(F.shiftright(spread, 24), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    found = (
        left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
        .applyInPandas(_search(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
