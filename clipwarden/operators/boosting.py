"""Gradient-boosted trees on binned features, one fit per fold.

Each fold is fitted in a task of its own on a bounded sample of its training
rows; scoring runs over all rows.  Bins, histograms and best-first growth follow
the usual histogram method: a node's histogram of gradients is summed once, its
sibling's is the rest of the parent's.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BINS = 255
LEAST_HESSIAN = 1e-3


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    rate: float = 0.08
    leaves: int = 31
    least_rows: int = 50


def bin_edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper edges of the bins of a feature: between distinct values while they are few, else at quantiles."""
    distinct = np.unique(x)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="midpoint"))


def _best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least_rows: int) -> tuple[float, int, int]:
    """Gain, feature and bin of the best cut of a node with these histograms (feature, bin)."""
    gl, hl, nl = (np.cumsum(a, axis=1)[:, :-1] for a in (g, h, n))
    gt, ht, nt = g[0].sum(), h[0].sum(), n[0].sum()
    gr, hr, nr = gt - gl, ht - hl, nt - nl
    allowed = (nl >= least_rows) & (nr >= least_rows) & (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, gl * gl / hl + gr * gr / hr - gt * gt / ht, -np.inf)
    at = int(np.argmax(gain))
    feature, cut = divmod(at, gain.shape[1])
    return float(gain[feature, cut]), feature, cut


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> dict:
    """A model of the log odds of ``y``; both classes weigh the same.

    ``x`` has one row per sample.  With one class only, or no rows, the model is
    a constant.
    """
    n, features = x.shape
    positive = int(y.sum())
    if positive in (0, n):
        return {"base": 20.0 if n and positive else -20.0, "trees": []}
    edges = [bin_edges(x[:, f]) for f in range(features)]
    columns = [np.searchsorted(e, x[:, f], "left").astype(np.int64) for f, e in enumerate(edges)]
    weight = np.where(y == 1, n / (2 * positive), n / (2 * (n - positive)))
    raw, trees = np.zeros(n), []  # balanced classes start at even odds

    def histograms(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.empty((3, features, BINS))
        gr, hr = g[rows], h[rows]
        for f, column in enumerate(columns):
            at = column[rows]
            out[0, f] = np.bincount(at, gr, BINS)
            out[1, f] = np.bincount(at, hr, BINS)
            out[2, f] = np.bincount(at, minlength=BINS)
        return out

    for _ in range(settings.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        nodes: list[list] = []  # feature, edge, left, right, value
        waiting: list[tuple] = []

        def add(rows: np.ndarray, sums: np.ndarray) -> int:
            value = -settings.rate * sums[0, 0].sum() / max(sums[1, 0].sum(), 1e-12)
            nodes.append([-1, 0.0, -1, -1, value])
            gain, feature, cut = _best_split(*sums, settings.least_rows)
            if gain > 0:
                heapq.heappush(waiting, (-gain, len(nodes) - 1, feature, cut, rows, sums))
            else:
                raw[rows] += value
            return len(nodes) - 1

        add(np.arange(n), histograms(np.arange(n), g, h))
        leaves = 1
        while waiting and leaves < settings.leaves:
            _, at, feature, cut, rows, sums = heapq.heappop(waiting)
            left = columns[feature][rows] <= cut
            parts = rows[left], rows[~left]
            small = 0 if len(parts[0]) <= len(parts[1]) else 1
            own = histograms(parts[small], g, h)
            both = (own, sums - own) if small == 0 else (sums - own, own)
            nodes[at][:2] = feature, float(edges[feature][cut])
            nodes[at][2], nodes[at][3] = add(parts[0], both[0]), add(parts[1], both[1])
            leaves += 1
        for _, at, _, _, rows, _ in waiting:
            raw[rows] += nodes[at][4]
        trees.append(nodes)
    return {"base": 0.0, "trees": trees}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    raw = np.full(len(x), model["base"])
    for tree in model["trees"]:
        feature, edge, left, right, value = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            k = at[inner]
            at[inner] = np.where(x[inner, feature[k]] <= edge[k], left[k], right[k])
            inner = inner[feature[at[inner]] >= 0]
        raw += value[at]
    return raw


def fit_folds(
    rows: DataFrame, features: Sequence[str], label: str, folds: int, fold: str = "fold", order: Column | None = None,
    limit: int = 200_000, settings: Settings = Settings(),
) -> DataFrame:
    """(fold, model): for each fold a model of the rows of the other folds.

    Up to ``limit`` rows all take part; of more, a share of about ``limit`` is
    chosen by the hash of ``order``, the same in every run.
    """
    keep = F.lit(1.0) if order is None else F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = rows.agg(F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(F.count(F.lit(1)), F.lit(1)))).scalar()
    chosen = rows.filter(keep < share) if order is not None else rows
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold))
    dealt = chosen.select(F.explode(others).alias("fold"), F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])

    def one(table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(f).to_numpy() for f in features])
        y = table.column("_y").to_numpy()
        order = np.lexsort([*x.T, y])  # the same sums whatever way the rows came
        model = fit(x[order], y[order], settings)
        return pa.table({"fold": table.column("fold").slice(0, 1), "model": pa.array([json.dumps(model)])})

    return dealt.groupBy("fold").applyInArrow(one, "fold int, model string")


def score_folds(rows: DataFrame, models: dict[int, dict], features: Sequence[str], fold: str = "fold", out: str = "p") -> DataFrame:
    """Adds to every row the probability by the model of its fold, which has not seen it."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(f).cast(pa.float64())) for f in features]) if batch.num_rows else np.empty((0, len(features)))
            own, p = np.asarray(batch.column(fold)), np.zeros(batch.num_rows)
            for k in np.unique(own).tolist():
                p[own == k] = 1 / (1 + np.exp(-log_odds(sent.value[k], x[own == k])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{out}` double")
