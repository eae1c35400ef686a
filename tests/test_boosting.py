"""Boosted trees against a plain booster with the same bins, and folds against single fits."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwarden.operators import boosting as B, classifier, rules, sweep


def plain_booster(x, y, s):
    """Every candidate cut of every leaf is summed anew; the best leaf is cut first."""
    n, features = x.shape
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    edges = [B.bin_edges(x[:, f]) for f in range(features)]
    raw = np.zeros(n)
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)

        def best(rows):
            found = (0.0, None, None)
            for f in range(features):
                for e in edges[f]:
                    left = x[rows, f] <= e
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < s.least_rows or min(h[a].sum(), h[b].sum()) < B.LEAST_HESSIAN:
                        continue
                    gain = sum(g[r].sum() ** 2 / h[r].sum() for r in (a, b)) - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > found[0] + 1e-9:
                        found = (gain, f, e)
            return found

        leaves = [(np.arange(n), best(np.arange(n)))]
        while len(leaves) < s.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
            rows, (gain, f, e) = leaves[k]
            if f is None:
                break
            left = x[rows, f] <= e
            leaves[k : k + 1] = [(r, best(r)) for r in (rows[left], rows[~left])]
        for rows, _ in leaves:
            raw[rows] -= s.rate * g[rows].sum() / h[rows].sum()
    return raw


def samples(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n) ** 2])
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) * 0.7 > 1.5).astype(float)
    return x, y


def test_equals_a_plain_booster():
    x, y = samples(160)
    s = B.Settings(rounds=8, rate=0.1, leaves=6, least_rows=9)
    model = B.fit(x, y, s)
    assert np.allclose(B.log_odds(model, x), plain_booster(x, y, s), atol=1e-9)
    assert max(len(t) for t in model["trees"]) == 2 * s.leaves - 1
    back = json.loads(json.dumps(model))
    assert (B.log_odds(back, x) == B.log_odds(model, x)).all()


def test_learns_and_separates_held_out_rows():
    x, y = samples(3000, 1)
    model = B.fit(x[:2000], y[:2000], B.Settings(rounds=60))
    assert ((B.log_odds(model, x[2000:]) > 0) == y[2000:]).mean() > 0.8


@pytest.mark.parametrize("y, base", [([], -20.0), ([0.0, 0.0], -20.0), ([1.0, 1.0], 20.0)])
def test_one_class_is_a_constant(y, base):
    model = B.fit(np.zeros((len(y), 2)), np.array(y))
    assert model == {"base": base, "trees": []}


def test_many_distinct_values_share_bins():
    edges = B.bin_edges(np.arange(10_000.0))
    assert len(edges) == B.BINS - 1 and (np.diff(edges) > 0).all()


def test_folds_do_not_see_their_own_clips(spark):
    rng = np.random.default_rng(5)
    rows = [(c, i * 0.5, float(rng.random()), float(rng.random())) for c in range(14) for i in range(60)]
    signal = rules.index_samples(spark.createDataFrame(rows, "clip long, t double, fire double, smoke double"))
    truth = spark.createDataFrame([(c, 22.0 if c % 3 else None) for c in range(14)], "clip long, start_s double")
    s = B.Settings(rounds=5, least_rows=5)
    got = {(r.clip, r.idx): r for r in classifier.out_of_fold(signal, truth, settings=s).collect()}
    assert len(got) == len(rows)
    data = classifier.onset_dataset(signal, truth).withColumn("fold", sweep.fold_of(F.col("clip"), 5)).toPandas()
    for fold in range(5):
        x, y = (data.loc[data.fold != fold, c].to_numpy(float) for c in (classifier.FEATURES, "label"))
        order = np.lexsort([*x.T, y])
        model = B.fit(x[order], y[order], s)
        own = data[data.fold == fold]
        want = 1 / (1 + np.exp(-B.log_odds(model, own[classifier.FEATURES].to_numpy(float))))
        assert np.allclose([got[c, i].p for c, i in zip(own["clip"], own["idx"])], want, atol=1e-9)
        assert [got[c, i].label for c, i in zip(own["clip"], own["idx"])] == own.label.tolist()
