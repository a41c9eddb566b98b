"""Deep forests against trees grown node by node in plain Python, and against Spark's learner."""

import random

import numpy as np
import pytest

from sourcetrust.operators import deep_forests as deep, models

ROWS = "label double, x array<double>"


def rows(n=700, width=5, seed=3):
    rnd, out = random.Random(seed), []
    for i in range(n):
        x = [rnd.gauss(0, 1) if f % 2 else float(rnd.randint(0, 6)) for f in range(width)]
        out.append((float(x[1] + 0.4 * x[2] + rnd.gauss(0, 0.8) > 1), x))
    return out + out[:n // 10]


def twin(codes, y, weight, tree, spec, heap=1):
    """(heap, feature, bin, n, ones) of a node and all below it, by recursion."""
    n, ones = int(weight.sum()), int((weight * y).sum())
    best = None
    if heap < 2**spec.depth and 0 < ones < n and n >= 2 * spec.min_leaf:
        worth = lambda keep: 2 * (weight * y)[keep].sum() * (weight * (1 - y))[keep].sum() / max(1, weight[keep].sum())
        for f in spec.features(tree, np.array([heap]))[0]:
            for b in range(deep.BINS - 1):
                left = codes[:, f] <= b
                if min(weight[left].sum(), weight[~left].sum()) >= spec.min_leaf:
                    gain = worth(left | ~left) - worth(left) - worth(~left)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, int(f), b, left)
    if best is None:
        return [(heap, -1, 0, n, ones)]
    _, f, b, left = best
    sides = [twin(codes[side], y[side], weight[side], tree, spec, 2 * heap + i) for i, side in enumerate((left, ~left))]
    return [(heap, f, b, n, ones), *sides[0], *sides[1]]


def leaf_share(nodes, codes):
    """The share of ones in the leaf of each row, where sibling leaves of one class are their parent."""
    known = {h: (f, b, n, ones) for h, f, b, n, ones in nodes}
    for h in sorted(known, reverse=True):
        f, b, n, ones = known[h]
        if f >= 0 and all(known[c][0] < 0 for c in (2 * h, 2 * h + 1)) and len({2 * known[c][3] > known[c][2] for c in (2 * h, 2 * h + 1)}) == 1:
            known[h] = (-1, b, n, ones)
    out = []
    for row in codes:
        h = 1
        while known[h][0] >= 0:
            h = 2 * h + int(row[known[h][0]] > known[h][1])
        out.append(known[h][3] / known[h][2])
    return np.array(out)


@pytest.mark.parametrize("cells", [deep.NODE_CELLS, 1_000, 300])
def test_trees_equal_their_twin_wherever_nodes_are_grown(spark, monkeypatch, cells):
    """From the root in one task, or with large nodes split by counts of all tasks: the trees are those of the recursion."""
    monkeypatch.setattr(deep, "NODE_CELLS", cells)
    monkeypatch.setattr(deep, "TREES_A_SCORE", 2)
    monkeypatch.setattr(deep, "ROWS_A_SCORE", 200)
    data = sorted(rows())
    table = spark.createDataFrame(data, ROWS).coalesce(1)
    spec = deep.Spec(5, 7, 3, 5, 11)
    model = deep.fit_deep_forest(table, len(data), 5, 5, 7, 3, 11)
    codes = np.array([[np.searchsorted(e, v) for e, v in zip(model.edges, x)] for _, x in data])
    y, expected = np.array([int(r[0]) for r in data]), np.zeros(len(data))
    for tree in range(5):
        nodes = twin(codes, y, spec.weights(np.arange(len(data)), tree).astype(int), tree, spec)
        expected += leaf_share(nodes, codes) / 5
    got = {tuple(r.x): (r.y_proba, r.y_pred) for r in model.score(table).collect()}
    assert model.score(table).count() == len(data)
    assert np.allclose([got[tuple(x)][0] for _, x in data], expected, atol=1e-9)
    assert all(pred == int(proba > 0.5) for proba, pred in got.values())
    assert abs(sum(model.feature_importances) - 1) < 1e-9 and int(np.argmax(model.feature_importances)) == 1


def test_many_rows_are_grown_below_their_nodes(spark, monkeypatch):
    """Above `SMALL_FOREST` rows a forest is no longer grown by counts per node and task, and learns as much."""
    data = rows(1_800, 6, 5)
    table = spark.createDataFrame(data, ROWS)
    settings = {"numTrees": 30, "maxDepth": 8, "minInstancesPerNode": 4}
    share = lambda model: models.score_global(model, table).filter("y_pred = label").count() / len(data)
    first = models.fit_global(table.repartition(3), "random_forest", **settings)
    monkeypatch.setattr(models, "SMALL_FOREST", 1_000)
    found = [models.fit_global(table.repartition(n), "random_forest", **settings) for n in (2, 13)]
    assert not isinstance(first, deep.DeepForest) and all(isinstance(m, deep.DeepForest) for m in found)
    assert abs(share(first) - share(found[0])) < 0.02
    ours, theirs = (models.model_parameters(m)["feature_importances"] for m in (found[0], first))
    assert len(ours) == 6 and np.allclose(ours, theirs, atol=0.08)
    scores = [{(r.label, tuple(r.x)): r.y_proba for r in models.score_global(m, table).collect()} for m in found]
    assert scores[0] == scores[1]
    assert not isinstance(models.fit_global(table.limit(1_500), "random_forest", **settings, subsamplingRate=0.5), deep.DeepForest)


def test_draws_are_poisson_and_features_are_distinct():
    spec = deep.Spec(10, 5, 4, 64, 42)
    weight = np.concatenate([spec.weights(np.arange(20_000), tree) for tree in range(10)])
    assert abs(weight.mean() - 1) < 0.01 and abs((weight == 0).mean() - np.exp(-1)) < 0.005 and abs(weight.var() - 1) < 0.02
    tried = spec.features(3, np.arange(1, 5_001))
    assert tried.shape == (5_000, 8) and all(len(set(t)) == 8 for t in tried)
    assert np.allclose(np.bincount(tried.ravel(), minlength=64) / 5_000, 8 / 64, atol=0.03)


@pytest.mark.parametrize("bad", [None, [1.0, float("nan")], [1.0]])
def test_features_must_be_whole(spark, bad):
    table = spark.createDataFrame([(0.0, [1.0, 2.0]), (1.0, [2.0, 0.0]), (1.0, bad)], ROWS).coalesce(1)
    with pytest.raises(Exception, match="features must|reshape"):
        deep.fit_deep_forest(table, 3, 2, 2, 3, 1, 1)
