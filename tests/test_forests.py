"""Trees of all sources grown in Spark against the same trees grown in NumPy, one source at a time."""

import hashlib
import random
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcetrust.operators import forests, models, retraining, trust

EDGES = [[-1.0, 0.0, 1.0], [0.2, 0.4, 0.6, 0.8], [0.5], []]
ROWS = "client_id string, row_id string, x array<double>, label int"


def rows(seed=1, n=900):
    rnd, out = random.Random(seed), []
    for i in range(n):
        source = "hot" if i % 3 else f"s{i % 4}"
        x = [rnd.gauss(0, 1), rnd.random(), float(rnd.random() < 0.5), rnd.random()]
        odds = x[0] + (2 * x[1] if source == "hot" else -x[2]) + rnd.gauss(0, 0.5)
        out.append((source, f"r{i}", x, int(odds > 0.7) if source != "s3" else 1))
    return out


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def twin(source_rows, growth, u, v, width, edges=EDGES):
    """level, node, feature, bin, child, n, gain, u, v of every node, tree by tree."""
    bins = np.array([[bisect_left(edges[f], x[f]) for f in range(width)] for _, _, x, _ in source_rows])
    worth = (lambda a, b: -2.0 * a * (b - a) / b) if growth.kind == "gini" else (lambda a, b: (a / 1e9) ** 2 / (b / 1e9 + growth.shrink) / 2.0)
    found = {}
    for tree in range(growth.trees):
        if growth.bagging:
            draws = [int(digest(growth.seed, r[1], tree)[:8], 16) / 2**32 for r in source_rows]
            weight = np.array([sum(d >= p for p in forests.POISSON) for d in draws])
        else:
            weight = np.ones(len(source_rows), int)
        at = np.where(weight > 0, 0, -1)
        level, nodes = 0, 1
        while nodes and level <= growth.depth:
            splits, children = {}, 0
            for node in range(nodes):
                here = at == node
                w = weight[here]
                su, sv, sn = (u[here] * w).sum(), (v[here] * w).sum(), w.sum()
                best = None
                if level < growth.depth:
                    order = sorted(range(width), key=lambda f: (digest(growth.seed, tree, level, node, f), f))
                    for f in sorted(order[:growth.features or width]):
                        for b in sorted(set(bins[here, f]))[:]:
                            low = bins[here, f] <= b
                            lu, lv, ln = (u[here] * w)[low].sum(), (v[here] * w)[low].sum(), w[low].sum()
                            if ln < growth.min_leaf or sn - ln < growth.min_leaf:
                                continue
                            gain = worth(lu, lv) + worth(su - lu, sv - lv) - worth(su, sv)
                            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                                best = (gain, f, int(b))
                if best:
                    splits[node] = (*best, children)
                    children += 2
                found[tree, level, node] = (best and best[1], best and best[2], best and children - 2, int(sn), best and best[0], su, sv)
            moved = np.full(len(at), -1)
            for node, (_, f, b, child) in splits.items():
                here = at == node
                moved[here] = child + (bins[here, f] > b)
            at, nodes, level = moved, children, level + 1
    return found


@pytest.mark.parametrize("growth", [
    forests.Growth(trees=1, depth=2, bagging=False), forests.Growth(trees=3, depth=4, features=2, min_leaf=5), forests.Growth(trees=2, depth=6, min_leaf=1),
])
def test_forests_equal_their_twin(spark, growth):
    data = rows()
    got = forests.fit_forests(spark.createDataFrame(data, ROWS).repartition(4), growth, EDGES).collect()
    for source in {r[0] for r in data}:
        own = [r for r in data if r[0] == source]
        y = np.array([r[3] for r in own])
        expected = twin(own, growth, y, np.ones(len(own), int), 4)
        mine = {(r.tree, r.level, r.node): r for r in got if r.client_id == source}
        assert set(mine) == set(expected)
        for at, (feature, bin_, child, n, gain, u, v) in expected.items():
            r = mine[at]
            assert (r.feature, r.bin, r.child, r.n) == (feature, bin_, child, n)
            assert abs(r.value - u / v) < 1e-12 and (gain is None or abs(r.gain - gain) < 1e-9)
            assert r.threshold == (None if feature is None else EDGES[feature][bin_])


def test_boosted_trees_equal_their_twin(spark):
    data, growth = rows(2, 400), forests.Growth("newton", 1, 3, 4, None, False)
    table = spark.createDataFrame(data, ROWS).repartition(3)
    trees = forests.fit_boosted(table, 3, 0.3, growth, EDGES)
    got = trees.collect()
    scored = {r.row_id: r.y_proba for r in forests.score_forests(table, trees, boosted=True).collect()}
    for source in {r[0] for r in data}:
        own = [r for r in data if r[0] == source]
        y, margin = np.array([r[3] for r in own], float), np.zeros(len(own))
        bins = np.array([[bisect_left(EDGES[f], r[2][f]) for f in range(4)] for r in own])
        for stage in range(3):
            p = 1 / (1 + np.exp(-margin))
            u, v = np.round((p - y) * 1e9).astype(int), np.round(p * (1 - p) * 1e9).astype(int)
            expected = twin(own, growth, u, v, 4)
            mine = {(0, r.level, r.node): r for r in got if r.client_id == source and r.tree == stage}
            assert {k: (r.feature, r.bin) for k, r in mine.items()} == {k: e[:2] for k, e in expected.items()}
            for i in range(len(own)):
                level, node = 0, 0
                while (r := mine[0, level, node]).feature is not None:
                    level, node = level + 1, r.child + int(bins[i, r.feature] > r.bin)
                margin[i] += r.value
                assert abs(r.value + 0.3 * (expected[0, level, node][5] / 1e9) / (expected[0, level, node][6] / 1e9 + 1.0)) < 1e-9
        assert np.allclose([scored[r[1]] for r in own], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_rows_in_the_same_bins_grow_as_one(spark, monkeypatch):
    """What a level reads is bounded by the bins, not by the rows; the trees are those of single rows."""
    data, growth, seen, grow = rows(8), forests.Growth(trees=3, depth=4, features=2, min_leaf=5), [], forests.grow
    monkeypatch.setattr(forests, "grow", lambda rows, *a: (seen.append(rows.count()), grow(rows, *a))[1])
    data += [(s, None, x, y) for s, _, x, y in data[:30]] + [("hot", "r1", None, 0), ("hot", "r2", [None, float("nan"), 1.0, 0.5], 1)]
    table = spark.createDataFrame(data, ROWS).repartition(4)
    found = [sorted(map(str, forests.fit_forests(table, growth, EDGES).collect()))]
    monkeypatch.setattr(forests, "MAX_BIN_CELLS", 1)
    found.append(sorted(map(str, forests.fit_forests(table, growth, EDGES).collect())))
    assert found[0] == found[1] and seen[1] == len(data)
    assert seen[0] == len({(s, y, *(bisect_left(e, v) for e, v in zip(EDGES, x))) for s, _, x, y in data[:-2]} | {("hot", 0, 0, 0, 0, 0), ("hot", 1, 0, 4, 1, 0)})


def test_poisson_weights_are_those_of_the_uniform_draw(spark):
    weights = forests._weighted(spark.range(3_000).selectExpr("cast(id as string) as key"), forests.Growth(trees=2)).collect()
    draws = [[int(digest(42, i, tree)[:8], 16) / 2**32 for tree in range(2)] for i in range(3_000)]
    assert [list(r) for r in weights] == [[sum(d >= p for p in forests.POISSON) for d in two] for two in draws]


def test_forest_scores_and_importances(spark):
    data = rows(5)
    table = spark.createDataFrame(data, ROWS)
    trees = forests.fit_forests(table, forests.Growth(trees=4, depth=4, min_leaf=5, bagging=False), EDGES)
    scored = forests.score_forests(table, trees).collect()
    assert len(scored) == len(data) and np.mean([r.y_pred == r.label for r in scored]) > 0.85
    assert all(r.y_proba == 1.0 for r in scored if r.client_id == "s3")
    shares = {r.client_id: r.feature_importances for r in forests.importances(trees, 4).collect()}
    assert shares["s3"] == [0.0] * 4 and all(abs(sum(v) - 1) < 1e-9 for k, v in shares.items() if k != "s3")
    assert shares["hot"][0] > shares["hot"][2] and shares["hot"][3] == 0.0
    weighted = spark.createDataFrame([(k, v, 0.0 if k == "s3" else 2.0 if k == "hot" else 1.0) for k, v in shares.items()], "client_id string, feature_importances array<double>, weight double")
    mean = models.average_importances(weighted, "weight").first()[0]
    parts = [(np.array(v), 2.0 if k == "hot" else 1.0) for k, v in shares.items() if k != "s3"]
    assert np.allclose(mean, sum(v * w for v, w in parts) / sum(w for _, w in parts))


def test_bin_edges_and_empty_tables(spark):
    table = spark.createDataFrame(rows(6), ROWS)
    edges = forests.bin_edges(table, 8)
    assert len(edges) == 4 and all(e == sorted(set(e)) and len(e) <= 7 for e in edges)
    ragged = spark.createDataFrame([("a", "1", None, 0), ("a", "2", [1.0], 1), ("a", "3", [2.0, 5.0], 1)], ROWS).coalesce(1)
    assert forests.bin_edges(ragged, 2) == [[1.0], [5.0]] and forests.bin_edges(ragged.limit(0), 2) == []
    assert forests.fit_forests(table.limit(0), forests.Growth(trees=2), EDGES).count() == 0


def test_retrain_over_rounds(spark):
    """A source that turns bad loses its rows; the weights are those of its last trust."""
    rnd = random.Random(3)
    data = []
    for source, good in (("a", 7), ("b", 7), ("c", 3)):
        for r in range(1, 7):
            for i in range(120):
                label = rnd.randint(0, 1)
                x = [rnd.gauss(2.0 * label - 1, 0.6), rnd.random()]
                data.append((source, r, f"{r}-{i}", x, label if r < good else rnd.randint(0, 1)))
    table = spark.createDataFrame(data, "client_id string, round int, row_id string, x array<double>, label int").repartition(4)
    val, train = table.filter("row_id like '%5'"), table.filter("row_id not like '%5'")
    fitted = retraining.fit_rounds(train, lr=0.5, epochs=20, batch=64)
    assert fitted.count() == 18
    measured = retraining.measured_rounds(val, fitted).select("client_id", "round", "computed")
    history = trust.adaptive_trust(measured)
    quotas = {r.client_id: r for r in retraining.retrain_quotas(history, min_trust=0.75, base=100, cap=None).collect()}
    assert quotas["c"].quota == 0 and quotas["a"].quota > 100 and abs(sum(q.weight for q in quotas.values()) - 1) < 1e-9
    kept = retraining.retrain_rows(train, history, min_trust=0.75).groupBy("client_id").count().collect()
    assert {r.client_id for r in kept} == {"a", "b"}
