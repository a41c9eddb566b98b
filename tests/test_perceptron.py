"""The perceptron against the same training in NumPy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcetrust.operators import perceptron as p


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def rows(seed=1, n=400):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    return x, (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)


def twin(x, y, weight, s):
    held = np.array([uniform(s.seed, "held", i) < s.held_back for i in range(len(x))])
    part = np.array([int(uniform(s.seed, "batch", i) * s.batches) for i in range(len(x))])
    theta = p.first_parameters(3, s.hidden, s.seed)
    m, v, best, high, idle, step = np.zeros_like(theta), np.zeros_like(theta), theta, -1.0, 0, 0
    free = np.r_[np.zeros(3 * s.hidden, bool), np.ones(s.hidden, bool), np.zeros(s.hidden, bool), True]
    for _ in range(s.epochs):
        for b in range(s.batches):
            inner, bias, outer = theta[:3 * s.hidden].reshape(3, -1), theta[3 * s.hidden:4 * s.hidden], theta[4 * s.hidden:-1]
            if b == 0 and held.any():
                answers = np.maximum(x[held] @ inner + bias, 0) @ outer + theta[-1] >= 0
                share = (answers == y[held]).mean()
                idle = 0 if share > high + s.tolerance else idle + 1
                if share > high:
                    best, high = theta, share
                if idle > s.patience:
                    return best
            own = ~held & (part == b)
            z = x[own] @ inner + bias
            h = np.maximum(z, 0)
            error = (1 / (1 + np.exp(-(h @ outer + theta[-1]))) - y[own]) * weight[own]
            back = np.outer(error, outer) * (z > 0)
            g = np.r_[(x[own].T @ back).ravel(), back.sum(0), h.T @ error, error.sum()]
            g = (g + s.penalty * np.where(free, 0, theta)) / weight[own].sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - s.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-8)
    return best if high >= 0 else theta


def table(spark, x, y):
    data = [(str(i), a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row_id string, x array<double>, label int").repartition(3)


@pytest.mark.parametrize("settings,weights", [
    (p.Settings(hidden=6, rate=0.05, epochs=12), None),
    (p.Settings(hidden=4, rate=0.05, epochs=4, batches=2, held_back=0.0), {0: 1.0, 1: 3.0}),
    (p.Settings(hidden=5, rate=0.2, epochs=30, patience=2, held_back=0.3), None),
])
def test_equals_its_twin(spark, settings, weights):
    x, y = rows()
    weight = np.array([(weights or {}).get(int(v), 1.0) for v in y])
    model = p.fit_perceptron(table(spark, x, y), settings, weights)
    assert np.allclose(model.theta, twin(x, y, weight, settings), atol=1e-9)
    if settings.patience == 2:
        assert model.epochs < settings.epochs
    scored = p.score_perceptron(table(spark, x, y), model).collect()
    inner, bias, outer, out = model.parts()
    expected = 1 / (1 + np.exp(-(np.maximum(x @ inner + bias, 0) @ outer + out)))
    assert np.allclose([r.y_proba for r in sorted(scored, key=lambda r: int(r.row_id))], expected)


def test_gradient_by_differences():
    x, y = rows(2, 40)
    model = p.Perceptron(p.first_parameters(3, 4, 1), 3, 4)

    def loss(theta):
        inner, bias, outer, out = p.Perceptron(theta, 3, 4).parts()
        z = np.maximum(x @ inner + bias, 0) @ outer + out
        return np.sum(np.logaddexp(0, z) - y * z)

    steps = np.eye(len(model.theta)) * 1e-6
    numeric = [(loss(model.theta + e) - loss(model.theta - e)) / 2e-6 for e in steps]
    assert np.allclose(p.gradient_sums(model, x, y, np.ones(40)), numeric, atol=1e-5)


def test_empty_table(spark):
    model = p.fit_perceptron(table(spark, np.zeros((1, 3)), [0]).filter(F.lit(False)), p.Settings(hidden=2, epochs=2))
    assert model.width == 0


def test_rows_of_a_part_travel_as_blocks(spark):
    rows = spark.range(1000, numPartitions=1).selectExpr("array(double(id), 2.0D) AS x", "1.0D AS y", "0.5D AS w", "int(id % 3) - 1 AS part")
    blocks = rows.mapInArrow(p._packed, "x binary, y binary, w binary, part int, width int").collect()
    assert sorted(b["part"] for b in blocks) == [-1, 0, 1]
    x = np.concatenate([np.frombuffer(b["x"]).reshape(-1, b["width"]) for b in blocks])
    assert sorted(x[:, 0]) == list(range(1000)) and set(x[:, 1]) == {2.0}
