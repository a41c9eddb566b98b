"""Kernels against plain NumPy, and statistics against known values."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scales import SMALL
from sourcetrust.functions import student_t
from sourcetrust.operators import models, reports
from sourcetrust.plans import fixtures as fx


@pytest.fixture(scope="module")
def vectors(spark):
    return fx.vectors(spark, SMALL).persist()


def numpy_descent(x, y, start, seed, mu, epochs, lr=0.05, batch=1024):
    design, theta, rng = np.c_[x, np.ones(len(x))], start.copy(), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at:at + batch]
            p = 1 / (1 + np.exp(-np.clip((design[rows] * theta).sum(axis=1), -50, 50)))
            pull = theta - start
            pull[-1] = 0.0
            theta = theta - lr * ((design[rows] * (p - y[rows])[:, None]).mean(axis=0) + mu * pull)
    return theta


def by_source(df, seed):
    out = {}
    for name, group in df.toPandas().groupby("client_id"):
        group = group.assign(k=[hashlib.md5(f"{seed}|{r}".encode()).hexdigest() for r in group["row_id"]]).sort_values("k")
        out[name] = (np.stack(group["x"]), group["label"].to_numpy(float))
    return out


def test_local_fit_is_the_numpy_descent(vectors):
    got = {r["client_id"]: np.r_[r["coef"], r["intercept"]] for r in models.fit_sources(vectors, seed=7).collect()}
    for name, (x, y) in by_source(vectors, 7).items():
        assert np.allclose(got[name], numpy_descent(x, y, np.zeros(65), 7, 0.0, 2), atol=1e-12)


def test_fit_reads_a_bounded_number_of_rows(vectors):
    got = {r["client_id"]: r for r in models.fit_sources(vectors, seed=7, fit_rows=30).collect()}
    sizes = {r["client_id"]: r["count"] for r in vectors.groupBy("client_id").count().collect()}
    assert {c: r["n"] for c, r in got.items()} == sizes
    for name, (x, y) in by_source(vectors, 7).items():  # rows in hash order
        expected = numpy_descent(x[:30], y[:30], np.zeros(65), 7, 0.0, 2)
        assert np.allclose(np.r_[got[name]["coef"], got[name]["intercept"]], expected, atol=1e-12)


def test_constant_model_for_one_class(spark):
    df = spark.createDataFrame([("a", str(i), [1.0, 2.0], 1) for i in range(5)], "client_id string, row_id string, x array<double>, label int")
    row = models.fit_sources(df).first()
    assert row["constant"] and row["coef"] == [0.0, 0.0] and row["intercept"] == 50.0
    measured = models.training_metrics(df, models.fit_sources(df)).first()
    assert (measured["train_accuracy"], measured["train_f1"]) == (0.5, 0.0)


def test_proximal_rounds(vectors):
    got = models.proximal_rounds(vectors, rounds=2, mu=0.1, cap=None, seed=5).first()
    theta = np.zeros(65)
    for r in (1, 2):
        parts = [(len(x), numpy_descent(x, y, theta, 5 + r, 0.1, 1)) for x, y in by_source(vectors, 5 + r).values()]
        theta = sum(n * t for n, t in parts) / sum(n for n, _ in parts)
    assert np.allclose(np.r_[got["coef"], got["intercept"]], theta, atol=1e-12)


def test_median_rounds(vectors):
    got = models.median_rounds(vectors, rounds=2, cap=None, seed=5).first()
    theta = np.zeros(65)
    for r in (1, 2):
        theta = np.median([numpy_descent(x, y, theta, 5 + r, 0.0, 1) for x, y in by_source(vectors, 5 + r).values()], axis=0)
    assert np.allclose(np.r_[got["coef"], got["intercept"]], theta, atol=1e-12)


def test_capped_rounds_run(vectors):
    got = models.proximal_rounds(vectors, rounds=1, cap=20, seed=5).first()
    assert len(got["coef"]) == 64 and np.isfinite(got["coef"]).all()


def test_ensemble_in_blocks(vectors):
    fitted = models.fit_sources(vectors).withColumn("weight", F.lit(0.2))
    whole = models.ensemble_score(vectors, fitted).select("row_id", "y_proba")
    blocks = models.ensemble_score(vectors, fitted, max_cells=150).select("row_id", "y_proba")
    assert whole.exceptAll(blocks).isEmpty()


@pytest.mark.parametrize("kind, settings", [
    ("logistic_regression", {}), ("random_forest", {"numTrees": 5, "maxDepth": 4}),
    ("boosted_trees", {"maxIter": 3, "maxDepth": 2}), ("mlp", {"maxIter": 20}),
])
def test_global_fit(vectors, kind, settings):
    model = models.fit_global(vectors, kind, **settings)
    scored = models.score_global(model, vectors)
    assert scored.filter("y_pred = label").count() > 0.5 * vectors.count()
    assert scored.filter("y_proba < 0 or y_proba > 1").isEmpty()
    assert len(next(iter(models.model_parameters(model).values()))) >= 64


def test_global_fit_needs_two_classes(vectors):
    one_class = vectors.filter("label = 1")
    model = models.fit_global(one_class)
    scored = models.score_global(model, one_class)
    assert scored.filter("y_pred <> 1 OR y_proba <> 1").isEmpty() and scored.count() == one_class.count()
    assert models.model_parameters(model) == {"coef": [0.0] * 64, "intercept": 50.0}
    with pytest.raises(ValueError):
        models.fit_global(vectors, "other")


@pytest.mark.parametrize("t, df, p", [(2.0859634472658364, 20, 0.05), (12.706204736432095, 1, 0.05), (0.0, 5, 1.0), (2.5758293035489004, 10**7, 0.01)])
def test_p_values(t, df, p):
    assert abs(student_t.two_sided_p(t, df) - p) < 1e-7
    if t:
        assert abs(student_t.quantile(1 - p / 2, df) - t) < 1e-6 * t


def test_t_test_and_interval(spark):
    rows = [("x", "accuracy", v) for v in (1.0, 2.0, 3.0)] + [("y", "accuracy", v) for v in (4.0, 5.0, 6.0)] + [("x", "f1", 1.0)]
    df = spark.createDataFrame(rows, "variant string, metric string, value double")
    got = {r["metric"]: r for r in reports.two_sample_t(df, "x", "y").collect()}
    assert abs(got["accuracy"]["t"] + 3.6742346141747673) < 1e-12 and got["accuracy"]["df"] == 4
    assert abs(got["accuracy"]["p_value"] - 0.021311641128756) < 1e-9 and got["accuracy"]["stars"] == "*"
    assert got["f1"]["t"] is None and got["f1"]["stars"] is None
    stats = reports.confidence_interval(reports.trial_stats(df, ["variant", "metric"])).filter("variant = 'x' and metric = 'accuracy'").first()
    assert abs(stats["high"] - 2.0 - 4.302652729911275 / 3**0.5) < 1e-6


def test_tasks_of_a_global_fit_follow_the_rows(spark, vectors, monkeypatch):
    """However many partitions rows come in, a small table is fitted in one, with one result."""
    seen, first = [], models._estimators

    def watched(width, seed):
        made = first(width, seed)["boosted_trees"](maxIter=2, maxDepth=2)
        fit = made.fit
        made.fit = lambda rows: (seen.append(rows.rdd.getNumPartitions()), fit(rows))[1]
        return {"boosted_trees": lambda **_: made}

    monkeypatch.setattr(models, "_estimators", watched)
    found = {str(models.fit_global(vectors.repartition(n), "boosted_trees").toDebugString) .split("\n", 1)[1] for n in (2, 37)}
    assert seen == [1, 1] and len(found) == 1
