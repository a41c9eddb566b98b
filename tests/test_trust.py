"""Trust rules on hand-sized cases."""

import pytest
from pyspark.sql import functions as F

from sourcetrust.operators import trust as t
from sourcetrust.operators.metrics import evaluate, evaluation_set_check, histogram, roc_auc
from sourcetrust.operators.ordering import global_prefix_sum


def observed(spark, values, source="a"):
    return spark.createDataFrame([(source, i + 1, v) for i, v in enumerate(values)], "client_id string, round int, computed double")


def series(spark, values, **params):
    rows = t.adaptive_trust(observed(spark, values), t.TrustParams(**params)).orderBy("round").collect()
    return [round(r["trust"], 6) for r in rows]


@pytest.mark.parametrize("values, expected", [
    ([0.8], [0.5, 0.8]),
    ([0.6, 0.8], [0.5, 0.6, 0.66]),
    ([0.6, 0.8, 0.15, 0.05], [0.5, 0.6, 0.66, 0.2571, 0.05]),
    ([1.5, -0.5], [0.5, 1.0, 0.0]),
    ([float("nan")], [0.5, 0.5]),
    ([0.9, 0.5], [0.5, 0.9, 0.78]),
])
def test_adaptive_update(spark, values, expected):
    assert series(spark, values) == expected


def test_smoothed_first_update(spark):
    assert series(spark, [0.8], first_update="smoothed") == [0.5, 0.59]


def test_decay_of_idle_rounds(spark):
    spine = t.round_spine(observed(spark, [0.8]), 1, 3)
    rows = t.adaptive_trust(spine, decay=True).orderBy("round").collect()
    assert [(r["event"], round(r["trust"], 6)) for r in rows] == [
        ("initial", 0.5), ("update", 0.8), ("decay", 0.76), ("decay", 0.722),
    ]


def test_idle_before_the_first_update_is_smoothed(spark):
    df = spark.createDataFrame([("a", 2, 0.8)], "client_id string, round int, computed double")
    rows = t.adaptive_trust(t.round_spine(df, 1, 2), decay=True).orderBy("round").collect()
    assert [round(r["trust"], 6) for r in rows] == [0.5, 0.475, round(0.7 * 0.475 + 0.3 * 0.8, 6)]


def test_drop_alert_needs_a_real_fall(spark):
    smooth = t.sudden_drops(t.adaptive_trust(observed(spark, [0.9, 0.5])))
    assert smooth.count() == 0
    hard = t.sudden_drops(t.adaptive_trust(observed(spark, [0.9, 0.05]))).collect()
    assert [(r["round"], round(r["magnitude"], 6), r["type"]) for r in hard] == [(2, 0.85, "sudden_drop")]


def test_trend_and_consistency(spark):
    rising = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.5, 0.5, 0.6, 0.7, 0.8, 0.9])], "client_id string, round int, trust double")
    last = t.consistency_and_trend(rising).orderBy(F.desc("round")).first()
    assert last["trend"] == "improving" and abs(last["slope"] - 0.1) < 1e-9
    flat = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.5] + [0.75] * 5)], "client_id string, round int, trust double")
    last = t.consistency_and_trend(flat).orderBy(F.desc("round")).first()
    assert last["consistency"] == 1.0 and last["trend"] == "stable"
    first = t.consistency_and_trend(flat).orderBy("round").first()
    assert first["trend"] == "stable" and first["consistency"] == 1.0


def test_weights(spark):
    pair = spark.createDataFrame([("a", 0.9), ("b", 0.6)], "client_id string, trust double")
    got = {r["client_id"]: round(r["weight"], 4) for r in t.trust_weights(pair).collect()}
    assert got == {"a": 0.5804, "b": 0.4196}
    poor = spark.createDataFrame([("a", 0.3), ("b", 0.2)], "client_id string, trust double")
    rows = t.trust_weights(poor, min_trust=0.6).collect()
    assert [(r["weight"], r["fallback"]) for r in rows] == [(0.5, True)] * 2


@pytest.mark.parametrize("accuracy, share, expected", [(0.96, 0.95, 0.72), (0.96, 0.9, 0.96), (0.95, 0.95, 0.95), (None, 0.5, 0.1)])
def test_static_trust(spark, accuracy, share, expected):
    df = spark.createDataFrame([(accuracy, share)], "a double, s double")
    assert abs(df.select(t.static_trust(F.col("a"), F.col("s"))).first()[0] - expected) < 1e-12


def test_fusion_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None), (1.0, 1.0, 1.0, 1.0)], "a double, s double, d double, u double")
    got = [r[0] for r in df.select(t.fused(*[F.col(c) for c in "asdu"])).collect()]
    assert [round(v, 6) for v in got] == [round((0.3 + 0.2 + 0.1) / 1.7, 6), 1.0]
    none = t.Lambdas(0.0, 0.0, 0.0, 0.0)
    assert df.select(t.fused(*[F.col(c) for c in "asdu"], none)).first()[0] == 0.5


def test_stability_uses_earlier_rounds_only(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 1.0)], "client_id string, round int, accuracy double")
    assert [r["stability"] for r in t.stability_signal(df).orderBy("round").collect()] == [1.0, 1.0, 0.0]


def test_drift(spark):
    df = spark.createDataFrame([("a", 1, [0.0, 0.0], 0.0), ("a", 2, [3.0, 0.0], 4.0), ("a", 3, [30.0, 0.0], 4.0)], "client_id string, round int, coef array<double>, intercept double")
    assert [r["drift"] for r in t.drift_signal(df).orderBy("round").collect()] == [1.0, 0.5, 0.0]


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.9, 0.89, 0.5, 0.3, 0.1)], "t double")
    assert [r[0] for r in df.select(t.trust_band(F.col("t"))).collect()] == ["very high", "high", "medium", "low", "very low"]
    assert [r[0] for r in df.select(t.accuracy_band(F.col("t"))).collect()] == ["high", "high", "medium", "low", "low"]


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "client_id string, trust double")
    row = t.trust_summary(empty).first()
    assert row["count"] == 0 and row["mean"] == 0.0 and row["median"] == 0.0


def test_initial_rows_only_for_new_sources(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("b",)], "client_id string")
    known = spark.createDataFrame([("a", 3, 0.9)], "client_id string, round int, trust double")
    assert [tuple(r) for r in t.initial_history(sources, known).collect()] == [("b", 0, 0.5)]


def test_metrics_with_absent_classes(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 1, 0), ("y", 0, 0)], "g string, y_true int, y_pred int")
    got = {r["g"]: r for r in evaluate(df, ["g"]).collect()}
    assert (got["x"]["tp"], got["x"]["fn"], got["x"]["recall"], got["x"]["false_positive_rate"]) == (1, 1, 0.5, 0.0)
    assert got["y"]["f1_score"] == 0.0 and got["y"]["accuracy"] == 1.0
    checks = {r["g"]: (r["valid"], r["reason"]) for r in evaluation_set_check(evaluate(df, ["g"])).collect()}
    assert checks == {"x": (False, "no benign rows"), "y": (False, "no attack rows")}


def test_roc_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y_true int, score double")
    row = roc_auc(df).first()
    assert (row["points"], row["auc"]) == (3, 0.875)


def test_global_prefix_sum_over_many_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("v"))
    got = global_prefix_sum(df, [F.col("v")], {"rank": F.lit(1).cast("bigint"), "total": F.col("v")}).toPandas().sort_values("v")
    assert (got["rank"].to_numpy() == range(1, 5001)).all()
    assert (got["total"].to_numpy() == got["v"].cumsum().to_numpy()).all()


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(v / 10,) for v in range(11)], "t double")
    bins = {r["bin"]: r["n"] for r in histogram(df, "t", 5).collect()}
    assert sum(bins.values()) == 11 and max(bins) == 4


def test_trend_at_the_threshold_is_that_of_the_sql(spark):
    """Slopes that are exactly 0.01 but for rounding: the last bit must be the one the SQL twin has."""
    import duckdb

    histories = [[0.2, 0.33999999999999997, 0.0, 0.2, 0.32]]
    histories += [[(7 * h * h + 13 * i * h + 5 * i) % 100 / 100 * (1.0, 0.7, 0.49, 0.3)[(h + i) % 4] for i in range(5)] for h in range(400)]
    rows = [(f"s{h}", i, v) for h, values in enumerate(histories) for i, v in enumerate(values)]
    last = t.consistency_and_trend(spark.createDataFrame(rows, "client_id string, round int, trust double")).filter("round = 4")
    found = {r["client_id"]: r["slope"] for r in last.collect()}
    values = ", ".join(f"({h}, {i}, {v!r}::DOUBLE)" for h, i, v in [(int(c[1:]), i, v) for c, i, v in rows])
    wanted = duckdb.sql(f"SELECT h, regr_slope(y, x) FROM (VALUES {values}) t(h, x, y) GROUP BY h").fetchall()
    assert found == {f"s{h}": v for h, v in wanted}
    ends = t.evolution(spark.createDataFrame(rows[:5], "client_id string, round int, trust double")).first()
    assert ends["trend"] == "improving"
