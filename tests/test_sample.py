"""Sampler contracts: exact counts, same rows under any partitioning, hot sources included."""

import pytest
from pyspark.sql import functions as F

from scales import SMALL
from sourcetrust.operators import perturb, sample
from sourcetrust.operators.clean import binary_labels, feature_columns, prepare_features
from sourcetrust.plans import fixtures as fx


@pytest.fixture(scope="module")
def flows(spark):
    """Flows in which one source holds most of the rows."""
    df = fx.flows(spark, SMALL)
    hot = F.when(F.col("client_id").isin("client_0", "client_1"), F.col("client_id")).otherwise("client_hot")
    return df.withColumn("client_id", hot).persist()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


SAMPLERS = {
    "split": lambda df, b: sample.split_stratified(df, bucket_rows=b),
    "bootstrap": lambda df, b: sample.bootstrap_capped(df, 300, bucket_rows=b),
    "capped": lambda df, b: sample.bootstrap_capped(df, 300, replace=False, bucket_rows=b),
    "ratio": lambda df, b: sample.class_ratio_sample(df, 1000, bucket_rows=b),
    "rebalance": lambda df, b: sample.rebalance(df, bucket_rows=b),
    "mix": lambda df, b: sample.mix_benign(df.filter("client_id <> 'client_0'"), df.filter("client_id = 'client_0'"), 0.5, bucket_rows=b),
    "flip": lambda df, b: perturb.flip_random(df, 0.3, bucket_rows=b),
    "adversarial": lambda df, b: perturb.flip_adversarial(df, 0.3, fx.FEATURES, bucket_rows=b),
    "corrupt": lambda df, b: perturb.corrupt_features(df, 0.3, fx.FEATURES, bucket_rows=b).drop(*fx.FEATURES),
}


@pytest.mark.parametrize("name", sorted(SAMPLERS))
def test_same_rows_for_any_bucket_size_and_partitioning(flows, name):
    whole = SAMPLERS[name](flows, 100_000)
    split = SAMPLERS[name](flows.repartition(13, "row_id"), 50)
    assert same(whole, split.select(whole.columns))


def test_split_counts(flows):
    got = sample.split_stratified(flows).groupBy("client_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "val").alias("v")
    ).collect()
    assert all(r["v"] == -(-r["n"] // 5) for r in got)


def test_single_row_class_stays_in_train(spark):
    df = spark.createDataFrame([("a", str(i), 0) for i in range(9)] + [("a", "x", 1)], "client_id string, row_id string, label int")
    got = {r["row_id"]: r["split"] for r in sample.split_stratified(df).collect()}
    assert got["x"] == "train" and list(got.values()).count("val") == 2


def test_bootstrap_counts_are_exact(flows):
    got = sample.bootstrap_capped(flows, 300).groupBy("client_id").count().collect()
    sizes = {r["client_id"]: r["count"] for r in flows.groupBy("client_id").count().collect()}
    assert {r["client_id"]: r["count"] for r in got} == {c: min(n, 300) for c, n in sizes.items()}


def test_uncapped_quota_may_exceed_the_source(spark, flows):
    targets = spark.createDataFrame([("client_0", 5_000), ("client_hot", 100)], "client_id string, target bigint")
    got = {r["client_id"]: r["count"] for r in sample.resize(flows, targets, bucket_rows=50).groupBy("client_id").count().collect()}
    kept = flows.filter("client_id = 'client_1'").count()
    assert got == {"client_0": 5_000, "client_hot": 100, "client_1": kept}


def test_weight_quotas(spark):
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.0)], "client_id string, weight double")
    capped = {r["client_id"]: r["quota"] for r in sample.weight_quotas(weights, 100, 100).collect()}
    free = {r["client_id"]: r["quota"] for r in sample.weight_quotas(weights, None, 100).collect()}
    assert capped == {"a": 100, "b": 100, "c": 0} and free == {"a": 150, "b": 150, "c": 0}
    thirds = spark.createDataFrame([(c, 1 / 3) for c in "abc"], "client_id string, weight double")
    assert {r["quota"] for r in sample.weight_quotas(thirds).collect()} == {15_000}


def test_quota_zero_drops_the_source(spark, flows):
    quotas = spark.createDataFrame([("client_0", 0), ("client_hot", 50)], "client_id string, quota bigint")
    assert {r["client_id"]: r["count"] for r in sample.quota_sample(flows, quotas).groupBy("client_id").count().collect()} == {"client_hot": 50}


def test_mixing_need(spark):
    rows = [("a", f"a{i}", 1) for i in range(80)] + [("a", f"b{i}", 0) for i in range(5)]
    df = spark.createDataFrame(rows, "client_id string, row_id string, label int")
    assert sample.mixing_needs(df, 0.2).first()["need"] == 15
    pool = spark.createDataFrame([("p", f"p{i}", 0) for i in range(9)], "client_id string, row_id string, label int")
    assert sample.mix_benign(df, pool).count() == 85 + 9


def test_ratio_sample_without_benign_rows(spark):
    df = spark.createDataFrame([(str(i), 1) for i in range(50)], "row_id string, label int")
    assert sample.class_ratio_sample(df, 20).count() == 20
    assert sample.class_ratio_sample(df, 20, refill=False).count() == 16


def test_rebalance_halves(spark):
    rows = [("a", f"m{i}", 1) for i in range(90)] + [("a", f"s{i}", 0) for i in range(10)]
    df = spark.createDataFrame(rows, "client_id string, row_id string, label int")
    got = {r["label"]: r["count"] for r in sample.rebalance(df).groupBy("label").count().collect()}
    assert got == {1: 50, 0: 20}


def test_clean_validation_without_parent_keeps_own(spark):
    noisy = spark.createDataFrame([("1", "low", "val", 1), ("2", "low", "val", 1), ("3", "high", "val", 1), ("4", "low", "train", 1)], "row_id string, quality string, split string, label int")
    clean = spark.createDataFrame([("1", 0), ("3", 0)], "row_id string, label int")
    got = {r["row_id"]: r["label"] for r in sample.clean_validation(noisy, clean, ["label"]).collect()}
    assert got == {"1": 0, "2": 1, "3": 1}


def test_flip_counts_and_zero(flows):
    sizes = {r["client_id"]: r["count"] for r in flows.groupBy("client_id").count().collect()}
    for ratio in (0.0, 0.55, 1.0):
        got = perturb.flip_adversarial(flows, ratio, fx.FEATURES).groupBy("client_id").agg(F.count_if("flipped").alias("k")).collect()
        assert {r["client_id"]: r["k"] for r in got} == {c: int(n * ratio) for c, n in sizes.items()}


def test_targeted_corruption_hits_only_variable_features(spark):
    names = [f"f{i}" for i in range(30)]
    df = spark.range(400).select(F.lit("a").alias("client_id"), F.col("id").cast("string").alias("row_id"), *[
        (((F.col("id") * 37) % 101) * float(i)).alias(n) for i, n in enumerate(names)
    ])
    got = perturb.corrupt_features(df, 0.5, names, targeted=True)
    changed = got.join(df.select("row_id", *[F.col(n).alias(f"o_{n}") for n in names]), "row_id")
    touched = changed.agg(*[F.count_if(F.col(n) != F.col(f"o_{n}")).alias(n) for n in names]).first().asDict()
    assert {n for n, k in touched.items() if k} == set(names[-6:])
    per_row = sum([F.when(F.col(n) != F.col(f"o_{n}"), 1).otherwise(0) for n in names], F.lit(0))
    assert changed.filter("corrupted").agg(F.max(per_row)).first()[0] == 1
    assert changed.filter("corrupted").count() == 200


def test_labels(spark):
    rows = [("t", "BENIGN"), ("t", "benign"), ("t", "DoS"), ("t", None), ("b", "0"), ("b", "1.0"), ("x", "0"), ("x", "1"), ("x", None)]
    df = spark.createDataFrame(rows, "client_id string, label_raw string")
    got = sorted((r["client_id"], r["label_raw"] or "", r["label"]) for r in binary_labels(df).collect())
    assert got == [("b", "0", 0), ("b", "1.0", 1), ("t", "", 1), ("t", "BENIGN", 0), ("t", "DoS", 1), ("t", "benign", 0), ("x", "", 1), ("x", "0", 1), ("x", "1", 1)]
    assert binary_labels(df, strict=True).filter("label is null").count() == 2


def test_features(spark):
    df = spark.createDataFrame([("a", 1, float("nan"), 5.0), ("a", 2, float("inf"), 5.0), ("a", 3, 1e9, 5.0)], "client_id string, src_port int, x double, y double")
    assert feature_columns(df) == ["x", "y"]
    got = prepare_features(df, ["x", "y"]).collect()
    assert all(r["y"] == 0.0 for r in got) and abs(max(r["x"] for r in got) - 2**0.5) < 1e-6
