"""Queries over the driver's tables, one per operator; `oracles` holds the SQL twins.

Floating-point results are rounded so that two engines summing in different orders agree.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sourcetrust.functions.session import new_folder
from sourcetrust.functions.vectors import binary_entropy
from sourcetrust.operators import clean, forests, metrics, models, perceptron, perturb, reports, retraining, sample, trust
from sourcetrust.operators.joins import sized
from sourcetrust.plans import fixtures as fx
from sourcetrust.plans.rounding import nudge
from sourcetrust.sources import flows as src, history as hist, results as res
from sourcetrust.streaming import rounds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CAP = 2_000
DEMAND = {"min_trust": 0.6, "beta": 0.8}
BETAS = [0.5, 0.8, 1.0, 1.2]
THRESHOLDS = [0.0, 0.6]
# accuracy, stability, drift, uncertainty
LAMBDA_SETS = [(1.0, 0.0, 0.0, 0.0), (1.0, 0.3, 0.0, 0.0), (1.0, 0.3, 0.2, 0.0), (1.0, 0.3, 0.2, 0.2)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(x: Column | str, digits: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)


def rounded_as(names: list[str], digits: int = 6) -> list[Column]:
    return [rounded(n, digits).alias(n) for n in names]


def longs(names: list[str]) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# prices reach 1e5, so two digits keep rounding well above summation noise
FEATURE_DIGITS = {"quantity": 4, "extendedprice": 2, "discount": 5, "tax": 5}


def feature_out() -> list[Column]:
    return [rounded(f, digits).alias(f) for f, digits in FEATURE_DIGITS.items()]


# ---- scans, projection, cleaning -------------------------------------------------------


@query
def scan_union(spark, sf_dir):
    df = fx.flows(spark, sf_dir)
    even = F.col("supplier") % 2 == 0
    left = df.filter(even).select("client_id", "row_id", "quantity", "tax")
    right = df.filter(~even).select("client_id", "row_id", "extendedprice", "discount")
    merged = clean.union_sources([left, right], ["client_id", "row_id"])
    return merged.select("client_id", "row_id", *[rounded(c).alias(c) for c in merged.columns[2:]])


@query
def scan_written(spark, sf_dir):
    """Sources written as CSV files with two kinds of headers, read back in one scan and united."""
    df = fx.flows(spark, sf_dir)
    even, folder = F.col("supplier") % 2 == 0, new_folder(spark, "sources")
    res.write_sources(df.filter(even).select("client_id", "row_id", "quantity", "tax"), f"{folder}/even", "csv")
    res.write_sources(df.filter(~even).select("client_id", "row_id", "discount", "extendedprice"), f"{folder}/odd", "csv")
    rows = src.scan_headed(spark, [f"{folder}/even/*", f"{folder}/odd/*"]).filter("NOT bad_row")
    values = [rounded(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in ("discount", "extendedprice", "quantity", "tax")]
    return rows.select(F.regexp_extract("file_path", "client_id=([^/]+)", 1).alias("client_id"), "row_id", *values)


@query
def source_preference(spark, sf_dir):
    df = src.prefer_sources(fx.named_sources(spark, sf_dir))
    return df.groupBy("source_name").agg(F.count("*").alias("n"))


@query
def source_identity(spark, sf_dir):
    named = fx.named_sources(spark, sf_dir)
    ids = src.identify_sources(src.prefer_sources(named))
    return ids.select("source_name", "ordinal", "client_id", "quality", src.parent_name(F.col("source_name")).alias("parent"))


@query
def benign_scan(spark, sf_dir):
    df = src.benign_sources(fx.named_sources(spark, sf_dir))
    return df.groupBy("source_name").agg(F.count("*").alias("n"))


@query
def reserve_source(spark, sf_dir):
    named = fx.named_sources(spark, sf_dir)
    reserved = src.reserve_source(named)
    training = src.training_sources(named, reserved).groupBy("source_name").agg(F.count("*").alias("n"))
    return training.withColumn("role", F.lit("train")).unionByName(
        reserved.select("source_name", F.lit(None).cast("bigint").alias("n"), F.lit("reserved").alias("role"))
    )


def raw_label_kinds(df: DataFrame) -> DataFrame:
    """Text labels, 0/1 labels and 0/1 labels with gaps, by source, under an upper-case name."""
    m = F.col("supplier") % 12
    digit = F.col("label").cast("string")
    text = F.when(F.col("quantity") > 25, F.lower("label_raw")).otherwise(F.col("label_raw"))
    kind = F.when(m < 4, text).when(m < 8, digit).otherwise(F.when(F.col("tax") != 0, digit))
    return df.select("client_id", "row_id", kind.alias("LABEL_TEXT"))


@query
def label_binary(spark, sf_dir):
    df = clean.rename_column(raw_label_kinds(fx.flows(spark, sf_dir)), "label_text")
    return clean.binary_labels(df, "label_text").select("client_id", "row_id", "label_text", "label")


def broken_features(df: DataFrame) -> DataFrame:
    """Nulls, NaN and infinities in some features."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return df.withColumns({
        "quantity": F.when(F.col("tax") == 0, nan).otherwise(F.col("quantity")),
        "extendedprice": F.when(F.col("discount") == 0, inf)
        .when(F.col("quantity") > 45, -inf).otherwise(F.col("extendedprice") * 20),
        "tax": F.when(F.col("quantity") > 25, F.col("tax")),
    })


@query
def features_finite(spark, sf_dir):
    df = broken_features(fx.flows(spark, sf_dir)).withColumnRenamed("row_id", "flow_id").drop("ts", "supplier", "round")
    features = clean.feature_columns(df)
    return clean.finite_features(df, features).select("flow_id", *[rounded(f).alias(f) for f in sorted(features)])


@query
def clip(spark, sf_dir):
    df = clean.finite_features(broken_features(fx.flows(spark, sf_dir)), fx.FEATURES)
    return clean.clip_features(df, fx.FEATURES).select("row_id", *rounded_as(fx.FEATURES))


@query
def standardise(spark, sf_dir):
    df = clean.prepare_features(broken_features(fx.flows(spark, sf_dir)), fx.FEATURES)
    return df.select("client_id", "row_id", *rounded_as(fx.FEATURES, 5))


@query
def align(spark, sf_dir):
    wanted = ["discount", "duration", "quantity", "tax"]
    return clean.align_features(fx.flows(spark, sf_dir), ["row_id"], wanted).select("row_id", *rounded_as(wanted))


@query
def exclude_sources(spark, sf_dir):
    df = src.exclude_sources(fx.named_sources(spark, sf_dir), ["LOW_quality", "benign", "s13"])
    return df.groupBy("source_name").agg(F.count("*").alias("n"))


@query
def class_filter(spark, sf_dir):
    df = clean.of_class(fx.flows(spark, sf_dir), 0)
    return df.select("client_id", "row_id", "label")


@query
def first_sources(spark, sf_dir):
    named = src.first_sources(fx.named_sources(spark, sf_dir), 5)
    return src.exclude_sources(named, ["benign"]).groupBy("source_name").agg(F.count("*").alias("n"))


# ---- sampling, splitting, mixing -------------------------------------------------------


@query
def split_stratified(spark, sf_dir):
    df = sample.split_stratified(fx.flows(spark, sf_dir), 0.2, fx.SEED)
    return df.select("client_id", "row_id", "label", "split")


@query
def split_plain(spark, sf_dir):
    df = sample.split_stratified(fx.flows(spark, sf_dir), 0.2, fx.SEED, stratify=False)
    return df.select("client_id", "row_id", "split")


@query
def bootstrap_capped(spark, sf_dir):
    df = sample.bootstrap_capped(fx.flows(spark, sf_dir), CAP, fx.SEED)
    return df.select("client_id", "row_id", "label", "draw")


@query
def sample_capped(spark, sf_dir):
    """Equal-source union without replacement."""
    df = sample.bootstrap_capped(fx.flows(spark, sf_dir), CAP, fx.SEED, replace=False)
    return df.select("client_id", "row_id", "label")


def demand_weights(spark, sf_dir) -> DataFrame:
    latest = trust.latest_trust(agreement_history(spark, sf_dir))
    weighted = trust.trust_weights(latest, DEMAND["beta"], DEMAND["min_trust"])
    return sample.weight_quotas(weighted, CAP, CAP)


@query
def trust_quota_sample(spark, sf_dir):
    quotas = demand_weights(spark, sf_dir)
    df = sample.quota_sample(fx.flows(spark, sf_dir), quotas, fx.SEED)
    return df.select("client_id", "row_id", "label", "draw")


@query
def class_ratio_sample(spark, sf_dir):
    df = sample.class_ratio_sample(fx.flows(spark, sf_dir), 10_000, 0.2, fx.SEED)
    return df.select("client_id", "row_id", "label")


@query
def mix_benign(spark, sf_dir):
    df = fx.flows(spark, sf_dir).select("client_id", "supplier", "row_id", "label")
    is_pool = F.col("supplier") % 12 < 3
    mixed = sample.mix_benign(df.filter(~is_pool).drop("supplier"), df.filter(is_pool).drop("supplier"), 0.6, fx.SEED)
    return mixed.select("client_id", "row_id", "label", "mixed_in")


@query
def resize(spark, sf_dir):
    df = fx.flows(spark, sf_dir)
    goal = F.coalesce(*[F.when(F.col("quality") == q, F.lit(n)) for q, n in perturb.TIER_ROWS.items()])
    targets = fx.tiers(df).withColumn("target", goal.cast("bigint"))
    return sample.resize(df, targets, fx.SEED).select("client_id", "row_id", "label", "draw")


@query
def rebalance(spark, sf_dir):
    df = sample.rebalance(fx.flows(spark, sf_dir), fx.SEED)
    return df.select("client_id", "row_id", "label", "draw")


@query
def rebalance_texts(spark, sf_dir):
    """Labels as texts in both cases of letters: BENIGN is one class, all else the other."""
    text = F.when(F.col("quantity") > 25, F.lower("label_raw")).otherwise(F.col("label_raw"))
    df = sample.rebalance(fx.flows(spark, sf_dir).withColumn("label", text), fx.SEED)
    return df.select("client_id", "row_id", (~clean.is_benign(F.col("label"))).cast("int").alias("label"), "draw")


@query
def prepare_tiers(spark, sf_dir):
    """Preparation end to end: tier noise, resize, equal classes for compromised sources, shuffled, written and read."""
    df = fx.flows(spark, sf_dir)
    tiers = sized(fx.tiers(df))
    noisy = perturb.apply_tiers(df, tiers.table, fx.FEATURES, fx.SEED)
    goal = F.coalesce(*[F.when(F.col("quality") == q, F.lit(n)) for q, n in perturb.TIER_ROWS.items()])
    drawn = sample.resize(noisy, tiers.table.withColumn("target", goal.cast("bigint")), fx.SEED)
    # drawn rows repeat; a row's key and draw together are its own
    drawn = drawn.withColumn("row_id", F.concat_ws("|", "row_id", F.col("draw").cast("string"))).drop("draw")
    drawn = sized(drawn.withColumn("label", F.when(F.col("label") == 0, "BENIGN").otherwise("ATTACK"))).table
    poor = F.col("quality") == "compromised"
    balanced = sample.rebalance(drawn.filter(poor), fx.SEED).drop("draw")
    rows = sample.shuffle_rows(balanced.unionByName(drawn.filter(~poor)), fx.SEED)
    path = f"{new_folder(spark, 'tiers')}/sources"
    res.write_sources(rows.select("client_id", "row_id", "label", *fx.FEATURES), path)
    table = spark.read.parquet(path)
    return table.groupBy("client_id").agg(
        F.count("*").alias("n"), F.count_if(clean.is_benign(F.col("label"))).alias("benign")
    )


@query
def shuffle_key(spark, sf_dir):
    return sample.shuffle_rows(fx.flows(spark, sf_dir), fx.SEED).select("row_id", "shuffle_key")


@query
def clean_validation(spark, sf_dir):
    noisy = fx.noisy_labels(spark, sf_dir)
    split = sample.split_stratified(noisy, 0.2, fx.SEED)
    chosen = sample.clean_validation(split, fx.flows(spark, sf_dir), ["label"])
    return chosen.select("client_id", "quality", "row_id", "label", "from_parent")


# ---- perturbation ----------------------------------------------------------------------


@query
def flip_random(spark, sf_dir):
    df = perturb.flip_random(fx.flows(spark, sf_dir), 0.25, fx.SEED, label="label_raw")
    return df.select("client_id", "row_id", "label_raw", "flipped")


@query
def flip_bernoulli(spark, sf_dir):
    df = perturb.flip_random(fx.flows(spark, sf_dir), 0.25, fx.SEED, exact=False)
    return df.select("client_id", "row_id", "label", "flipped")


@query
def flip_adversarial(spark, sf_dir):
    df = perturb.flip_adversarial(fx.flows(spark, sf_dir), 0.4, fx.FEATURES, fx.SEED)
    return df.select("client_id", "row_id", "label", "flipped")


@query
def corrupt_random(spark, sf_dir):
    df = perturb.corrupt_features(fx.flows(spark, sf_dir), 0.35, fx.FEATURES, fx.SEED)
    return df.select("client_id", "row_id", "corrupted", *feature_out())


@query
def corrupt_targeted(spark, sf_dir):
    """Eight features, so that only the most variable ones are hit."""
    df = fx.flows(spark, sf_dir).withColumns({
        "net": F.col("extendedprice") * (1 - F.col("discount")), "unit": F.col("extendedprice") / F.col("quantity"),
        "flat": F.lit(1.0), "year": F.year("ts").cast("double"),
    })
    wide = [*fx.FEATURES, "net", "unit", "flat", "year"]
    changed = perturb.corrupt_features(df, 0.95, wide, fx.SEED, targeted=True)
    extra = [rounded("net", 2).alias("net"), rounded("unit", 2).alias("unit"), rounded("flat", 4).alias("flat"),
             rounded("year", 4).alias("year")]
    return changed.select("client_id", "row_id", "corrupted", *feature_out(), *extra)


@query
def tier_preset(spark, sf_dir):
    df = fx.flows(spark, sf_dir)
    noisy = perturb.apply_tiers(df, fx.tiers(df), fx.FEATURES, fx.SEED)
    return noisy.select("client_id", "quality", "row_id", "label", "flipped", "corrupted", *feature_out())


@query
def degrade(spark, sf_dir):
    df = perturb.degrade(fx.flows(spark, sf_dir), fx.FEATURES, 0.5, fx.SEED)
    return df.select("client_id", "row_id", "label", "flipped", "corrupted", *feature_out())


@query
def restore(spark, sf_dir):
    original = fx.flows(spark, sf_dir)
    worse = perturb.degrade(original, fx.FEATURES, 0.5, fx.SEED)
    better = perturb.restore(worse, original, fx.FEATURES, 0.4, fx.SEED)
    return better.select("client_id", "row_id", "label", "restored", *feature_out())


# ---- metrics ---------------------------------------------------------------------------

RATES = ["accuracy", "precision", "recall", "f1_score", "false_positive_rate", "true_positive_rate",
         "true_negative_rate", "false_negative_rate"]


def round_metrics(spark, sf_dir) -> DataFrame:
    """Confusion counts and rates per source and round."""
    return metrics.evaluate(fx.agreement(spark, sf_dir), ["client_id", "quality", "round"])


@query
def confusion(spark, sf_dir):
    cells = ["tn", "fp", "fn", "tp"]
    return round_metrics(spark, sf_dir).select("client_id", *longs(["round", *cells]), *rounded_as(RATES))


@query
def join_predictions(spark, sf_dir):
    truth = fx.flows(spark, sf_dir).select("client_id", "row_id", F.col("label").alias("y_true"))
    predictions = fx.agreement(spark, sf_dir).select("client_id", "row_id", "quality", "y_pred")
    joined = metrics.join_predictions(truth, predictions)
    return metrics.evaluate(joined, ["quality"]).select("quality", "tn", "fp", "fn", "tp", *rounded_as(RATES))


@query
def class_report(spark, sf_dir):
    report = metrics.classification_report(fx.agreement(spark, sf_dir), ["client_id"])
    return report.select("client_id", "class", *rounded_as(["precision", "recall", "f1_score"]), "support")


@query
def class_distribution(spark, sf_dir):
    split = sample.split_stratified(fx.noisy_labels(spark, sf_dir), 0.2, fx.SEED)
    shares = metrics.class_distribution(split, ["client_id", "split"], totals=True)
    return shares.select(
        F.coalesce("client_id", F.lit("all")).alias("client_id"), F.coalesce("split", F.lit("all")).alias("split"),
        "n", "benign", "attack", *rounded_as(["benign_ratio", "majority_ratio"]),
    )


@query
def source_report(spark, sf_dir):
    """Rows, features and benign shares of every source; a third of the sources have no tax."""
    df = fx.flows(spark, sf_dir)
    number = F.regexp_extract("client_id", r"(\d+)$", 1).cast("int")
    df = df.withColumn("tax", F.when(number % 3 > 0, F.col("tax")))
    table = metrics.source_report(sample.split_stratified(df, 0.2, fx.SEED), fx.FEATURES)
    return table.select("client_id", *longs(["train_samples", "val_samples", "n_features"]), *rounded_as(["train_benign_ratio", "val_benign_ratio"]))


@query
def tier_counts(spark, sf_dir):
    return metrics.tier_counts(fx.tiers(fx.flows(spark, sf_dir)))


@query
def eval_set_check(spark, sf_dir):
    """Rated documents by source: some sources hold one class only."""
    counts = metrics.confusion(fx.rated_sources(spark, sf_dir), ["client_id"])
    return metrics.evaluation_set_check(counts).select("client_id", "benign", "attack", "valid", "reason")


def tier_results(spark, sf_dir) -> DataFrame:
    """Long results with the quality tier in the role of the approach."""
    by_tier = metrics.evaluate(fx.agreement(spark, sf_dir), ["quality"]).withColumnRenamed("quality", "approach")
    return reports.melt_metrics(by_tier, ["approach"], RATES)


@query
def compare_approaches(spark, sf_dir):
    tiers = list(perturb.TIERS)
    return reports.compare_approaches(tier_results(spark, sf_dir), tiers).select("metric", *rounded_as(tiers))


@query
def ranked_approaches(spark, sf_dir):
    ranked = reports.ranked_by(reports.gap_to_best(tier_results(spark, sf_dir)), "accuracy")
    return ranked.select("approach", *rounded_as(["value", "best", "gap"]))


@query
def improvement(spark, sf_dir):
    better = reports.improvement(tier_results(spark, sf_dir), against="low", approach="medium")
    return better.select("metric", *rounded_as(["value", "baseline", "gap", "percent"]))


def trials(spark, sf_dir) -> DataFrame:
    """Every source and round is a trial of its tier."""
    table = round_metrics(spark, sf_dir).withColumnRenamed("quality", "variant")
    return reports.melt_metrics(table, ["variant", "client_id", "round"], ["accuracy", "f1_score", "precision", "recall"])


@query
def trial_stats(spark, sf_dir):
    stats = reports.trial_stats(trials(spark, sf_dir), ["variant", "metric"])
    return stats.select("variant", "metric", "n", *rounded_as(["mean", "std_pop", "std_sample", "min", "max", "range"]))


@query
def t_test(spark, sf_dir):
    tested = reports.two_sample_t(trials(spark, sf_dir), "medium", "low", with_p=False)
    return tested.select("metric", rounded("t", 4).alias("t"), "df")


@query
def t_test_significance(spark, sf_dir):
    tested = reports.two_sample_t(trials(spark, sf_dir), "medium", "low")
    return tested.select("metric", rounded("t", 4).alias("t"), "df", rounded("p_value", 9).alias("p_value"), "stars")


@query
def confidence_interval(spark, sf_dir):
    stats = reports.trial_stats(trials(spark, sf_dir), ["variant", "metric"])
    low, high = F.col("low"), F.col("high")
    found = reports.confidence_interval(stats)
    text = reports.percent_text(rounded("mean", 8), rounded("std_sample", 8))
    return found.select("variant", "metric", rounded(low).alias("low"), rounded(high).alias("high"), text.alias("text"))


@query
def best_config(spark, sf_dir):
    """Weighting settings ranked by the mean accuracy of sources under their weights."""
    latest = trust.latest_trust(agreement_history(spark, sf_dir))
    grid = reports.parameter_grid(latest, [{"beta": b} for b in BETAS])
    weighted = trust.trust_weights(grid, F.col("beta"), by=["beta"])
    accuracy = metrics.evaluate(fx.agreement(spark, sf_dir), ["client_id"]).select("client_id", "accuracy")
    scored = weighted.join(accuracy, "client_id").groupBy("beta").agg(
        F.round(F.sum(F.col("weight") * F.col("accuracy")), 6).alias("weighted_accuracy")
    )
    return reports.best_config(scored, "weighted_accuracy", 3, tie="beta").select("beta", rounded("weighted_accuracy").alias("weighted_accuracy"))


@query
def roc_curve(spark, sf_dir):
    points = metrics.roc_points(fx.weekly(spark, sf_dir))
    return points.select(rounded("threshold", 2).alias("threshold"), *longs(["tp", "fp"]), *rounded_as(["tpr", "fpr"]))


@query
def roc_auc(spark, sf_dir):
    auc = metrics.roc_auc(fx.weekly(spark, sf_dir))
    return auc.select(*longs(["points", "positives", "negatives"]), rounded("auc").alias("auc"))


# ---- trust -----------------------------------------------------------------------------


def observed_trust(spark, sf_dir) -> DataFrame:
    """Static trust per source and round: accuracy with the majority penalty."""
    table = round_metrics(spark, sf_dir)
    benign, attack = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    majority = metrics.ratio(F.greatest(benign, attack), benign + attack)
    return table.withColumn("computed", trust.static_trust(F.col("accuracy"), majority))


def agreement_history(spark, sf_dir) -> DataFrame:
    """Trust history of the agreement rounds, computed once."""
    observed = observed_trust(spark, sf_dir).select("client_id", "round", "computed")
    return sized(trust.adaptive_trust(observed)).table


@query
def trust_static(spark, sf_dir):
    """Rated documents: near-perfect accuracy on one-sided sources is penalised."""
    table = metrics.evaluate(fx.rated_sources(spark, sf_dir), ["client_id"])
    benign, attack = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    share = metrics.ratio(F.greatest(benign, attack), benign + attack)
    scored = table.withColumns({"majority_ratio": share, "trust": trust.static_trust(F.col("accuracy"), share)})
    return scored.select("client_id", *rounded_as(["accuracy", "majority_ratio", "trust"]))


@query
def signal_stability(spark, sf_dir):
    steady = trust.stability_signal(round_metrics(spark, sf_dir))
    return steady.select("client_id", *longs(["round"]), *rounded_as(["accuracy", "stability"]))


def adaptive_columns(history: DataFrame) -> DataFrame:
    return history.select(
        "client_id", *longs(["round"]), *rounded_as(["trust", "computed", "previous", "consistency"]), "event", "trend"
    )


@query
def trust_adaptive(spark, sf_dir):
    return adaptive_columns(agreement_history(spark, sf_dir))


@query
def trust_resumed(spark, sf_dir):
    """The adaptive history in two parts: rounds 1 to 4 are stored, later ones continue them."""
    observed = observed_trust(spark, sf_dir).select("client_id", "round", "computed")
    stored = sized(trust.adaptive_trust(observed.filter("round <= 4"))).table
    history = trust.adaptive_trust(observed, stored=stored)
    return adaptive_columns(history)


@query
def trust_replayed(spark, sf_dir):
    """A history made without some late rows of rounds 3 and 5, replayed when they have come."""
    rows = sized(fx.agreement(spark, sf_dir)).table
    late = F.col("round").isin(3, 5) & (F.crc32("row_id") % 4 == 0) & (F.crc32("client_id") % 2 == 0)

    def observed(part: DataFrame) -> DataFrame:
        table = metrics.evaluate(part, ["client_id", "round"])
        benign, attack = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
        share = metrics.ratio(F.greatest(benign, attack), benign + attack)
        return sized(table.select("client_id", "round", trust.static_trust(F.col("accuracy"), share).alias("computed"))).table

    history = sized(trust.adaptive_trust(observed(rows.filter(~late)))).table
    return adaptive_columns(trust.replayed(history, observed(rows)))


@query
def trust_smoothed(spark, sf_dir):
    """The variant whose first update is smoothed as well."""
    params = trust.TrustParams(alpha=0.5, first_update="smoothed")
    history = trust.adaptive_trust(observed_trust(spark, sf_dir).select("client_id", "round", "computed"), params)
    return history.select("client_id", *longs(["round"]), *rounded_as(["trust"]))


def daily_users(spark, sf_dir) -> DataFrame:
    """Accuracy of the value rule per user and day since the first event; users are idle on many days."""
    events = fx.table(spark, sf_dir, "events")
    first_day = events.select(F.min(F.to_date("ts"))).scalar()
    events = events.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("client_id"),
        (F.date_diff(F.to_date("ts"), first_day) + 1).alias("round"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y_true"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("y_pred"),
    )
    return metrics.evaluate(events, ["client_id", "round"]).select("client_id", "round", F.col("accuracy").alias("computed"))


@query
def trust_decay(spark, sf_dir):
    daily = daily_users(spark, sf_dir)
    spine = trust.round_spine(daily, 1, daily.select(F.max("round")).scalar())
    history = trust.adaptive_trust(spine, decay=True)
    return history.select("client_id", *longs(["round"]), "event", *rounded_as(["trust"]))


@query
def trust_drops(spark, sf_dir):
    history = trust.adaptive_trust(daily_users(spark, sf_dir))
    drops = trust.sudden_drops(history)
    return drops.select("client_id", *longs(["round"]), "type", *rounded_as(["magnitude", "previous_trust", "current_trust"]))


@query
def consistency_trend(spark, sf_dir):
    described = trust.consistency_and_trend(agreement_history(spark, sf_dir).select("client_id", "round", "trust"))
    return described.select("client_id", *longs(["round"]), *rounded_as(["consistency", "slope"]), "trend")


@query
def accuracy_trend(spark, sf_dir):
    """Consistency and trend of the validation accuracy."""
    table = round_metrics(spark, sf_dir).select("client_id", "round", "accuracy")
    described = trust.consistency_and_trend(table, "accuracy")
    return described.select("client_id", *longs(["round"]), *rounded_as(["consistency", "slope"]), "trend")


@query
def trend_counts(spark, sf_dir):
    evolved = trust.evolution(trust.adaptive_trust(daily_users(spark, sf_dir)))
    return trust.trend_counts(evolved)


@query
def trust_weights(spark, sf_dir):
    """Weights per round, with and without a trust floor."""
    history = agreement_history(spark, sf_dir).filter(F.col("round") > 0).select("client_id", "round", "trust")
    open_ = trust.trust_weights(history, 0.8, 0.0, ["round"]).withColumn("floor", F.lit("none"))
    strict = trust.trust_weights(history, 0.8, 0.99, ["round"]).withColumn("floor", F.lit("0.99"))
    equal = trust.equal_weights(history, ["round"]).withColumns({"fallback": F.lit(False), "floor": F.lit("equal")})
    merged = open_.unionByName(strict).unionByName(equal)
    return merged.select("client_id", *longs(["round"]), "floor", "fallback", *rounded_as(["trust", "weight"]))


@query
def trust_lookup(spark, sf_dir):
    """Latest trust on every row; sources that were never scored get the initial trust."""
    latest = trust.latest_trust(agreement_history(spark, sf_dir)).filter(F.col("trust") > 0.3)
    rows = fx.flows(spark, sf_dir).select("client_id", "row_id")
    return trust.trust_of(rows, latest).select("client_id", "row_id", rounded("trust").alias("trust"))


@query
def trust_latest(spark, sf_dir):
    latest = trust.latest_trust(agreement_history(spark, sf_dir))
    return latest.select("client_id", *longs(["round"]), *rounded_as(["trust"]))


@query
def trust_last_rounds(spark, sf_dir):
    recent = trust.last_rounds(agreement_history(spark, sf_dir), 3)
    return recent.select("client_id", *longs(["round"]), *rounded_as(["trust"]))


@query
def trust_ranking(spark, sf_dir):
    ranked = trust.ranking(agreement_history(spark, sf_dir))
    return ranked.select("client_id", *longs(["rank", "round"]), *rounded_as(["trust", "change"]), "direction")


@query
def trust_evolution(spark, sf_dir):
    evolved = trust.evolution(agreement_history(spark, sf_dir))
    numbers = ["initial_trust", "final_trust", "total_change", "percent_change", "avg_change", "max_increase", "max_decrease"]
    return evolved.select("client_id", *longs(["rounds"]), *rounded_as(numbers), "trend")


@query
def round_log(spark, sf_dir):
    table = sized(observed_trust(spark, sf_dir)).table
    history = trust.adaptive_trust(table.select("client_id", "round", "computed"))
    numbers = ["accuracy", "f1_score", "precision", "recall", "false_positive_rate", "trust_score"]
    return trust.round_log(table, history).select("client_id", *longs(["round"]), *rounded_as(numbers))


@query
def trust_summary(spark, sf_dir):
    history = agreement_history(spark, sf_dir)
    numbers = ["mean", "std", "min", "max", "median", "range"]
    return trust.trust_summary(history, ["round"]).select(*longs(["round", "count"]), *rounded_as(numbers), "heterogeneous")


@query
def trust_bands(spark, sf_dir):
    """Band counts of trust and accuracy over the daily users."""
    latest = trust.latest_trust(trust.adaptive_trust(daily_users(spark, sf_dir)))
    value = rounded("trust", 9)
    kinds = {"trust": trust.trust_band(value), "accuracy": trust.accuracy_band(value), "reliance": trust.reliance(value)}
    tables = [trust.band_counts(latest, band).withColumn("kind", F.lit(k)) for k, band in kinds.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).select("kind", "band", "sources")


@query
def trust_histogram(spark, sf_dir):
    latest = trust.latest_trust(trust.adaptive_trust(daily_users(spark, sf_dir))).withColumn("trust", rounded("trust", 9))
    bins = metrics.histogram(latest, "trust")
    return bins.select(*longs(["bin", "n"]), *rounded_as(["low", "high"]))


@query
def lambda_sweep(spark, sf_dir):
    """Fusion under several signal weights: one job for the whole grid."""
    names = ["w_accuracy", "w_stability", "w_drift", "w_uncertainty"]
    grid = [{"setting": i, **dict(zip(names, ws))} for i, ws in enumerate(LAMBDA_SETS)]
    signals = reports.parameter_grid(vector_signals(spark, sf_dir), grid)
    weights = {n[2:]: F.col(n) for n in names}
    score = trust.fused(F.col("f1_score"), F.col("stability"), F.col("drift"), F.col("uncertainty"), weights)
    return signals.select("client_id", *longs(["round", "setting"]), rounded(score).alias("trust"))


@query
def beta_sweep(spark, sf_dir):
    latest = trust.latest_trust(agreement_history(spark, sf_dir))
    grid = [{"beta": b, "floor": t} for b in BETAS for t in THRESHOLDS]
    rows = reports.parameter_grid(latest, grid)
    rows = rows.withColumn("trust", F.when(F.col("trust") >= F.col("floor"), F.col("trust")).otherwise(F.lit(0.0)))
    weighted = trust.trust_weights(rows, F.col("beta"), by=["beta", "floor"])
    return weighted.select("client_id", "beta", "floor", *rounded_as(["trust", "weight"]))


@query
def history_documents(spark, sf_dir):
    """History to nested JSON documents and back."""
    history = agreement_history(spark, sf_dir)
    ts = F.concat((F.col("round") + 1994).cast("string"), F.lit("-12-31T00:00:00"))
    back = hist.from_documents(hist.to_documents(hist.with_metrics(history, ts)))
    return back.select(
        "client_id", *longs(["round"]), rounded("trust").alias("trust"), "ts",
        rounded("metrics.validation_accuracy").alias("validation_accuracy"),
        rounded("metrics.consistency_score").alias("consistency_score"), F.col("metrics.trend").alias("trend"),
    )


@query
def resume_point(spark, sf_dir):
    """The stored row from which each source continues."""
    ts = F.concat((F.col("round") + 1994).cast("string"), F.lit("-12-31T00:00:00"))
    stored = hist.with_metrics(agreement_history(spark, sf_dir), ts)
    return hist.resume_point(stored).select("client_id", *longs(["round"]), rounded("trust").alias("trust"), "ts", "event")


@query
def history_repeated(spark, sf_dir):
    """A history table written in parts that overlap, the last one twice."""
    ts = F.concat((F.col("round") + 1994).cast("string"), F.lit("-12-31T00:00:00"))
    rows = sized(hist.with_metrics(agreement_history(spark, sf_dir), ts)).table
    path = f"{new_folder(spark, 'history')}/rounds"
    for part in ("round <= 4", "round >= 3", "round >= 3"):
        hist.write_history(rows.filter(part), path)
    return hist.read_history(spark, path).select("client_id", *longs(["round"]), rounded("trust").alias("trust"), "event")


@query
def initialise(spark, sf_dir):
    """Round-0 rows for sources without a history."""
    sources = fx.flows(spark, sf_dir).select("client_id")
    known = trust.latest_trust(agreement_history(spark, sf_dir)).filter(F.col("trust") > 0.5)
    new = trust.initial_history(sources, known)
    return new.select("client_id", *longs(["round"]), "trust")


@query
def source_trust(spark, sf_dir):
    """Flagship: quality, final trust, weight and row quota per source."""
    quotas = demand_weights(spark, sf_dir)
    quality = fx.tiers(fx.flows(spark, sf_dir))
    return quotas.join(quality, "client_id").select(
        "client_id", "quality", *rounded_as(["trust", "weight"]), "fallback", *longs(["quota"])
    )


# ---- models on vectors -----------------------------------------------------------------


def centroid_models(df: DataFrame, by: list[str]) -> DataFrame:
    """Linear model per group: the hyperplane half-way between the two class means."""
    parts = df.select(*by, "label", F.posexplode("x").alias("pos", "v"))
    at = lambda c: F.avg(F.when(F.col("label") == c, F.col("v")))
    means = parts.groupBy(*by, "pos").agg(at(0).alias("m0"), at(1).alias("m1"))
    means = means.withColumns({"w": F.col("m1") - F.col("m0"), "b": (F.col("m0") ** 2 - F.col("m1") ** 2) / 2})
    both = means.groupBy(*by).agg(models.in_order("pos", "w").alias("coef"), F.sum("b").alias("intercept"), F.count("w").alias("_n"))
    return sized(both.filter(F.col("_n") > 0).drop("_n")).table


def unrolled(table: DataFrame, keys: list[str]) -> DataFrame:
    """Model parameters one per row; the intercept has position -1."""
    parts = table.select(*keys, F.posexplode("coef").alias("pos", "value"))
    bias = table.select(*keys, F.lit(-1).alias("pos"), F.col("intercept").alias("value"))
    return parts.unionByName(bias).select(*keys, *longs(["pos"]), rounded("value").alias("value"))


@query
def linear_score(spark, sf_dir):
    df = fx.vectors(spark, sf_dir)
    scored = models.score_linear(df, centroid_models(df, ["client_id"]), ["client_id"])
    return scored.select("client_id", "row_id", "label", rounded("y_proba").alias("y_proba"), "y_pred")


@query
def linear_evaluation(spark, sf_dir):
    """One averaged model evaluated on the rows of every source."""
    df = fx.vectors(spark, sf_dir)
    shared = models.average_models(centroid_models(df, ["client_id"]))
    scored = models.score_linear(df.withColumn("y_true", F.col("label")), shared)
    table = metrics.evaluate(scored, ["client_id"])
    return table.select("client_id", "tn", "fp", "fn", "tp", *rounded_as(["accuracy", "f1_score"]))


def vector_weights(df: DataFrame) -> DataFrame:
    """Centroid models with weights from the accuracy on their own rows."""
    fitted = centroid_models(df, ["client_id"])
    scored = models.score_linear(df.withColumn("y_true", F.col("label")), fitted, ["client_id"])
    accuracy = metrics.evaluate(scored, ["client_id"]).select("client_id", F.col("accuracy").alias("trust"))
    return fitted.join(trust.trust_weights(accuracy), "client_id")


@query
def ensemble_vote(spark, sf_dir):
    df = fx.vectors(spark, sf_dir)
    scored = models.ensemble_score(df, vector_weights(df))
    return scored.select("client_id", "row_id", rounded("y_proba").alias("y_proba"), "y_pred")


@query
def param_average(spark, sf_dir):
    return unrolled(models.average_models(vector_weights(fx.vectors(spark, sf_dir)), "weight"), [])


@query
def param_average_equal(spark, sf_dir):
    df = fx.vectors(spark, sf_dir)
    return unrolled(models.average_models(centroid_models(df, ["client_id", "round"]), by=["round"]), ["round"])


@query
def importance_average(spark, sf_dir):
    """Mean |coefficient| per feature under trust weights."""
    weighted = vector_weights(fx.vectors(spark, sf_dir))
    weighted = weighted.withColumn("feature_importances", F.transform("coef", lambda w: F.abs(w)))
    mean = models.average_importances(weighted, "weight")
    return mean.select(F.posexplode("feature_importances").alias("pos", "value")).select(
        *longs(["pos"]), rounded("value").alias("value")
    )


@query
def param_median(spark, sf_dir):
    df = fx.vectors(spark, sf_dir)
    return unrolled(models.median_models(centroid_models(df, ["client_id", "round"])), [])


@query
def signal_drift(spark, sf_dir):
    table = trust.drift_signal(centroid_models(fx.vectors(spark, sf_dir), ["client_id", "round"]))
    return table.select("client_id", *longs(["round"]), rounded("drift").alias("drift"))


def vector_signals(spark, sf_dir) -> DataFrame:
    """All four signals per source and round of the vectors."""
    df = fx.vectors(spark, sf_dir)
    fitted = centroid_models(df, ["client_id", "round"])
    scored = models.score_linear(df.withColumn("y_true", F.col("label")), fitted, ["client_id", "round"])
    entropy = scored.groupBy("client_id", "round").agg(F.avg(binary_entropy(F.col("y_proba"))).alias("entropy"))
    table = trust.stability_signal(metrics.evaluate(scored, ["client_id", "round"]))
    drift = trust.drift_signal(fitted).select("client_id", "round", "drift")
    joined = table.join(drift, ["client_id", "round"]).join(entropy, ["client_id", "round"])
    return joined.withColumn("uncertainty", trust.confidence(F.col("entropy")))


@query
def signal_entropy(spark, sf_dir):
    table = vector_signals(spark, sf_dir)
    return table.select("client_id", *longs(["round"]), *rounded_as(["entropy", "uncertainty"]))


@query
def fusion(spark, sf_dir):
    table = vector_signals(spark, sf_dir)
    score = trust.fused(F.col("f1_score"), F.col("stability"), F.col("drift"), F.col("uncertainty"))
    numbers = ["f1_score", "stability", "drift", "uncertainty"]
    return table.select("client_id", *longs(["round"]), *rounded_as(numbers), rounded(score).alias("trust"))


@query
def multi_signal_trust(spark, sf_dir):
    """Adaptive trust over fused signals."""
    score = trust.fused(F.col("f1_score"), F.col("stability"), F.col("drift"), F.col("uncertainty"))
    observed = vector_signals(spark, sf_dir).select("client_id", "round", score.alias("computed"))
    history = trust.adaptive_trust(observed, trust.TrustParams(alpha=0.5))
    return history.select("client_id", *longs(["round"]), *rounded_as(["trust"]))


@query
def constant_model(spark, sf_dir):
    """Sources that show one class only: each embedding label as its own source."""
    df = fx.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("client_id"), F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("label") < 5, 0).otherwise(1).alias("label"),
    )
    constant = models.single_class_sources(df)
    return constant.select(
        "client_id", *longs(["n"]), "intercept", F.aggregate("coef", F.lit(0.0), lambda s, v: s + F.abs(v)).alias("norm"),
        F.size("coef").cast("bigint").alias("width"), "constant",
    )


@query
def local_fit(spark, sf_dir):
    """One descent-fitted model per source, evaluated on the source's validation rows."""
    split = sample.split_stratified(fx.vectors(spark, sf_dir), 0.2, fx.SEED)
    train, val = split.filter("split = 'train'"), split.filter("split = 'val'")
    fitted = sized(models.fit_sources(train, seed=fx.SEED)).table
    scored = models.score_linear(val.withColumn("y_true", F.col("label")), fitted, ["client_id"])
    table = metrics.evaluate(scored, ["client_id"]).join(models.training_metrics(train, fitted), "client_id")
    return table.select("client_id", *rounded_as(["accuracy", "f1_score", "train_accuracy", "train_f1"]))


@query
def prox_rounds(spark, sf_dir):
    return unrolled(models.proximal_rounds(fx.vectors(spark, sf_dir), rounds=3, seed=fx.SEED), [])


@query
def median_rounds(spark, sf_dir):
    return unrolled(models.median_rounds(fx.vectors(spark, sf_dir), rounds=3, seed=fx.SEED), [])


def round_history(spark, sf_dir) -> DataFrame:
    """Trust history of one centroid model per source and round."""
    df = fx.vectors(spark, sf_dir)
    measured = retraining.measured_rounds(df, centroid_models(df, ["client_id", "round"]))
    return trust.adaptive_trust(measured.select("client_id", "round", "computed"))


@query
def multi_round_weights(spark, sf_dir):
    """Weights and row quotas after all rounds; sources below a trust of 0.6 are left out."""
    quotas = retraining.retrain_quotas(round_history(spark, sf_dir), cap=CAP, base=CAP)
    return quotas.select("client_id", *rounded_as(["trust", "weight"]), "fallback", *longs(["quota"]))


@query
def multi_round_retrain(spark, sf_dir):
    """Local fits of all sources and rounds, their trust, and the retrain on the rows it allows."""
    split = sample.split_stratified(fx.vectors(spark, sf_dir), 0.2, fx.SEED)
    train, val = split.filter("split = 'train'"), split.filter("split = 'val'")
    measured = retraining.measured_rounds(val, sized(retraining.fit_rounds(train)).table)
    history = sized(trust.adaptive_trust(measured.select("client_id", "round", "computed"))).table
    model = models.fit_global(retraining.retrain_rows(train, history, seed=fx.SEED), seed=fx.SEED)
    scored = models.score_global(model, val.withColumn("y_true", F.col("label")))
    quotas = retraining.retrain_quotas(history).select("client_id", "weight", *longs(["quota"]))
    table = metrics.evaluate(scored, ["client_id"]).join(quotas, "client_id")
    return table.select("client_id", *rounded_as(["accuracy", "f1_score", "weight"]), "quota")


# ---- trees per source ------------------------------------------------------------------

EDGES = [[10.0, 20.0, 30.0, 40.0], [10000.0, 20000.0, 30000.0, 40000.0, 50000.0], [0.015, 0.035, 0.055, 0.075], [0.015, 0.035, 0.055]]


def flow_vectors(spark, sf_dir) -> DataFrame:
    """Flows with their four features as an array."""
    return fx.flows(spark, sf_dir).select("client_id", "row_id", "label", F.array(*[F.col(c).cast("double") for c in fx.FEATURES]).alias("x"))


@query
def source_stumps(spark, sf_dir):
    """The best single split of every source on given borders."""
    whole = forests.Growth(trees=1, depth=1, bagging=False, seed=fx.SEED)
    trees = forests.fit_forests(flow_vectors(spark, sf_dir), whole, EDGES)
    return trees.select(
        "client_id", *longs(["level", "node", "feature", "bin", "n"]), rounded("threshold").alias("threshold"),
        rounded("value").alias("value"), rounded("gain").alias("gain"),
    )


@query
def source_forests(spark, sf_dir):
    """A forest per source, measured on its held-out rows."""
    split = sample.split_stratified(flow_vectors(spark, sf_dir), 0.2, fx.SEED)
    trees = forests.fit_forests(split.filter("split = 'train'"), forests.Growth(trees=5, depth=4, features=2, seed=fx.SEED), bins=16)
    scored = forests.score_forests(split.filter("split = 'val'").withColumn("y_true", F.col("label")), sized(trees).table)
    return metrics.evaluate(scored, ["client_id"]).select("client_id", *rounded_as(["accuracy", "f1_score"]))


@query
def source_boosted(spark, sf_dir):
    """Boosted trees per source, measured on its held-out rows."""
    split = sample.split_stratified(flow_vectors(spark, sf_dir), 0.2, fx.SEED)
    trees = forests.fit_boosted(split.filter("split = 'train'"), 2, 0.3, forests.Growth("newton", 1, 3, 4, None, False), bins=16)
    scored = forests.score_forests(split.filter("split = 'val'").withColumn("y_true", F.col("label")), sized(trees).table, boosted=True)
    return metrics.evaluate(scored, ["client_id"]).select("client_id", *rounded_as(["accuracy", "f1_score"]))


@query
def forest_importances(spark, sf_dir):
    """Feature importances of the sources' forests, averaged by trust."""
    trees = forests.fit_forests(flow_vectors(spark, sf_dir), forests.Growth(trees=3, depth=3, bagging=False, seed=fx.SEED), EDGES)
    weights = trust.trust_weights(trust.latest_trust(agreement_history(spark, sf_dir))).select("client_id", "weight")
    mean = models.average_importances(forests.importances(trees, len(fx.FEATURES)).join(weights, "client_id"), "weight")
    return mean.select(F.posexplode("feature_importances").alias("feature", "importance")).select(
        *longs(["feature"]), rounded("importance").alias("importance")
    )


def fitted_metrics(spark, sf_dir, kind: str, **settings) -> DataFrame:
    """A global fit on trust-weighted quota rows, evaluated on all validation rows."""
    split = sample.split_stratified(fx.vectors(spark, sf_dir), 0.2, fx.SEED)
    train, val = split.filter("split = 'train'"), split.filter("split = 'val'")
    weights = vector_weights(train).select("client_id", "trust", "weight")
    rows = sample.quota_sample(train, sample.weight_quotas(weights), fx.SEED)
    model = models.fit_global(rows, kind, fx.SEED, **settings)
    scored = models.score_global(model, val.withColumn("y_true", F.col("label")))
    return metrics.evaluate(scored, ["client_id"]).select("client_id", *rounded_as(["accuracy", "f1_score"]))


@query
def global_fit_logistic(spark, sf_dir):
    return fitted_metrics(spark, sf_dir, "logistic_regression")


@query
def global_fit_forest(spark, sf_dir):
    return fitted_metrics(spark, sf_dir, "random_forest")


@query
def global_fit_boosted(spark, sf_dir):
    return fitted_metrics(spark, sf_dir, "boosted_trees")


@query
def global_fit_perceptron(spark, sf_dir):
    return fitted_metrics(spark, sf_dir, "mlp")


@query
def rectified_perceptron(spark, sf_dir):
    """A perceptron with rectified units and early stopping, measured on every source's held-out rows."""
    split = sample.split_stratified(flow_vectors(spark, sf_dir), 0.2, fx.SEED)
    scale = F.transform("x", lambda v, i: v / F.element_at(F.array(*[F.lit(n) for n in (50.0, 1e5, 0.1, 0.08)]), i + 1))
    train, val = (split.filter(F.col("split") == part).withColumn("x", scale) for part in ("train", "val"))
    model = perceptron.fit_perceptron(train, perceptron.Settings(hidden=16, rate=0.02, epochs=15, patience=4, seed=fx.SEED))
    scored = perceptron.score_perceptron(val.withColumn("y_true", F.col("label")), model)
    return metrics.evaluate(scored, ["client_id"]).select("client_id", *rounded_as(["accuracy", "f1_score"], 3))


@query
def approach_comparison(spark, sf_dir):
    """Five ways of training compared on the same held-out rows: pooled, equal-weight, trust-weighted,
    proximal rounds and rounds of the coordinate median."""
    split = sample.split_stratified(fx.vectors(spark, sf_dir), 0.2, fx.SEED)
    train, val = split.filter("split = 'train'"), split.filter("split = 'val'")
    weights = vector_weights(train).select("client_id", "trust", "weight")
    sets = {
        "centralized": train,
        "equal_weight": sample.bootstrap_capped(train, seed=fx.SEED),
        "trust_weighted": sample.quota_sample(train, sample.weight_quotas(weights), fx.SEED),
    }
    truth = val.withColumn("y_true", F.col("label"))
    tables = [
        metrics.evaluate(models.score_global(models.fit_global(rows, seed=fx.SEED), truth), []).withColumn("approach", F.lit(name))
        for name, rows in sets.items()
    ]
    shared = {
        "proximal": models.proximal_rounds(train, rounds=3, seed=fx.SEED),
        "median": models.median_rounds(train, rounds=3, seed=fx.SEED),
    }
    tables += [
        metrics.evaluate(models.score_linear(truth, model), []).withColumn("approach", F.lit(name))
        for name, model in shared.items()
    ]
    merged = functools.reduce(DataFrame.unionByName, tables)
    return reports.melt_metrics(merged, ["approach"], RATES).select("approach", "metric", rounded("value").alias("value"))


# ---- logs and result documents ---------------------------------------------------------

LOG_TITLES = {"accuracy": "Accuracy", "f1_score": "F1 Score", "precision": "Precision", "recall": "Recall"}


def run_logs(spark, sf_dir) -> DataFrame:
    """A printed log per source: trial summary lines, a comparison table, a test accuracy."""
    table = round_metrics(spark, sf_dir)
    moments = {f"{f}_{m}": fn(m) for m in LOG_TITLES for f, fn in (("lo", F.min), ("mid", F.avg), ("hi", F.max), ("sd", F.stddev_pop))}
    per = table.groupBy("client_id").agg(*[F.round(c, 4).alias(n) for n, c in moments.items()])
    lines = [F.lit("Approach 3: weighted"), F.format_string("Test Accuracy: %.4f", "mid_accuracy")]
    for m, title in LOG_TITLES.items():
        sd = F.col(f"sd_{m}")
        lines.append(F.format_string(f"{title}   %.4f±%.4f  %.4f±%.4f  %.4f±%.4f", f"lo_{m}", sd, f"mid_{m}", sd, f"hi_{m}", sd))
    lines.append(F.lit("RESULTS COMPARISON"))
    lines.append(F.format_string("Accuracy  %.4f %.4f %.4f", "lo_accuracy", "mid_accuracy", "hi_accuracy"))
    lines.append(F.format_string("F1-Score  %.4f %.4f %.4f", "lo_f1_score", "mid_f1_score", "hi_f1_score"))
    return per.select("client_id", F.concat_ws("\n", *lines).alias("log"))


@query
def log_metrics(spark, sf_dir):
    found = res.trial_summaries(run_logs(spark, sf_dir), "log", ["client_id"])
    return found.select("client_id", "approach", "metric", rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"))


@query
def log_comparison(spark, sf_dir):
    logs = sized(run_logs(spark, sf_dir)).table
    rows = res.comparison_rows(logs, "log", ["client_id"])
    tests = logs.select("client_id", F.lit("test").alias("approach"), F.lit("accuracy").alias("metric"), res.test_accuracy(F.col("log")).alias("value"))
    return rows.unionByName(tests).select("client_id", "approach", "metric", rounded("value", 4).alias("value"))


@query
def log_files(spark, sf_dir):
    """Logs and results written as files and read again: the row of the trust-weighted approach, and its accuracy."""
    per = round_metrics(spark, sf_dir).groupBy("client_id").agg(
        F.round(F.min("accuracy"), 4).alias("lo"), F.round(F.avg("accuracy"), 4).alias("mid"), F.round(F.max("accuracy"), 4).alias("hi")
    )
    odd = F.regexp_extract("client_id", r"(\d+)$", 1).cast("int") % 2 == 1
    row = F.when(odd, F.format_string("Trust-Aware accuracy %.4f %.4f %.4f", "lo", "mid", "hi")).otherwise(F.format_string("Trust-Aware   %.4f", "mid"))
    text = F.concat_ws("\n", F.lit("Trust-Aware accuracy 0.1 0.2"), F.lit("RESULTS COMPARISON"), F.lit("Metric  Centralized  Equal  Weighted"), F.lit("Trust-Aware share 1.5 2.5"), row, F.format_string("Trust-Aware  %.4f", "mid"))
    folder = new_folder(spark, "logs")
    per = sized(per).table
    per.select("client_id", text.alias("value")).repartition("client_id").write.partitionBy("client_id").text(f"{folder}/logs")
    res.write_results(per.select("client_id", F.lit("trust_weighted").alias("approach"), F.lit("accuracy").alias("metric"), F.col("mid").alias("value")), f"{folder}/results")
    logs = res.read_logs(spark, f"{folder}/logs/*")
    found = logs.select(F.regexp_extract("file", "client_id=([^/]+)", 1).alias("client_id"), res.trust_row(F.col("log")).alias("table_row"), res.trust_number(F.col("log")).alias("first_number"))
    stored = spark.read.json(f"{folder}/results").select("client_id", F.col("value").alias("stored"))
    return found.join(stored, "client_id").select("client_id", *rounded_as(["table_row", "first_number", "stored"], 4))


@query
def result_scan(spark, sf_dir):
    """JSON result documents of every source and round; those of low tiers are cut short."""
    table = round_metrics(spark, sf_dir)
    body = F.struct("accuracy", "f1_score", "precision", "recall")
    text = F.to_json(F.create_map(F.lit("centralized"), body, F.lit("trust_aware"), body))
    cut = F.when(F.col("quality") == "low", F.expr("substring(doc, 1, length(doc) - 40)")).otherwise(F.col("doc"))
    docs = table.withColumn("doc", text).withColumn("doc", cut).select("client_id", "round", "doc")
    found = res.parse_results(docs, "doc", ["client_id", "round"])
    return found.select("client_id", *longs(["round"]), "approach", "metric", rounded("value").alias("value"))


# ---- streams ---------------------------------------------------------------------------


def streamed(spark, sf_dir, source: str) -> DataFrame:
    return fx.predictions(rounds.read_events(spark, sf_dir, "events.parquet"), source)


def metric_columns() -> list[Column]:
    return [F.col("window_end").cast("timestamp_ntz").alias("window_end"), *longs(["tn", "fp", "fn", "tp"]), *rounded_as(["accuracy", "f1_score"])]


@query
def stream_round_metrics(spark, sf_dir):
    """Weekly metrics of closed windows, by a stream over the events."""
    table = rounds.run_stream(rounds.round_metrics(streamed(spark, sf_dir, "client")), "weekly")
    return table.select("client_id", *metric_columns())


@query
def batch_round_metrics(spark, sf_dir):
    """The batch twin of `stream_round_metrics`."""
    events = fx.weekly(spark, sf_dir)
    return rounds.closed_windows(rounds.round_metrics(events), events).select("client_id", *metric_columns())


@query
def stream_trust(spark, sf_dir):
    """Daily trust of every user with decay on idle days, by a stateful stream."""
    stream = rounds.trust_stream(streamed(spark, sf_dir, "user"), window="1 day", window_ms=rounds.DAY_MS)
    table = rounds.run_stream(stream, "trust")
    return table.select(
        "client_id", F.col("window_end").cast("timestamp_ntz").alias("window_end"), *longs(["round"]), "event",
        *rounded_as(["trust"]), "alert",
    )


@query
def stream_resumed(spark, sf_dir):
    """Daily trust by a stream that is given up half-way and run again from its stored history."""
    events = streamed(spark, sf_dir, "user")
    half = fx.table(spark, sf_dir, "events").select(F.timestamp_millis(((F.unix_millis(F.min("ts").cast("timestamp")) + F.unix_millis(F.max("ts").cast("timestamp"))) / 2).cast("long"))).first()[0]
    path = f"{new_folder(spark, 'trust-history')}/rounds"
    settings = {"window": "1 day", "window_ms": rounds.DAY_MS}
    first = rounds.run_history(rounds.trust_stream(events.filter(F.col("ts") < F.lit(half)), **settings), path)
    table = rounds.run_history(rounds.trust_stream(events, stored=first, **settings), path)
    return table.select(
        "client_id", F.col("window_end").cast("timestamp_ntz").alias("window_end"), *longs(["round"]), "event",
        *rounded_as(["trust"]), "alert",
    )
