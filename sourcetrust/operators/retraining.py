"""Trust over several rounds, and the retrain that it leads to.

No loop over rounds: the models of all sources and rounds are fitted in one job, measured in one
aggregate, and the trust of all rounds is one fold. Its last row gives weights, quotas and rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sourcetrust.operators import metrics, models, sample, trust

MIN_TRUST = 0.6  # fixed value: sources below it are left out of the retrain


def fit_rounds(
    df: DataFrame, source: str = "client_id", round_: str = "round", label: str = "label", key: str = "row_id", **settings
) -> DataFrame:
    """One linear model per source and round: source, round, coef, intercept, n, constant."""
    unit = F.to_json(F.struct(F.col(source).alias("s"), F.col(round_).alias("r")))
    units = df.select(source, round_, unit.alias("_unit"))
    fitted = models.fit_sources(df.withColumn("_unit", unit), "_unit", label, key, **settings)
    return units.distinct().join(fitted, "_unit").drop("_unit")


def measured_rounds(
    rows: DataFrame, fitted: DataFrame, source: str = "client_id", round_: str = "round", label: str = "label"
) -> DataFrame:
    """Confusion, rates and static trust (`computed`) of every source and round on its validation rows.

    A source and round without a model has trust 0.1.
    """
    scored = models.score_linear(rows.withColumn("y_true", F.col(label)), fitted, [source, round_])
    table = metrics.evaluate(scored, [source, round_])
    benign, attack = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    share = metrics.ratio(F.greatest(benign, attack), benign + attack)
    every = rows.select(source, round_).distinct()
    return every.join(table.withColumn("_share", share), [source, round_], "left").withColumn(
        "computed", trust.static_trust(F.col("accuracy"), F.col("_share"))
    ).drop("_share")


def retrain_quotas(
    history: DataFrame, beta: float = 0.8, min_trust: float = MIN_TRUST, cap: int | None = sample.CAP, base: int = sample.CAP,
    source: str = "client_id",
) -> DataFrame:
    """source, trust, weight, fallback, quota from the last round of a trust history."""
    weights = trust.trust_weights(trust.latest_trust(history), beta, min_trust)
    return sample.weight_quotas(weights, cap, base, source).select(source, "trust", "weight", "fallback", "quota")


def retrain_rows(
    train: DataFrame, history: DataFrame, beta: float = 0.8, min_trust: float = MIN_TRUST, seed: int = 42,
    source: str = "client_id", label: str = "label", key: str = "row_id", cap: int | None = sample.CAP,
) -> DataFrame:
    """The rows of the retrain: every source's quota by its final trust, stratified; rejected sources give none."""
    return sample.quota_sample(train, retrain_quotas(history, beta, min_trust, cap, source=source), seed, source, label, key)
