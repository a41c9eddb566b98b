"""Per-source and global models, parameter aggregation and scoring.

A linear model is a row: `coef ARRAY<DOUBLE>`, `intercept DOUBLE`. Rows carry features as
an array column `x`. Scoring is Catalyst only; Python runs in one place, the mini-batch
descent on a bounded number of one source's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from sourcetrust.functions.keys import hash_hex
from sourcetrust.functions.vectors import dot, linear_probability, sigmoid
from sourcetrust.operators import deep_forests
from sourcetrust.operators.joins import MAX_BROADCAST_CELLS, lookup_join, sized
from sourcetrust.operators.ordering import global_prefix_sum
from sourcetrust.operators.picking import mark_first, medians
from sourcetrust.operators.metrics import evaluate
from sourcetrust.operators.sample import CAP, bootstrap_capped

FIT_ROWS = 100_000  # labelled rows of a source that its descent reads, at most
PROBABILITY_UNITS = 10**15
CONSTANT_INTERCEPT = 50.0

# fixed values: settings of the local descent
LEARNING_RATE, LOCAL_EPOCHS, BATCH_SIZE = 0.05, 2, 1024
PROXIMAL_MU = 1e-3


def descend(
    x: np.ndarray, y: np.ndarray, start: np.ndarray, lr: float, epochs: int, batch: int, seed: int, mu: float = 0.0
) -> np.ndarray:
    """Mini-batch logistic descent from `start` (intercept last), pulled to it by `mu`.

    Rows arrive in hash order; each epoch visits them in a seeded permutation.
    """
    design = np.hstack([x, np.ones((len(x), 1))])
    pull = np.full(design.shape[1], mu)
    pull[-1] = 0.0
    theta = start.astype(float).copy()
    rng = np.random.default_rng(seed)
    for _ in range(max(1, epochs)):
        order = rng.permutation(len(design))
        for chunk in np.array_split(order, range(batch, len(order), batch)):
            p = 1.0 / (1.0 + np.exp(-np.clip(design[chunk] @ theta, -50.0, 50.0)))
            theta -= lr * (design[chunk].T @ (p - y[chunk]) / len(chunk) + pull * (theta - start))
    return theta


def _descend_sources(
    df: DataFrame, source: str, label: str, key: str, start: np.ndarray | None, lr, epochs, batch, seed, mu, fit_rows
) -> DataFrame:
    """One descent per source on its first `fit_rows` rows in hash order: `source, n, theta`; `n` counts all rows."""
    keyed = df.select(source, F.col(label).alias("_y"), "x", hash_hex(seed, F.col(key)).alias("_key"))
    quotas = sized(
        df.groupBy(source).agg(F.count("*").alias("n")).withColumn("quota", F.least("n", F.lit(fit_rows).cast("bigint"))),
        F.when(F.col("quota") < F.col("n"), F.col("n")),
    )
    placed = mark_first(keyed, [source], "_key", quotas, "_fit").filter("_fit").select(source, "_key", "_y", "x")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_key")
        x = np.stack(group["x"].to_numpy()).astype(float)
        first = np.zeros(x.shape[1] + 1) if start is None else start
        theta = descend(x, group["_y"].to_numpy(float), first, lr, epochs, batch, seed, mu)
        return pd.DataFrame({source: [group[source].iloc[0]], "theta": [theta.tolist()]})

    kind = dict(df.dtypes)[source]
    fitted = placed.groupBy(source).applyInPandas(fit, f"{source} {kind}, theta array<double>")
    return fitted.join(quotas.table.select(source, F.col("n").cast("double").alias("n")), source)


def average_vectors(table: DataFrame, by: list[str], vector: str, weight: str) -> DataFrame:
    """Element-wise weighted mean of a vector column per group; `n` sums the weights."""
    parts = table.select(*by, F.col(weight).cast("double").alias("_w"), F.posexplode(vector).alias("_pos", "_v"))
    means = parts.groupBy(*by, "_pos").agg(
        (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_v"), F.sum("_w").alias("_w")
    )
    return means.groupBy(*by).agg(in_order("_pos", "_v").alias(vector), F.max("_w").alias(weight))


def in_order(position: str, value: str) -> Column:
    """The values of a group as an array ordered by position."""
    return F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda e: e[value])


def fit_sources(
    df: DataFrame,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    lr: float = LEARNING_RATE,
    epochs: int = LOCAL_EPOCHS,
    batch: int = BATCH_SIZE,
    seed: int = 42,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One linear model per source: `source, coef, intercept, n, constant`.

    A source with a single class gets a constant model. A descent reads the first `fit_rows` rows of its
    source in hash order, by one path at every size; `n` counts all rows.
    """
    classes = sized(df.groupBy(source).agg(
        F.count("*").alias("n"), F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.max(F.size("x")).alias("_d")
    ))
    mixed = classes.derive(classes.table.filter(F.col("_lo") != F.col("_hi")).select(source))
    fitted = _descend_sources(
        lookup_join(df, mixed, [source], "left_semi"), source, label, key, None, lr, epochs, batch, seed, 0.0, fit_rows
    )
    learned = fitted.select(source, *_split_theta(), F.col("n").cast("bigint").alias("n"), F.lit(False).alias("constant"))
    single = classes.table.filter(F.col("_lo") == F.col("_hi"))
    return learned.unionByName(constant_models(single, source))


def constant_models(single: DataFrame, source: str = "client_id") -> DataFrame:
    """Models that always predict the one class seen: zero coefficients, saturated intercept."""
    return single.select(
        source,
        F.array_repeat(F.lit(0.0), F.col("_d")).alias("coef"),
        F.when(F.col("_lo") == 1, F.lit(CONSTANT_INTERCEPT)).otherwise(F.lit(-CONSTANT_INTERCEPT)).alias("intercept"),
        "n",
        F.lit(True).alias("constant"),
    )


def single_class_sources(df: DataFrame, source: str = "client_id", label: str = "label") -> DataFrame:
    """Constant models for the sources that show one class only."""
    classes = df.groupBy(source).agg(
        F.count("*").alias("n"), F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.max(F.size("x")).alias("_d")
    )
    return constant_models(classes.filter(F.col("_lo") == F.col("_hi")), source)


def _split_theta() -> list[Column]:
    return [F.expr("slice(theta, 1, size(theta) - 1)").alias("coef"), F.element_at("theta", -1).alias("intercept")]


def _join_models(df: DataFrame, models: DataFrame, on: list[str]) -> DataFrame:
    known = sized(models, F.size("coef"))
    return lookup_join(df, known, on, "inner", MAX_BROADCAST_CELLS // max(1, known.largest))


def score_linear(df: DataFrame, models: DataFrame, on: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Add `y_proba` and `y_pred` from the model matched by `on`, or from the only model."""
    params = models.select(*(on or []), "coef", "intercept")
    if on:
        joined = _join_models(df, params, on)
    else:
        only = params.select(F.struct("coef", "intercept")).scalar()  # d + 1 numbers
        joined = df.withColumn("_m", only).withColumns({"coef": F.col("_m.coef"), "intercept": F.col("_m.intercept")}).drop("_m")
    scored = joined.withColumn("y_proba", linear_probability(F.col("x"), F.col("coef"), F.col("intercept")))
    return scored.withColumn("y_pred", F.when(F.col("y_proba") >= threshold, 1).otherwise(0)).drop("coef", "intercept")


def training_metrics(df: DataFrame, models: DataFrame, source: str = "client_id", label: str = "label") -> DataFrame:
    """Accuracy and F1 of each source's model on its own rows; constant models report 0.5 and 0."""
    scored = score_linear(df.withColumn("y_true", F.col(label)), models, [source])
    measured = evaluate(scored, [source]).join(models.select(source, "constant"), source)
    return measured.select(
        source,
        F.when(F.col("constant"), F.lit(0.5)).otherwise(F.col("accuracy")).alias("train_accuracy"),
        F.when(F.col("constant"), F.lit(0.0)).otherwise(F.col("f1_score")).alias("train_f1"),
    )


def average_models(models: DataFrame, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Element-wise mean of coefficients and intercept, weighted or equal."""
    by = by or []
    theta = models.withColumn("theta", F.concat("coef", F.array("intercept")))
    theta = theta.withColumn("_weight", F.col(weight) if weight else F.lit(1.0))
    return average_vectors(theta, by, "theta", "_weight").select(*by, *_split_theta())


def average_importances(models: DataFrame, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Element-wise mean of a feature-importance column; equal weights are 1 / N."""
    by = by or []
    weighted = models.withColumn("_weight", F.col(weight) if weight else F.lit(1.0))
    return average_vectors(weighted, by, "feature_importances", "_weight").select(*by, "feature_importances")


def median_models(models: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Coordinate-wise median of coefficients and intercept over sources."""
    by = by or []
    parts = models.select(*by, F.posexplode(F.concat("coef", F.array("intercept"))).alias("_pos", "_v"))
    middle = medians(parts, [*by, "_pos"], "_v", "_v")
    return middle.groupBy(*by).agg(in_order("_pos", "_v").alias("theta")).select(*by, *_split_theta())


def ensemble_score(
    df: DataFrame, models: DataFrame, source: str = "client_id", threshold: float = 0.5, max_cells: int = MAX_BROADCAST_CELLS,
    row_blocks: int | None = None,
) -> DataFrame:
    """Add `y_proba` = sum of weight * probability over all models, and `y_pred`.

    Models travel as one broadcast array, so rows are not multiplied. Beyond the broadcast bound
    it is a block product: models are cut to blocks within the bound, rows to `row_blocks` (by
    default the shuffle partitions), every pair of blocks meets in one shuffle and gives partial
    sums. Terms are added in units of 1e-15, so the sum is the same in any order and number of blocks.
    """
    known = sized(models.select(source, "weight", "coef", "intercept"), F.size("coef"))
    per_block = max(1, max_cells // (known.largest + 3))
    zero = F.lit(0).cast("bigint")
    units = F.aggregate(F.coalesce("_models", F.array()), zero, lambda acc, m: acc + F.round(
        m["weight"] * sigmoid(dot(F.col("x"), m["coef"]) + m["intercept"]) * PROBABILITY_UNITS
    ).cast("bigint"))
    member = F.collect_list(F.struct(source, "weight", "coef", "intercept")).alias("_models")
    if known.rows <= per_block:
        packed = known.table.agg(member).select(F.lit(0).alias("_block"), "_models")
        scored = df.withColumn("_block", F.lit(0)).join(F.broadcast(packed), "_block").withColumn("_units", units).drop("_models", "_block")
    else:
        placed = global_prefix_sum(known.table, [F.col(source)], {"_place": F.lit(1).cast("bigint")})
        packed = placed.groupBy(F.floor((F.col("_place") - 1) / per_block).cast("int").alias("_block")).agg(member)
        model_blocks = math.ceil(known.rows / per_block)
        spread = row_blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # numbers that hold: the rows are stored with them
        rows = sized(df.withColumn("_rid", F.monotonically_increasing_id())).table
        pairs = rows.select("_rid", "x", F.pmod(F.xxhash64("_rid"), F.lit(spread)).alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(model_blocks - 1))).alias("_block"))
        dealt = packed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
        sums = pairs.join(dealt.hint("shuffle_hash"), ["_part", "_block"]).select("_rid", units.alias("_units")).groupBy("_rid").agg(F.sum("_units").alias("_units"))
        scored = rows.join(sums, "_rid").drop("_rid")
    scored = scored.withColumn("y_proba", F.col("_units") / float(PROBABILITY_UNITS)).drop("_units")
    return scored.withColumn("y_pred", F.when(F.col("y_proba") >= threshold, 1).otherwise(0))


def _rounds(df, rounds, source, label, key, cap, seed, lr, epochs, batch, mu, combine, fit_rows) -> np.ndarray:
    """Rounds of local descent from the shared model; only its d + 1 numbers reach the driver."""
    classes = sized(df.groupBy(source).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")))
    mixed = classes.derive(classes.table.filter(F.col("_lo") != F.col("_hi")).select(source))
    usable = lookup_join(df.select(source, label, key, "x"), mixed, [source], "left_semi")
    theta = None
    for r in range(1, max(1, rounds) + 1):
        sample = usable if cap is None else bootstrap_capped(usable, cap, seed + r, source, label, key)
        if cap is not None:
            sample = sample.withColumn(key, F.concat_ws("|", F.col(key), F.col("draw").cast("string")))
        if theta is None:
            width = usable.agg(F.max(F.size("x"))).first()[0]
            theta = np.zeros(width + 1)
        local = _descend_sources(sample, source, label, key, theta, lr, epochs, batch, seed + r, mu, fit_rows)
        found = combine(local).first()
        if found is not None and found["theta"] is not None:
            theta = np.array(found["theta"])
    return theta


def _as_model(df: DataFrame, theta: np.ndarray) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [([float(v) for v in theta[:-1]], float(theta[-1]))], "coef array<double>, intercept double"
    )


def proximal_rounds(
    df: DataFrame,
    rounds: int = 10,
    mu: float = PROXIMAL_MU,
    epochs: int = 1,
    cap: int | None = CAP,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    lr: float = LEARNING_RATE,
    batch: int = BATCH_SIZE,
    seed: int = 42,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One shared linear model: per round every two-class source descends from it with a
    proximal pull, and the results are averaged by row count. Sources above `cap` rows are
    resampled to it in each round."""
    size_weighted = lambda local: average_vectors(local, [], "theta", "n")
    return _as_model(df, _rounds(df, rounds, source, label, key, cap, seed, lr, epochs, batch, mu, size_weighted, fit_rows))


def median_rounds(
    df: DataFrame,
    rounds: int = 10,
    epochs: int = 1,
    cap: int | None = CAP,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    lr: float = LEARNING_RATE,
    batch: int = BATCH_SIZE,
    seed: int = 42,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """As `proximal_rounds` without the pull; sources are combined by coordinate median."""

    def middle(local: DataFrame) -> DataFrame:
        parts = sized(local.select(F.posexplode("theta").alias("_pos", "_v"))).table
        return medians(parts, ["_pos"], "_v", "_v").agg(in_order("_pos", "_v").alias("theta"))

    return _as_model(df, _rounds(df, rounds, source, label, key, cap, seed, lr, epochs, batch, 0.0, middle, fit_rows))


# fixed values: settings of the global fits
FOREST = {"numTrees": 350, "maxDepth": 25, "minInstancesPerNode": 4}
BOOSTED = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1}
PERCEPTRON = {"maxIter": 500}
HIDDEN_UNITS = 50
LOGISTIC = {"maxIter": 100, "regParam": 1e-4}
PART_CELLS = 250_000  # numbers that one task of a global fit holds
SMALL_FOREST = 2_000  # rows up to which Spark's own learner grows the forest


def _estimators(width: int, seed: int) -> dict[str, Callable[..., object]]:
    return {
        "random_forest": lambda **kw: RandomForestClassifier(seed=seed, **{**FOREST, **kw}),
        "boosted_trees": lambda **kw: GBTClassifier(seed=seed, **{**BOOSTED, **kw}),
        "mlp": lambda **kw: MultilayerPerceptronClassifier(
            seed=seed, **{**PERCEPTRON, "layers": [width, HIDDEN_UNITS, 2], **kw}
        ),
        "logistic_regression": lambda **kw: LogisticRegression(**{**LOGISTIC, **kw}),
    }


@dataclass(frozen=True)
class ConstantModel:
    """The predictor of a table with a single class; zero coefficients."""

    value: int
    width: int

    @property
    def intercept(self) -> float:
        return CONSTANT_INTERCEPT if self.value else -CONSTANT_INTERCEPT


def fit_global(df: DataFrame, kind: str = "logistic_regression", seed: int = 42, label: str = "label", **settings):
    """Fit one Spark ML model on all rows of `df` (arrays in `x`).

    A single class gives a `ConstantModel`, as tree and linear learners need two; no rows give
    one of class 0. A forest on more than `SMALL_FOREST` rows is a `DeepForest`.
    """
    if kind not in _estimators(1, seed):
        raise ValueError(f"unknown model kind {kind!r}")
    stored = sized(df.select(F.col(label).cast("double").alias("label"), "x"), F.size("x"))
    low, high, binary = stored.table.agg(F.min("label"), F.max("label"), F.every(F.coalesce(F.col("label").isin(0.0, 1.0), F.lit(False)))).first()
    if low == high:
        return ConstantModel(int(low or 0), stored.largest)
    # every step of a fit sends sums per task, so tasks follow the rows and not the files they came from
    parts = math.ceil(stored.rows * stored.largest / PART_CELLS)
    rows = stored.table.repartition(max(1, parts), F.xxhash64("x", "label")).sortWithinPartitions("x", "label")
    if kind == "random_forest" and stored.rows > SMALL_FOREST and binary and set(settings) <= deep_forests.SETTINGS:
        trees, depth, min_leaf = ({**FOREST, **settings}[name] for name in ("numTrees", "maxDepth", "minInstancesPerNode"))
        return deep_forests.fit_deep_forest(rows, stored.rows, stored.largest, trees, depth, min_leaf, seed)
    rows = rows.select("label", array_to_vector("x").alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _estimators(stored.largest, seed)[kind](**settings).fit(rows)
    finally:
        rows.unpersist()


def score_global(model, df: DataFrame) -> DataFrame:
    """Add `y_proba` and `y_pred` from a fitted Spark ML model, a `DeepForest` or a constant one."""
    if isinstance(model, ConstantModel):
        return df.withColumns({"y_proba": F.lit(float(model.value)), "y_pred": F.lit(model.value)})
    if isinstance(model, deep_forests.DeepForest):
        return model.score(df)
    rows = df.withColumn("features", array_to_vector("x"))
    scored = model.transform(rows).withColumn("y_proba", vector_to_array("probability")[1])
    return scored.withColumn("y_pred", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def model_parameters(model) -> dict[str, list[float] | float]:
    """Coefficients and intercept of a linear model, layer weights of a perceptron, feature
    importances of tree models; a constant model has zero coefficients."""
    if isinstance(model, ConstantModel):
        return {"coef": [0.0] * model.width, "intercept": model.intercept}
    if isinstance(model, deep_forests.DeepForest):
        return {"feature_importances": model.feature_importances}
    if hasattr(model, "coefficients"):
        return {"coef": model.coefficients.toArray().tolist(), "intercept": float(model.intercept)}
    if hasattr(model, "featureImportances"):
        return {"feature_importances": model.featureImportances.toArray().tolist()}
    return {"weights": model.weights.toArray().tolist()}
