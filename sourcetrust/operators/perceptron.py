"""A perceptron with one hidden layer of rectified units, trained by Adam with early stopping.

Every step is one data-parallel pass: tasks sum the gradient of their rows, the sums are added in a
few tasks, and only sums reach the driver, whose size is that of the model. A share of the rows,
chosen by a hash, is kept back; when its accuracy stops rising the best parameters so far are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sourcetrust.functions.keys import hash_uniform
from sourcetrust.functions.vectors import dot, sigmoid
from sourcetrust.operators.joins import sized

# fixed values: settings of the optimiser
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
PARTIAL_SUMS = 16  # tasks that add the tasks' sums


@dataclass(frozen=True)
class Settings:
    hidden: int = 50
    rate: float = 0.001
    epochs: int = 200
    batches: int = 1  # hash classes of rows, each one step of an epoch
    penalty: float = 1e-4
    held_back: float = 0.1
    patience: int = 10
    tolerance: float = 1e-4
    seed: int = 42


@dataclass(frozen=True)
class Perceptron:
    """Weights (width x hidden, hidden) and biases (hidden, one) in one vector."""

    theta: np.ndarray
    width: int
    hidden: int
    epochs: int = 0

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        a = self.width * self.hidden
        return self.theta[:a].reshape(self.width, self.hidden), self.theta[a:a + self.hidden], self.theta[a + self.hidden:-1], float(self.theta[-1])


def first_parameters(width: int, hidden: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    inner, outer = np.sqrt(6.0 / (width + hidden)), np.sqrt(6.0 / (hidden + 1))
    return np.concatenate([
        rng.uniform(-inner, inner, width * hidden), rng.uniform(-inner, inner, hidden), rng.uniform(-outer, outer, hidden), rng.uniform(-outer, outer, 1),
    ])


def gradient_sums(model: Perceptron, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Summed gradient of the weighted cross-entropy, without the penalty."""
    inner, bias, outer, out = model.parts()
    z = x @ inner + bias
    h = np.maximum(z, 0.0)
    p = 1.0 / (1.0 + np.exp(-np.clip(h @ outer + out, -50.0, 50.0)))
    error = (p - y) * weight
    back = (error[:, None] * outer) * (z > 0)
    return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), h.T @ error, [error.sum()]])


def right_answers(model: Perceptron, x: np.ndarray, y: np.ndarray) -> int:
    inner, bias, outer, out = model.parts()
    return int(((np.maximum(x @ inner + bias, 0.0) @ outer + out >= 0) == (y == 1)).sum())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part as one row of bytes, so that a pass hands over blocks and not arrays by row."""
    for some in batches:
        if not some.num_rows:
            continue
        x = np.asarray(some.column(0).flatten(), np.float64).reshape(some.num_rows, -1)
        y, weight = (np.asarray(some.column(i), np.float64) for i in (1, 2))
        part = np.asarray(some.column(3))
        for own in np.unique(part):
            rows = part == own
            blocks = [pa.array([v[rows].tobytes()], pa.binary()) for v in (x, y, weight)]
            yield pa.RecordBatch.from_arrays([*blocks, pa.array([own], pa.int32()), pa.array([x.shape[1]], pa.int32())], ["x", "y", "w", "part", "width"])


def _pass(rows: DataFrame, model: Perceptron, batch: int) -> tuple[np.ndarray, float, int, int]:
    """Gradient sums and weight of a batch's rows; right answers and number of the rows held back."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.theta) + 3)
        for some in batches:
            for i in range(some.num_rows):
                x, y, weight = (np.frombuffer(some.column(c)[i].as_py()) for c in range(3))
                x = x.reshape(len(y), -1)
                if some.column(3)[i].as_py() < 0:
                    total[-2:] += right_answers(model, x, y), len(y)
                else:
                    total[:-3] += gradient_sums(model, x, y, weight)
                    total[-3] += weight.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(v.as_py()) for some in batches for v in some.column(0)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], ["sum"])

    wanted = rows.filter(F.col("part").isin(batch, -1))
    partial = wanted.select("x", "y", "w", "part").mapInArrow(summed, "sum binary").repartition(PARTIAL_SUMS).mapInArrow(added, "sum binary")
    total = np.sum([np.frombuffer(r["sum"]) for r in partial.collect()], axis=0)
    return total[:-3], float(total[-3]), int(total[-2]), int(total[-1])


def fit_perceptron(
    df: DataFrame, settings: Settings = Settings(), class_weights: dict[int, float] | None = None, label: str = "label", key: str = "row_id"
) -> Perceptron:
    """Train on rows with `x` (array), a 0/1 label and a unique key.

    An epoch is `batches` steps, one per hash class of the rows that are not held back. Training ends
    when the accuracy on those held back has not risen by `tolerance` for `patience` epochs, or after
    `epochs`; with no rows held back, after `epochs`. `class_weights` weighs rows by their label.
    """
    weights = class_weights or {}
    weight = F.coalesce(*[F.when(F.col(label) == k, F.lit(float(v))) for k, v in weights.items()], F.lit(1.0))
    held = hash_uniform(settings.seed, "held", F.col(key)) < settings.held_back
    part = F.floor(hash_uniform(settings.seed, "batch", F.col(key)) * settings.batches).cast("int")
    chosen = df.select(
        F.col("x").cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), weight.alias("w"), F.when(held, -1).otherwise(part).alias("part"),
    )
    stored = sized(chosen.mapInArrow(_packed, "x binary, y binary, w binary, part int, width int"), F.col("width"))
    rows, width = stored.table, stored.largest
    theta = first_parameters(width, settings.hidden, settings.seed)
    best, best_share, idle, step = theta, -1.0, 0, 0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    penalised = np.ones_like(theta)
    a = width * settings.hidden
    penalised[a:a + settings.hidden], penalised[-1] = 0.0, 0.0  # biases are free
    epoch = 0
    for epoch in range(1, settings.epochs + 1):
        for batch in range(settings.batches):
            sums, mass, right, n = _pass(rows, Perceptron(theta, width, settings.hidden), batch)
            if batch == 0 and n:  # the state that the epoch before left
                share = right / n
                idle = 0 if share > best_share + settings.tolerance else idle + 1
                if share > best_share:
                    best, best_share = theta, share
                if idle > settings.patience:
                    return Perceptron(best, width, settings.hidden, epoch - 1)
            if not mass:
                continue
            step += 1
            gradient = (sums + settings.penalty * penalised * theta) / mass
            first = BETA1 * first + (1 - BETA1) * gradient
            second = BETA2 * second + (1 - BETA2) * gradient * gradient
            pace = settings.rate * np.sqrt(1 - BETA2**step) / (1 - BETA1**step)
            theta = theta - pace * first / (np.sqrt(second) + EPSILON)
    return Perceptron(best if best_share >= 0 else theta, width, settings.hidden, epoch)


def score_perceptron(df: DataFrame, model: Perceptron, threshold: float = 0.5) -> DataFrame:
    """Add `y_proba` and `y_pred`, by JVM expressions."""
    inner, bias, outer, out = model.parts()
    units = F.array(*[
        F.struct(F.array(*[F.lit(float(v)) for v in inner[:, j]]).alias("w"), F.lit(float(bias[j])).alias("b"), F.lit(float(outer[j])).alias("o"))
        for j in range(model.hidden)
    ])

    def added(total: Column, unit: Column) -> Column:
        return total + unit["o"] * F.greatest(F.lit(0.0), dot(F.col("x"), unit["w"]) + unit["b"])

    scored = df.withColumn("y_proba", sigmoid(F.aggregate(units, F.lit(out), added)))
    return scored.withColumn("y_pred", F.when(F.col("y_proba") >= threshold, 1).otherwise(0))
