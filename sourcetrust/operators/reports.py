"""Comparison of approaches, trials and parameter grids over long metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sourcetrust.functions.student_t import p_value, t_quantile
from sourcetrust.operators.metrics import ratio


def melt_metrics(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics to long rows `keys..., metric, value`."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return table.select(*keys, F.inline(pairs))


def compare_approaches(results: DataFrame, approaches: list[str]) -> DataFrame:
    """Metric by approach table."""
    return results.groupBy("metric").pivot("approach", approaches).agg(F.first("value"))


def ranked_by(results: DataFrame, metric: str) -> DataFrame:
    """Approaches by falling value of one metric."""
    return results.filter(F.col("metric") == metric).orderBy(F.desc("value"), "approach")


def improvement(results: DataFrame, against: str, approach: str) -> DataFrame:
    """Relative change (%) and gap of `approach` to `against`, per metric."""
    wide = compare_approaches(results, [approach, against])
    a, b = F.col(approach), F.col(against)
    return wide.select(
        "metric", a.alias("value"), b.alias("baseline"), (a - b).alias("gap"), (ratio(a - b, b) * 100).alias("percent")
    )


def gap_to_best(results: DataFrame) -> DataFrame:
    """Add `best` and `gap` = best - value within each metric."""
    best = results.groupBy("metric").agg(F.max("value").alias("best"))
    return results.join(best, "metric").withColumn("gap", F.col("best") - F.col("value"))


def trial_stats(trials: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, both standard deviations, min, max and range of `value`; spread 0 for n = 1."""
    return trials.groupBy(*by).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std_pop"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_sample"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"),
    )


def two_sample_t(trials: DataFrame, first: str, second: str, variant: str = "variant", with_p: bool = True) -> DataFrame:
    """Equal-variance t test of two variants per metric; groups below two values give null.

    Adds `p_value` and stars at .001, .01 and .05 unless `with_p` is false.
    """
    moments = trials.groupBy("metric").agg(*[
        f(F.when(F.col(variant) == v, F.col("value"))).alias(f"{tag}{i}")
        for i, v in ((1, first), (2, second))
        for tag, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))
    ])
    n1, n2 = F.col("n1"), F.col("n2")
    df = n1 + n2 - 2
    pooled = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / df
    spread = F.sqrt(pooled * (1.0 / n1 + 1.0 / n2))
    t = F.when((n1 >= 2) & (n2 >= 2) & (spread > 0), (F.col("m1") - F.col("m2")) / spread)
    tested = moments.select("metric", t.alias("t"), F.when((n1 >= 2) & (n2 >= 2), df).cast("double").alias("df"))
    if not with_p:
        return tested
    p = F.when(F.col("t").isNotNull(), F.col("_p"))
    return (
        tested.withColumn("_p", p_value(F.coalesce("t", F.lit(0.0)), F.coalesce("df", F.lit(1.0))))
        .withColumn("p_value", p)
        .withColumn("stars", significance(F.col("p_value")))
        .drop("_p")
    )


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def confidence_interval(stats: DataFrame, confidence: float = 0.95, std: str = "std_sample") -> DataFrame:
    """Add `low` and `high` = mean -+ t * std / sqrt(n); null for n < 2."""
    n = F.col("n").cast("double")
    t = t_quantile(F.lit((1 + confidence) / 2), F.greatest(n - 1, F.lit(1.0)))
    margin = F.when(F.col("n") >= 2, F.col("_t") * F.col(std) / F.sqrt(n))
    return stats.withColumn("_t", t).withColumns({"low": F.col("mean") - margin, "high": F.col("mean") + margin}).drop("_t")


def percent_text(value: Column, std: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    """'v%', 'v% ± s%' or 'v% ± s% (95% CI: l% - h%)'."""
    if std is None:
        return F.format_string("%.2f%%", value * 100)
    if low is None:
        return F.format_string("%.2f%% ± %.2f%%", value * 100, std * 100)
    return F.format_string("%.2f%% ± %.2f%% (95%% CI: %.2f%% - %.2f%%)", value * 100, std * 100, low * 100, high * 100)


def best_config(results: DataFrame, metric: str, k: int = 1, tie: str = "config") -> DataFrame:
    """The `k` configurations with the highest value of a metric column."""
    return results.orderBy(F.desc(metric), tie).limit(k)


def parameter_grid(table: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """Every row once per parameter combination: a whole sweep in one job.

    The grid is a short literal list; it is exploded in place.
    """
    points = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in point.items()]) for point in grid])
    return table.select("*", F.inline(points))
