"""Binary classification metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sourcetrust.functions.keys import row_key
from sourcetrust.operators.ordering import global_prefix_sum


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, by: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """tn, fp, fn, tp per group; always all four, absent cells are 0."""
    cell = lambda t, p: F.count_if((F.col(y_true) == t) & (F.col(y_pred) == p))
    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and the four rates from confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": ratio(fp, fp + tn),
        "true_positive_rate": ratio(tp, tp + fn),
        "true_negative_rate": ratio(tn, tn + fp),
        "false_negative_rate": ratio(fn, fn + tp),
    })


def evaluate(df: DataFrame, by: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return rates(confusion(df, by, y_true, y_pred))


def join_predictions(
    truth: DataFrame, predictions: DataFrame, key: str = "row_id", source: str = "client_id"
) -> DataFrame:
    """Truth and prediction of the same row, matched by source and key and never by position."""
    return truth.join(predictions, row_key(source, key, truth, predictions))


def classification_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support for class 0, class 1, macro and weighted average."""
    c = confusion(df, by)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1_score"), support.cast("bigint").alias("support"),
        )

    n0, n1 = tn + fp, fn + tp
    p0, r0, f0 = ratio(tn, tn + fn), ratio(tn, n0), ratio(2 * tn, 2 * tn + fn + fp)
    p1, r1, f1 = ratio(tp, tp + fp), ratio(tp, n1), ratio(2 * tp, 2 * tp + fp + fn)
    macro = lambda a, b: (a + b) / 2
    weighted = lambda a, b: ratio(a * n0 + b * n1, n0 + n1)
    lines = F.array(
        line("0", p0, r0, f0, n0),
        line("1", p1, r1, f1, n1),
        line("macro avg", macro(p0, p1), macro(r0, r1), macro(f0, f1), n0 + n1),
        line("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n0 + n1),
    )
    return c.select(*by, F.inline(lines))


def class_distribution(
    df: DataFrame, by: list[str], label: str = "label", totals: bool = False
) -> DataFrame:
    """Rows, benign and attack counts, benign share and majority share per group.

    `totals` adds subtotal rows (null group columns), as a rollup.
    """
    grouped = df.rollup(*by) if totals else df.groupBy(*by)
    benign = F.count_if(F.col(label) == 0)
    attack = F.count_if(F.col(label) == 1)
    counts = grouped.agg(F.count("*").alias("n"), benign.alias("benign"), attack.alias("attack"))
    return counts.withColumns({
        "benign_ratio": ratio(F.col("benign"), F.col("n")),
        "majority_ratio": ratio(F.greatest("benign", "attack"), F.col("n")),
    })


def source_report(
    df: DataFrame, features: list[str], source: str = "client_id", label: str = "label", split: str = "split"
) -> DataFrame:
    """Per source: train and validation rows, the features it has a value of, and the benign share of both parts."""
    part = lambda name: F.col(split) == name
    present = F.lit(0)
    for feature in features:
        present = present + F.when(F.count(feature) > 0, 1).otherwise(0)
    benign = lambda name: ratio(F.count_if(part(name) & (F.col(label) == 0)), F.count_if(part(name)))
    return df.groupBy(source).agg(
        F.count_if(part("train")).alias("train_samples"), F.count_if(part("val")).alias("val_samples"),
        present.cast("long").alias("n_features"), benign("train").alias("train_benign_ratio"), benign("val").alias("val_benign_ratio"),
    )


def tier_counts(sources: DataFrame, quality: str = "quality") -> DataFrame:
    return sources.groupBy(quality).agg(F.count("*").alias("sources"))


def evaluation_set_check(counts: DataFrame) -> DataFrame:
    """Whether an evaluation set holds both classes, with the reason in words."""
    benign, attack = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    share = lambda a: F.format_string("%.1f%%", F.round(ratio(a, benign + attack) * 100, 1))
    return counts.withColumns({
        "benign": benign,
        "attack": attack,
        "valid": (benign > 0) & (attack > 0),
        "reason": F.when(benign + attack == 0, "no rows")
        .when(benign == 0, "no benign rows")
        .when(attack == 0, "no attack rows")
        .otherwise(F.concat_ws(" ", F.lit("benign"), share(benign), F.lit("attack"), share(attack))),
    })


def roc_points(df: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """One point per distinct score, by falling score: tp, fp, tpr, fpr at that threshold."""
    by_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) == 0).alias("neg")
    )
    running = global_prefix_sum(by_score, [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")})
    positives, negatives = (running.select(F.sum(c)).scalar() for c in ("pos", "neg"))  # from the checkpoint
    totals = running.withColumns({"_p": positives, "_n": negatives})
    return totals.withColumns({"tpr": ratio(F.col("tp"), F.col("_p")), "fpr": ratio(F.col("fp"), F.col("_n"))})


def roc_auc(df: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the ROC curve by trapezoids between consecutive points."""
    points = roc_points(df, y_true, score)
    area = F.col("neg") * (2.0 * F.col("tp") - F.col("pos")) / 2.0
    return points.agg(
        F.count("*").alias("points"),
        F.max("_p").alias("positives"),
        F.max("_n").alias("negatives"),
        F.sum(area).alias("_area"),
    ).select(
        "points", "positives", "negatives",
        ratio(F.col("_area"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"),
    )


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins over [min, max] of a per-source table; the last bin is closed."""
    df = df.select(value)
    low, high = df.select(F.min(value)).scalar(), df.select(F.max(value)).scalar()
    placed = df.withColumns({"_lo": low, "_hi": high})
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_ = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    counts = placed.filter(F.col(value).isNotNull()).groupBy(bin_.cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    return counts.select(
        "bin", "n",
        (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"),
    )
