"""Trust per source over rounds: signals, fusion, adaptive update, decay, alerts, weights.

A history is a long table (`client_id`, `round`, `trust`, ...), round 0 holding the initial
trust. Everything here works on one row per source and round, never on data rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sourcetrust.functions.vectors import LN2, squared_distance
from sourcetrust.operators.histories import affine, folded, numbered_rounds, recent_frames
from sourcetrust.operators.joins import lookup_join, sized
from sourcetrust.operators.ordering import global_prefix_sum
from sourcetrust.operators.picking import medians

# fixed values: constants of the trust rules
NO_MODEL_TRUST = 0.1
MAJORITY_SHARE, MAJORITY_ACCURACY, MAJORITY_FACTOR = 0.9, 0.95, 0.75
MAX_VARIANCE = 0.25
DRIFT_SCALE = 10.0
DIRECT_BELOW, QUICK_BELOW, QUICK_FACTOR = 0.1, 0.2, 0.3
TREND_SLOPE = 0.01
STABLE_STEP = 0.001


@dataclass(frozen=True)
class Lambdas:
    accuracy: float = 1.0
    stability: float = 0.3
    drift: float = 0.2
    uncertainty: float = 0.2


@dataclass(frozen=True)
class TrustParams:
    alpha: float = 0.7
    decay: float = 0.95
    anomaly: float = 0.2
    initial: float = 0.5
    beta: float = 0.8
    min_trust: float = 0.0
    window: int = 5
    lambdas: Lambdas = field(default_factory=Lambdas)
    first_update: str = "direct"  # or "smoothed"


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def static_trust(accuracy: Column, majority_share: Column) -> Column:
    """Validation accuracy, cut by a quarter where near-perfect accuracy meets a near-single
    class; 0.1 without a model."""
    penalised = (majority_share > MAJORITY_SHARE) & (accuracy > MAJORITY_ACCURACY)
    score = unit(F.when(penalised, accuracy * MAJORITY_FACTOR).otherwise(accuracy))
    return F.when(accuracy.isNull(), F.lit(NO_MODEL_TRUST)).otherwise(score)


def steadiness(variance: Column, count: Column) -> Column:
    """1 - variance / 0.25, at least 0; 1 with fewer than two values."""
    return F.when(count < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - variance / MAX_VARIANCE))


def stability_signal(metrics: DataFrame, value: str = "accuracy", source: str = "client_id") -> DataFrame:
    """Add `stability`: steadiness of all rounds before the current one."""
    past = W.partitionBy(source).orderBy("round").rowsBetween(W.unboundedPreceding, -1)
    return metrics.withColumn("stability", steadiness(F.var_pop(value).over(past), F.count(value).over(past)))


def drift_signal(models: DataFrame, coef: str = "coef", intercept: str = "intercept", source: str = "client_id") -> DataFrame:
    """Add `drift`: 1 - min(1, distance to the previous round's parameters / 10); 1 at first."""
    order = W.partitionBy(source).orderBy("round")
    before, bias = F.lag(coef).over(order), F.lag(intercept).over(order)
    paired = models.withColumns({"_coef": before, "_bias": bias})
    gap = F.col(intercept) - F.col("_bias")
    norm = F.sqrt(squared_distance(F.col(coef), F.col("_coef")) + gap * gap)
    score = F.when(F.col("_coef").isNull(), F.lit(1.0)).otherwise(1.0 - F.least(F.lit(1.0), norm / DRIFT_SCALE))
    return paired.withColumn("drift", score).drop("_coef", "_bias")


def confidence(mean_entropy: Column) -> Column:
    """1 - entropy / ln 2, at least 0; 0.5 without rows."""
    return F.when(mean_entropy.isNull(), F.lit(0.5)).otherwise(1.0 - F.least(F.lit(1.0), mean_entropy / LN2))


def fused(
    accuracy: Column, stability: Column, drift: Column, uncertainty: Column, weights: Lambdas | dict[str, Column] = Lambdas()
) -> Column:
    """Weighted mean of the four signals (all: higher is better). Missing signals count as
    0, 1, 1 and 0.5; weights may be numbers or columns."""
    w = weights if isinstance(weights, dict) else {
        "accuracy": F.lit(weights.accuracy), "stability": F.lit(weights.stability),
        "drift": F.lit(weights.drift), "uncertainty": F.lit(weights.uncertainty),
    }
    signals = {"accuracy": (accuracy, 0.0), "stability": (stability, 1.0), "drift": (drift, 1.0), "uncertainty": (uncertainty, 0.5)}
    total, score = F.lit(0.0), F.lit(0.0)
    for name, (signal, missing) in signals.items():
        total = total + w[name]
        score = score + w[name] * F.coalesce(signal, F.lit(missing))
    return F.when(total > 0, unit(score / total)).otherwise(F.lit(0.5))


def trust_step(computed: Column, first: Column, params: TrustParams) -> Column:
    """One adaptive step as a clamped affine map of the trust before it.

    A first update, or a computed trust below 0.1, is taken as is; below 0.2 history counts 0.3 times
    as much. What is not a finite number gives the initial trust.
    """
    bad = computed.isNull() | F.isnan(computed) | (F.abs(computed) == F.lit(float("inf")))
    alpha = F.when(computed < QUICK_BELOW, F.lit(params.alpha * QUICK_FACTOR)).otherwise(F.lit(params.alpha))
    direct = computed < DIRECT_BELOW
    if params.first_update == "direct":
        direct = direct | first
    a = F.when(bad | direct, F.lit(0.0)).otherwise(alpha)
    b = F.when(bad, F.lit(params.initial)).when(direct, computed).otherwise((1 - alpha) * computed)
    return affine(a, b)


def initial_history(sources: DataFrame, known: DataFrame | None = None, params: TrustParams = TrustParams()) -> DataFrame:
    """Round-0 rows for sources that have no history yet."""
    new = sources.select("client_id").distinct()
    if known is not None:
        new = new.join(known.select("client_id").distinct(), "client_id", "left_anti")
    return new.select("client_id", F.lit(0).alias("round"), F.lit(params.initial).alias("trust"))


def round_spine(observed: DataFrame, first_round: int, last_round: int | Column) -> DataFrame:
    """One row per source and round; `computed` is null where the source was inactive."""
    spine = observed.select("client_id").distinct().withColumn(
        "round", F.explode(F.sequence(F.lit(first_round), F.lit(last_round) if isinstance(last_round, int) else last_round))
    )
    return spine.join(observed, ["client_id", "round"], "left")


def adaptive_trust(
    observed: DataFrame, params: TrustParams = TrustParams(), decay: bool = False, stored: DataFrame | None = None
) -> DataFrame:
    """Trust history from `client_id, round, computed`, one row per source and round.

    The smoothing weight depends on the data, but each round is a clamped affine map of the trust
    before it, so a history of any length is folded in blocks (`histories`). A round has one row per
    source. With `decay`, a round whose `computed` is null multiplies trust by the decay rate; use
    `round_spine` to make such rounds. Returns `client_id, round, trust, computed, event, previous,
    consistency, trend`, where the last two describe the history before the update.

    With `stored`, an earlier history, each source goes on from its last stored row; rounds up to
    it are not applied again. Stored and new rows come back together.
    """
    past = ["client_id", "round", "trust", "computed", "event"]
    steps = sized(observed.select("client_id", F.col("round").cast("int").alias("round"), F.col("computed").cast("double").alias("computed"))).table
    unknown = {"_last": F.lit(None).cast("int"), "_trust": F.lit(None).cast("double")}
    if stored is None:
        begun, due = steps.select("client_id").distinct().withColumns(unknown), steps.withColumn("_last", unknown["_last"])
    else:
        last = stored.groupBy("client_id").agg(F.max("round").cast("int").alias("_last"), F.max_by("trust", "round").alias("_trust"))
        begun = steps.select("client_id").distinct().join(last.hint("merge"), "client_id", "left")
        due = steps.join(begun.select("client_id", "_last").hint("merge"), "client_id", "left")
    begun = begun.withColumn("_x", F.coalesce("_trust", F.lit(params.initial)))
    due = due.filter(F.col("_last").isNull() | (F.col("round") > F.col("_last")))
    due = sized(numbered_rounds(due)).table
    first = (F.col("_last").isNull() & (F.col("_i") == 0)) | (F.col("round") == 1)
    step, event = trust_step(F.col("computed"), first, params), F.lit("update")
    if decay:
        idle = F.col("computed").isNull()
        step = F.when(idle, affine(F.lit(params.decay), F.lit(0.0))).otherwise(step)
        event = F.when(idle, "decay").otherwise(event)
    run = folded(due.withColumns({"_f": step, "event": event}), begun.select("client_id", "_x"), ["round", "computed", "event"])
    rows = run.select("client_id", "round", F.col("_y").alias("trust"), "computed", "event")
    new = begun.filter("_last IS NULL").select(
        "client_id", F.lit(0).alias("round"), F.col("_x").alias("trust"), F.lit(None).cast("double").alias("computed"), F.lit("initial").alias("event")
    )
    rows = new.unionByName(rows)
    if stored is not None:
        rows = stored.select(*past).unionByName(rows)
    return describe_history(rows, params.window)


def replayed(history: DataFrame, corrected: DataFrame, params: TrustParams = TrustParams(), decay: bool = False) -> DataFrame:
    """A trust history brought in line with corrected measurements, as after late rows.

    `corrected` has all rounds (`client_id, round, computed`). A source is folded again from its first
    round that differs or is new; what lies before, and sources without a difference, stay as they are.
    """
    own = history.select("client_id", "round", F.col("computed").alias("_old"), F.lit(True).alias("_known"))
    both = corrected.select("client_id", "round", "computed").join(own, ["client_id", "round"], "left")
    differs = F.col("_known").isNull() | ~F.col("computed").eqNullSafe(F.col("_old"))
    begun = sized(both.filter(differs).groupBy("client_id").agg(F.min("round").alias("_from")))
    marked = lookup_join(history, begun, ["client_id"])
    kept = marked.filter(F.col("_from").isNull() | (F.col("round") < F.col("_from")) | (F.col("round") == 0)).drop("_from")
    again = lookup_join(corrected, begun.derive(begun.table.select("client_id")), ["client_id"], "left_semi")
    return adaptive_trust(again, params, decay, stored=sized(kept).table)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is evaluated once."""
    return F.transform(F.array(value), then)[0]


def product_sum(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once."""
    split = F.lit(134217729.0)  # 2^27 + 1 cuts a double into two halves whose products are exact
    high = lambda v: v * split - (v * split - v)

    def total(p: Column) -> Column:
        low = ((p["ah"] * p["bh"] - p["p"]) + p["ah"] * (b - p["bh"]) + (a - p["ah"]) * p["bh"]) + (a - p["ah"]) * (b - p["bh"])
        s = p["p"] + c
        return s + ((p["p"] - (s - (s - p["p"])) + (c - (s - p["p"]))) + low)

    return _bound(F.struct((a * b).alias("p"), high(a).alias("ah"), high(b).alias("bh")), total)


def recent_points(value: str, frame) -> Column:
    """Places `_i` and values of a window frame, in order."""
    return F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col("_i").cast("double").alias("x"), F.col(value).cast("double").alias("y")))).over(frame)


def slope_of(points: Column) -> Column:
    """Slope of a line through `recent_points`; null with fewer than two.

    Running means and moments, with the step of the co-moment rounded once, as the SQL twin's
    `regr_slope` does it: where a slope is exactly a threshold the last bit decides on the trend.
    """
    names = ("n", "mx", "my", "c", "m")
    made = lambda *v: F.struct(*[c.alias(k) for k, c in zip(names, v)])

    def step(s: Column, p: Column) -> Column:
        n = s["n"] + 1.0
        moved = F.struct(n.alias("n"), (p["x"] - s["mx"]).alias("dx"), (s["mx"] + (p["x"] - s["mx"]) / n).alias("mx"), (s["my"] + (p["y"] - s["my"]) / n).alias("my"))
        return _bound(moved, lambda v: made(
            v["n"], v["mx"], v["my"], product_sum(v["dx"], p["y"] - v["my"], s["c"]), s["m"] + v["dx"] * (p["x"] - v["mx"])
        ))

    slope = lambda s: (s["c"] / s["n"]) / (s["m"] / s["n"])
    return F.when(F.size(points) >= 2, F.aggregate(points, made(*[F.lit(0.0)] * 5), step, slope))


def describe_history(history: DataFrame, window: int = 5) -> DataFrame:
    """Add `previous` trust, and `consistency` and `trend` as they were before each row."""

    def described(order) -> dict[str, Column]:
        past = order.rowsBetween(-window, -1)
        return {
            "previous": F.lag("trust").over(order),
            "consistency": steadiness(F.var_pop("trust").over(past), F.count("trust").over(past)),
            "trend": trend_name(slope_of(recent_points("trust", past))),
        }

    return recent_frames(numbered_rounds(history), window, described).drop("_i")


def trend_name(slope: Column) -> Column:
    return F.when(slope > TREND_SLOPE, "improving").when(slope < -TREND_SLOPE, "declining").otherwise("stable")


def consistency_and_trend(history: DataFrame, value: str = "trust", window: int = 5) -> DataFrame:
    """Add `consistency`, `slope` and `trend` of the last `window` values up to each row."""
    order = W.partitionBy("client_id").orderBy("round")
    recent = order.rowsBetween(-(window - 1), 0)
    slope = slope_of(recent_points(value, recent))
    return (
        history.withColumn("_i", F.row_number().over(order))
        .withColumns({
            "consistency": steadiness(F.var_pop(value).over(recent), F.count(value).over(recent)),
            "slope": slope,
        })
        .withColumn("trend", trend_name(F.col("slope")))
        .drop("_i")
    )


def trend_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("trend").agg(F.count("*").alias("sources"))


def sudden_drops(history: DataFrame, params: TrustParams = TrustParams()) -> DataFrame:
    """Rounds whose trust fell by more than the anomaly threshold."""
    previous = F.lag("trust").over(W.partitionBy("client_id").orderBy("round"))
    drops = history.select("client_id", "round", F.col("trust").alias("current_trust"), previous.alias("previous_trust"))
    return (
        drops.withColumn("magnitude", F.col("previous_trust") - F.col("current_trust"))
        .filter(F.col("magnitude") > params.anomaly)
        .withColumn("type", F.lit("sudden_drop"))
    )


def latest_trust(history: DataFrame) -> DataFrame:
    """Trust of the last round per source."""
    return history.groupBy("client_id").agg(
        F.max("round").alias("round"), F.max_by("trust", "round").alias("trust")
    )


def last_rounds(history: DataFrame, n: int) -> DataFrame:
    """The last `n` rounds per source."""
    rank = F.row_number().over(W.partitionBy("client_id").orderBy(F.desc("round")))
    return history.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def trust_of(sources: DataFrame, latest: DataFrame, params: TrustParams = TrustParams()) -> DataFrame:
    """Rows of `sources` with their trust; unknown sources get the initial trust."""
    found = lookup_join(sources, latest.select("client_id", "trust"), ["client_id"])
    return found.withColumn("trust", F.coalesce("trust", F.lit(params.initial)))


def _with_totals(table: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """Add aggregates of each `by` group, or of the whole table, to its rows."""
    if not by:
        return table.withColumns({name: table.select(total).scalar() for name, total in totals.items()})
    return lookup_join(table, table.groupBy(*by).agg(*[t.alias(n) for n, t in totals.items()]), by, "inner")


def trust_weights(
    trust: DataFrame, beta: float | Column = 0.8, min_trust: float = 0.0, by: list[str] | None = None
) -> DataFrame:
    """Add `weight` = trust^beta / sum and `fallback`.

    Trust below `min_trust` weighs 0. When nothing is left, all sources of the group, the
    rejected ones included, weigh the same and `fallback` is true.
    """
    by = by or []
    beta = beta if isinstance(beta, Column) else F.lit(beta)
    base = F.greatest(F.col("trust"), F.lit(0.0))
    if min_trust > 0:
        base = F.when(base >= min_trust, base).otherwise(F.lit(0.0))
    powered = trust.withColumn("_p", F.when(base > 0, F.power(base, beta)).otherwise(F.lit(0.0)))
    joined = _with_totals(powered, by, {"_t": F.sum("_p"), "_k": F.count("*")})
    return joined.withColumns({
        "weight": F.when(F.col("_t") > 0, F.col("_p") / F.col("_t")).otherwise(1.0 / F.col("_k")),
        "fallback": F.col("_t") <= 0,
    }).drop("_p", "_t", "_k")


def equal_weights(sources: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    joined = _with_totals(sources, by, {"_k": F.count("*")})
    return joined.withColumn("weight", 1.0 / F.col("_k")).drop("_k")


def evolution(history: DataFrame, window: int = 5) -> DataFrame:
    """Per source: initial and final trust, total and relative change, steps and trend."""
    order = W.partitionBy("client_id").orderBy("round")
    recent = order.rowsBetween(-(window - 1), 0)
    stepped = (
        history.withColumn("_i", F.row_number().over(order))
        .withColumn("_step", F.col("trust") - F.lag("trust").over(order))
        .withColumn("_recent", recent_points("trust", recent))
    )
    per = stepped.groupBy("client_id").agg(
        (F.count("*") - 1).alias("rounds"),
        F.min_by("trust", "round").alias("initial_trust"),
        F.max_by("trust", "round").alias("final_trust"),
        F.avg("_step").alias("avg_change"),
        F.max("_step").alias("max_increase"),
        F.min("_step").alias("max_decrease"),
        F.max_by("_recent", "round").alias("_recent"),
    )
    change = F.col("final_trust") - F.col("initial_trust")
    return (
        per.filter(F.col("rounds") > 0)
        .withColumns({
            "total_change": change,
            "percent_change": F.when(F.col("initial_trust") > 0, change / F.col("initial_trust") * 100).otherwise(F.lit(0.0)),
            "trend": trend_name(F.coalesce(slope_of(F.col("_recent")), F.lit(0.0))),
        })
        .drop("_recent")
    )


def ranking(history: DataFrame) -> DataFrame:
    """Sources by falling latest trust, with the change of the last round."""
    two = history.groupBy("client_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("round", "trust")), False), 1, 2).alias("_h")
    )
    now = two.select(
        "client_id",
        F.col("_h")[0]["round"].alias("round"),
        F.col("_h")[0]["trust"].alias("trust"),
        F.get("_h", F.lit(1))["trust"].alias("previous"),
    ).withColumn("change", F.col("trust") - F.col("previous"))
    ranked = global_prefix_sum(now, [F.desc("trust"), F.col("client_id")], {"rank": F.lit(1).cast("bigint")})
    direction = (
        F.when(F.col("change") > STABLE_STEP, "up").when(F.col("change") < -STABLE_STEP, "down").otherwise("stable")
    )
    return ranked.withColumn("direction", direction)


def trust_summary(latest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, population std, min, max, median, count, range and the heterogeneity flag.

    Without sources all numbers are 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    by = by or []
    stats = latest.groupBy(*by).agg(
        zero(F.avg("trust")).alias("mean"),
        zero(F.stddev_pop("trust")).alias("std"),
        zero(F.min("trust")).alias("min"),
        zero(F.max("trust")).alias("max"),
        F.count("trust").alias("count"),
    )
    middle = medians(latest, by, "trust", "median")
    stats = stats.join(middle, by, "left") if by else stats.withColumn("median", middle.scalar())
    stats = stats.withColumn("median", zero(F.col("median"))).select(*by, "mean", "std", "min", "max", "median", "count")
    return stats.withColumn("range", F.col("max") - F.col("min")).withColumn("heterogeneous", F.col("range") > 0.3)


def trust_band(trust: Column) -> Column:
    """Left-closed bands at 0.9, 0.7, 0.5 and 0.3."""
    return (
        F.when(trust >= 0.9, "very high").when(trust >= 0.7, "high").when(trust >= 0.5, "medium")
        .when(trust >= 0.3, "low").otherwise("very low")
    )


def accuracy_band(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.7, "high").when(accuracy >= 0.5, "medium").otherwise("low")


def reliance(trust: Column) -> Column:
    """'trusted' above 0.8, 'doubtful' below 0.7, else 'between'."""
    return F.when(trust > 0.8, "trusted").when(trust < 0.7, "doubtful").otherwise("between")


def band_counts(latest: DataFrame, band: Column) -> DataFrame:
    return latest.groupBy(band.alias("band")).agg(F.count("*").alias("sources"))


def round_log(metrics: DataFrame, history: DataFrame) -> DataFrame:
    """One row per source and round: validation metrics with the updated trust."""
    return metrics.join(history.select("client_id", "round", F.col("trust").alias("trust_score")), ["client_id", "round"])
