"""Controlled quality loss: label flips and feature corruption per source.

Used for robustness drills: a source of known quality must end up with the trust that
quality deserves. All choices are hashes of (seed, row key), statistics are taken from the
rows as given and stay fixed while rows change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sourcetrust.functions.keys import hash_hex, hash_uniform, hex_normal, hex_uniform
from sourcetrust.operators.joins import Sized, lookup_join, sized
from sourcetrust.operators.picking import (
    BUCKET_ROWS, group_sizes, hash_cuts, mark_first, picked_by_hash, picked_by_score, score_cuts,
)

SCORE_SCALE = 1_000_000


@dataclass(frozen=True)
class Tier:
    label_noise: float
    corruption: float
    adversarial: bool = False


# fixed values: noise shares per quality tier
TIERS = {
    "high": Tier(0.0, 0.0),
    "medium": Tier(0.25, 0.15),
    "low": Tier(0.55, 0.35),
    "compromised": Tier(0.99, 0.95, adversarial=True),
}
# fixed values: rows each tier's sources are resized to
TIER_ROWS = {"high": 25_000, "medium": 5_000, "low": 3_000, "compromised": 25_000}


def share_of(n: Column, ratio) -> Column:
    """floor(n * ratio) as a row count."""
    return F.floor(n * (ratio if isinstance(ratio, Column) else F.lit(float(ratio)))).cast("bigint")


def flipped(label: Column, is_text: bool) -> Column:
    """Opposite label: 0/1 swapped; BENIGN becomes ATTACK, any attack becomes BENIGN."""
    if not is_text:
        return (1 - label).cast("int")
    return (
        F.when(label == "0", "1").when(label == "1", "0")
        .when(F.upper(label) == "BENIGN", "ATTACK").otherwise("BENIGN")
    )


def _is_text(df: DataFrame, label: str) -> bool:
    return dict(df.dtypes)[label] == "string"


def flip_random(
    df: DataFrame,
    ratio: float,
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    exact: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Flip floor(n * ratio) labels of each source; adds boolean `flipped`.

    `exact=False` flips each row with probability `ratio` instead: one pass, no counts.
    """
    if not exact:
        marked = df.withColumn("flipped", hash_uniform(seed, "flip", F.col(key)) < ratio)
    else:
        quotas = group_sizes(df, [source]).withColumn("quota", share_of(F.col("n"), ratio))
        keyed = df.withColumn("_key", hash_hex(seed, "flip", F.col(key)))
        marked = mark_first(keyed, [source], "_key", quotas, "flipped", bucket_rows).drop("_key")
    return _flip_marked(marked, label)


def feature_stats(df: DataFrame, features: list[str], source: str = "client_id") -> DataFrame:
    """One row per source: mean, sample std, min and max of every feature."""
    return df.groupBy(source).agg(
        F.count("*").alias("n"),
        *[
            agg(F.col(f).cast("double")).alias(f"_{tag}_{f}")
            for f in features
            for tag, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ],
    )


def outlier_score(features: list[str]) -> Column:
    """Sum of |z| over the features in units of 1e-6, given `feature_stats` columns.

    Constant features are skipped. The integer scale makes ties exact.
    """
    total = F.lit(0.0)
    for f in features:
        std = F.col(f"_std_{f}")
        z = F.abs((F.col(f).cast("double") - F.col(f"_mean_{f}")) / std)
        total = total + F.when(std > 0, z).otherwise(F.lit(0.0))
    return F.round(total * SCORE_SCALE).cast("bigint")


def _stat_names(features: list[str]) -> list[str]:
    return [f"_{tag}_{f}" for f in features for tag in ("mean", "std", "min", "max")]


def flip_adversarial(
    df: DataFrame,
    ratio: float,
    features: list[str],
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Flip the floor(n * ratio) rows of each source that lie furthest from its means.

    Without features this is `flip_random`. A zero quota flips nothing.
    """
    if not features:
        return flip_random(df, ratio, seed, source, label, key, bucket_rows=bucket_rows)
    stats = sized(feature_stats(df, features, source))
    scored = lookup_join(df, stats.derive(stats.table.drop("n")), [source])
    scored = scored.withColumn("_score", outlier_score(features)).drop(*_stat_names(features))
    scored = scored.withColumn("_key", hash_hex(seed, "flip", F.col(key)))
    quotas = stats.derive(stats.table.select(source, "n", share_of(F.col("n"), ratio).alias("quota")))
    cuts = score_cuts(scored, [source], "_score", "_key", quotas, bucket_rows)
    marked = lookup_join(scored, cuts.derive(_hidden(cuts.table)), [source])
    marked = marked.withColumn("flipped", picked_by_score("_score", "_key", "_n", "_quota", "_cut"))
    marked = marked.drop("_score", "_key", "_n", "_quota", "_cut", "score_cut")
    return _flip_marked(marked, label)


def _hidden(cuts: DataFrame) -> DataFrame:
    return cuts.withColumnsRenamed({"n": "_n", "quota": "_quota", "cut": "_cut"})


def _flip_marked(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(
        label, F.when(F.col("flipped"), flipped(F.col(label), _is_text(df, label))).otherwise(F.col(label))
    )


def important_features(features: list[str]) -> Column:
    """Names of the max(5, floor(0.2 F)) features with the largest std, constant ones left
    out, given `feature_stats` columns."""
    ranked = F.array_sort(
        F.filter(
            F.array(*[
                F.struct((-F.col(f"_std_{f}")).alias("s"), F.lit(i).alias("i"), F.lit(f).alias("f"))
                for i, f in enumerate(features)
            ]),
            lambda e: e["s"] < 0,
        )
    )
    return F.transform(F.slice(ranked, 1, max(5, int(len(features) * 0.2))), lambda e: e["f"])


def corruption_plan(features: list[str], targeted: Column) -> dict[str, Column]:
    """Columns of the per-source table that say how a corrupted row is hit.

    `_count`: max(1, floor(0.1 F)) of all features, or with `targeted` max(1, floor(0.3 P))
    of the P most variable ones, whose names are `_pool`. Up to five features all of them
    are candidates either way and there is no `_pool`.
    """
    few = max(1, int(len(features) * 0.1))
    if len(features) <= 5:
        return {"_count": F.when(targeted, F.lit(max(1, int(len(features) * 0.3)))).otherwise(F.lit(few))}
    aimed = important_features(features)
    some = F.greatest(F.lit(1), F.floor(F.size(aimed) * 0.3).cast("int"))
    return {"_pool": F.when(targeted, aimed), "_count": F.when(targeted, some).otherwise(F.lit(few))}


def corrupted(feature: str, draw: Column, sigmas: float, noise_only: bool = False) -> Column:
    """New value of one feature: noise of `sigmas` std, or a uniform value in [min, max].

    `draw` is the hash that chose the feature. Its first eight digits decided the choice,
    the other three groups of eight give the noise, and the coin between the two kinds.
    """
    x, std = F.col(feature).cast("double"), F.coalesce(F.col(f"_std_{feature}"), F.lit(0.0))
    noisy = x + hex_normal(draw, 9, 17) * (std * sigmas)
    if noise_only:
        return noisy
    low, high = F.col(f"_min_{feature}"), F.col(f"_max_{feature}")
    return F.when(hex_uniform(draw, 25) < 0.5, noisy).otherwise(low + hex_uniform(draw, 9) * (high - low))


# sorts after every hex digit: a feature outside the pool is never among the first
OUTSIDE = "g"


def _apply_corruption(
    df: DataFrame, features: list[str], seed: int, key: str, sigmas: float = 3.0, noise_only: bool = False
) -> DataFrame:
    """Replace features of rows flagged `corrupted`.

    `df` carries `feature_stats` and `corruption_plan` columns. A row loses the `_count`
    candidate features whose hashes come first.
    """

    def draw(f: str) -> Column:
        own = hash_hex(seed, "feature", F.col(key), F.lit(f))
        if "_pool" in df.columns:
            own = F.when(F.coalesce(F.array_contains("_pool", f), F.lit(True)), own).otherwise(OUTSIDE)
        return F.when(F.col("corrupted"), own)

    hashes = {f"_h_{f}": draw(f) for f in features}
    last = F.try_element_at(F.sort_array(F.array(*[F.col(h) for h in hashes])), F.col("_count"))
    last = F.when(F.col("corrupted"), F.when(F.col("_count") == 1, F.least(*hashes)).otherwise(last) if len(features) > 1 else F.col(*hashes))
    drawn = df.withColumns(hashes).withColumn("_last", last)
    new = {
        f: F.when(
            F.col("corrupted") & (F.col(f"_h_{f}") <= F.col("_last")) & (F.col(f"_h_{f}") != OUTSIDE),
            corrupted(f, F.col(f"_h_{f}"), sigmas, noise_only),
        ).otherwise(F.col(f).cast("double"))
        for f in features
    }
    return drawn.withColumns(new).drop("_last", "_pool", "_count", *hashes)


def corrupt_features(
    df: DataFrame,
    ratio: float,
    features: list[str],
    seed: int = 42,
    targeted: bool = False,
    source: str = "client_id",
    key: str = "row_id",
    sigmas: float = 3.0,
    noise_only: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Corrupt floor(n * ratio) rows of each source; adds boolean `corrupted`.

    Each such row loses max(1, floor(0.1 F)) random features, or with `targeted`
    max(1, floor(0.3 P)) of the P most variable ones.
    """
    if not features:
        return df.withColumn("corrupted", F.lit(False))
    stats = sized(feature_stats(df, features, source))
    keyed = df.withColumn("_key", hash_hex(seed, "corrupt", F.col(key)))
    quotas = stats.derive(stats.table.select(source, "n", share_of(F.col("n"), ratio).alias("quota")))
    cuts = hash_cuts(keyed, [source], "_key", quotas, bucket_rows)
    per_source = lookup_join(stats.table.drop("n"), cuts.derive(_hidden(cuts.table)), [source])
    per_source = per_source.withColumns(corruption_plan(features, F.lit(targeted)))
    marked = lookup_join(keyed, stats.derive(per_source), [source])
    marked = marked.withColumn("corrupted", picked_by_hash("_key", "_n", "_quota", "_cut"))
    changed = _apply_corruption(marked, features, seed, key, sigmas, noise_only)
    return changed.drop("_key", "_n", "_quota", "_cut", *_stat_names(features))


def apply_tiers(
    df: DataFrame,
    tiers: DataFrame,
    features: list[str],
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Degrade every source to its quality tier: labels first, then features.

    `tiers` holds one row per source: `source, quality`. Adds `quality`, `flipped` and
    `corrupted`. All sources go through one plan; the only per-source state is a table of
    cuts and statistics.
    """
    keyed, cuts = _tier_cuts(df, tiers, features, seed, source, key, bucket_rows, with_features=True)
    marked = lookup_join(keyed, cuts, [source]).withColumns({
        "flipped": picked_by_score("_score", "_flip_key", "_n", "_flip_quota", "_flip_cut"),
        "corrupted": picked_by_hash("_corrupt_key", "_n", "_corrupt_quota", "_corrupt_cut"),
    })
    changed = _apply_corruption(marked, features, seed, key)
    return _flip_marked(changed, label).select(*df.columns, "quality", "flipped", "corrupted")


def flip_by_tier(
    df: DataFrame,
    tiers: DataFrame,
    features: list[str],
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The label part of `apply_tiers` alone: adds `quality`, `flipped`, changes `label`."""
    keyed, cuts = _tier_cuts(df, tiers, features, seed, source, key, bucket_rows, with_features=False)
    flip = picked_by_score("_score", "_flip_key", "_n", "_flip_quota", "_flip_cut")
    marked = lookup_join(keyed, cuts, [source]).withColumn("flipped", flip)
    return _flip_marked(marked, label).select(*df.columns, "quality", "flipped")


def _tier_cuts(df, tiers, features, seed, source, key, bucket_rows, with_features) -> tuple[DataFrame, Sized]:
    """Rows with hash keys and outlier scores, and the per-source table of cuts.

    Random flips are score flips in which every row scores 0, so one pass finds both.
    """
    noise = {name: (t.label_noise, t.corruption, t.adversarial) for name, t in TIERS.items()}
    pick = lambda i: F.coalesce(*[F.when(F.col("quality") == q, F.lit(v[i])) for q, v in noise.items()])
    stats = feature_stats(df, features, source).join(tiers.select(source, "quality"), source, "left")
    stats = sized(stats.withColumns({
        "_adversarial": F.coalesce(pick(2), F.lit(False)),
        "_flip_quota": share_of(F.col("n"), F.coalesce(pick(0), F.lit(0.0))),
        "_corrupt_quota": share_of(F.col("n"), F.coalesce(pick(1), F.lit(0.0))),
    }))
    needed = [f"_{t}_{f}" for f in features for t in ("mean", "std")]
    keyed = lookup_join(df, stats.derive(stats.table.select(source, "_adversarial", *needed)), [source])
    keyed = keyed.withColumns({
        "_score": F.when(F.col("_adversarial"), outlier_score(features)).otherwise(F.lit(0).cast("bigint")),
        "_flip_key": hash_hex(seed, "flip", F.col(key)),
    }).drop("_adversarial", *needed)
    flip_quotas = stats.derive(stats.table.select(source, "n", F.col("_flip_quota").alias("quota")))
    cuts = score_cuts(keyed, [source], "_score", "_flip_key", flip_quotas, bucket_rows)
    kept = [source, F.col("n").alias("_n"), "quality", "_adversarial", "_flip_quota", "_corrupt_quota"]
    table = stats.table.select(*kept, *(_stat_names(features) if with_features else []))
    flip_table = cuts.table.select(source, "score_cut", F.col("cut").alias("_flip_cut"))
    table = lookup_join(table, cuts.derive(flip_table), [source])
    if with_features:
        table = table.withColumns(corruption_plan(features, F.col("_adversarial")))
        keyed = keyed.withColumn("_corrupt_key", hash_hex(seed, "corrupt", F.col(key)))
        corrupt_quotas = stats.derive(stats.table.select(source, "n", F.col("_corrupt_quota").alias("quota")))
        corrupt_cuts = hash_cuts(keyed, [source], "_corrupt_key", corrupt_quotas, bucket_rows)
        corrupt_table = corrupt_cuts.table.select(source, F.col("cut").alias("_corrupt_cut"))
        table = lookup_join(table, corrupt_cuts.derive(corrupt_table), [source])
    return keyed, stats.derive(table)


def degrade(
    df: DataFrame,
    features: list[str],
    severity: float = 0.2,
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Milder decay in place: 0.3 * severity of labels flipped, 0.2 * severity of rows given
    additive noise of two std on max(1, floor(0.1 F)) features."""
    flipped_rows = flip_random(df, severity * 0.3, seed, source, label, key, bucket_rows=bucket_rows)
    return corrupt_features(
        flipped_rows, severity * 0.2, features, seed, False, source, key, 2.0, True, bucket_rows
    )


def restore(
    current: DataFrame,
    original: DataFrame,
    features: list[str],
    ratio: float,
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Move towards the original: features blended (1 - ratio) : ratio, floor(n * ratio)
    labels of each source put back; ratio 1 or more restores everything."""
    parent = original.select(source, key, *[F.col(c).alias(f"_o_{c}") for c in [*features, label]])
    if ratio >= 1.0:
        joined = current.join(parent, [source, key])
        back = {c: F.col(f"_o_{c}") for c in [*features, label]}
        return joined.withColumns(back).withColumn("restored", F.lit(True)).select(*current.columns, "restored")
    quotas = group_sizes(current, [source]).withColumn("quota", share_of(F.col("n"), ratio))
    keyed = current.withColumn("_key", hash_hex(seed, "restore", F.col(key)))
    marked = mark_first(keyed, [source], "_key", quotas, "restored", bucket_rows)
    joined = marked.join(parent, [source, key])
    blend = {f: (1.0 - ratio) * F.col(f) + ratio * F.col(f"_o_{f}") for f in features}
    put_back = F.when(F.col("restored"), F.col(f"_o_{label}")).otherwise(F.col(label))
    return joined.withColumns({**blend, label: put_back}).select(*current.columns, "restored")
