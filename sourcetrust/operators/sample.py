"""Deterministic samplers, splits and mixes with exact counts per source and class.

Which rows are taken depends only on (seed, row key). Counts come from small per-group
tables; see `picking` for how hot groups are handled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sourcetrust.functions.keys import hash_hex, hash_slot, row_key
from sourcetrust.operators.clean import is_benign
from sourcetrust.operators.joins import Sized, lookup_join, sized
from sourcetrust.operators.picking import BUCKET_ROWS, group_sizes, mark_first, number_line, take_slots

CAP = 15_000


def share_out(counts: DataFrame, source: list[str], label: str, total: Column) -> DataFrame:
    """Split `total` rows of a source over its classes in proportion to class size.

    Floor of each share, the rest by largest remainder, ties to the smaller label.
    `counts` holds `source..., label, n`; the result adds `n_source` and `quota`.
    """
    per_source = W.partitionBy(*source)
    wide = lambda c: c.cast("decimal(19,0)")
    shares = counts.withColumn("n_source", F.sum("n").over(per_source)).withColumn("_total", total.cast("bigint"))
    product = wide(F.col("_total")) * wide(F.col("n"))
    shares = (
        shares.withColumn("_floor", F.floor(product / wide(F.col("n_source"))).cast("bigint"))
        .withColumn("_rest", (product % wide(F.col("n_source"))))
    )
    order = W.partitionBy(*source).orderBy(F.desc("_rest"), F.col(label))
    spare = F.col("_total") - F.sum("_floor").over(per_source)
    extra = F.when(F.row_number().over(order) <= spare, 1).otherwise(0)
    return shares.withColumn("quota", (F.col("_floor") + extra).cast("bigint")).drop("_total", "_floor", "_rest")


def split_stratified(
    df: DataFrame,
    fraction: float = 0.2,
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    stratify: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add `split`: ceil(fraction * n) rows of each source are 'val', the others 'train'.

    With `stratify`, validation rows are shared out over classes in proportion; a class
    with a single row stays in 'train'.
    """
    groups = [source, label] if stratify else [source]
    counts = group_sizes(df, groups)
    if stratify:
        total = F.ceil(F.col("n_source") * F.lit(fraction))
        quotas = share_out(counts, [source], label, total)
        quotas = quotas.withColumn("quota", F.when(F.col("n") == 1, 0).otherwise(F.col("quota")))
    else:
        quotas = counts.withColumn("quota", F.ceil(F.col("n") * F.lit(fraction)))
    keyed = df.withColumn("_key", hash_hex(seed, F.col(key)))
    marked = mark_first(keyed, groups, "_key", quotas, "_val", bucket_rows)
    return marked.withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val", "_key")


def draw_rows(
    df: DataFrame,
    quotas: DataFrame | Sized,
    groups: list[str],
    seed: int,
    key: str,
    replace: bool,
    bucket_rows: int = BUCKET_ROWS,
    within: str | None = None,
) -> DataFrame:
    """`quota` rows of each group: by independent draws (`replace`) or the first in hash order.

    Adds `draw`: the number of the draw, or 0 for rows taken without replacement. Where groups hold
    several sources, `within` names the source column, as keys are unique within a source only.
    """
    keyed = df.withColumn("_key", hash_hex(seed, *[F.col(c) for c in (within, key) if c]))
    if not replace:
        marked = mark_first(keyed, groups, "_key", quotas, "_in", bucket_rows)
        return marked.filter("_in").drop("_in", "_key").withColumn("draw", F.lit(0).cast("bigint"))
    quotas = sized(quotas)
    sizes = quotas.derive(quotas.table.select(*groups, "n", "quota"))
    draws = number_line(sizes.table, F.col("quota"), "draw")
    slot = hash_slot(F.col("n"), seed, *[F.col(g) for g in groups], F.col("draw"))
    slots = draws.select(*groups, "draw", slot.alias("slot"))
    taken = take_slots(keyed, groups, "_key", sizes, slots, bucket_rows).drop("_key")
    return taken.select(*df.columns, "draw")


def _sample_or_keep(df, quotas, source, label, seed, key, replace, bucket_rows) -> DataFrame:
    """`quotas` holds `source, label, n, quota, sampled`; unsampled sources pass whole."""
    quotas = sized(quotas, F.when(F.col("sampled"), F.col("n")))
    whole = quotas.table.filter(~F.col("sampled")).select(source).distinct()
    kept = lookup_join(df, quotas.derive(whole), [source], "left_semi").withColumn("draw", F.lit(0).cast("bigint"))
    if quotas.largest == 0:  # no source is above its quota
        return kept
    thin = quotas.derive(quotas.table.filter("sampled"))
    picked = draw_rows(df, thin, [source, label], seed, key, replace, bucket_rows)
    return kept.unionByName(picked)


def bootstrap_capped(
    df: DataFrame,
    cap: int = CAP,
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    replace: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Sources above `cap` rows are resampled to `cap`, stratified; others pass whole."""
    counts = group_sizes(df, [source, label])
    quotas = share_out(counts, [source], label, F.lit(cap)).withColumn("sampled", F.col("n_source") > cap)
    return _sample_or_keep(df, quotas, source, label, seed, key, replace, bucket_rows)


def weight_quotas(weights: DataFrame, cap: int | None = CAP, base: int = CAP, source: str = "client_id") -> DataFrame:
    """Row quota per source from weights that sum to 1: floor(base * sources * weight).

    With `cap` an above-average weight never yields more than `cap` rows; `cap=None` gives
    full proportionality. The product is rounded at 1e-6 so that an exact share such as
    base * K * (1/K) does not lose a row to floating point.
    """
    quota = F.floor(F.round(F.col("weight") * weights.select(F.count("*")).scalar() * float(base), 6)).cast("bigint")
    if cap is not None:
        quota = F.least(quota, F.lit(cap).cast("bigint"))
    return weights.withColumn("quota", F.greatest(quota, F.lit(0).cast("bigint")))


def quota_sample(
    df: DataFrame,
    source_quotas: DataFrame,
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    replace: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Take each source's `quota` rows, stratified. Quota 0 drops the source; a source not
    larger than its quota passes whole."""
    allowed = source_quotas.filter(F.col("quota") > 0).select(source, F.col("quota").alias("_want"))
    counts = group_sizes(df, [source, label]).join(allowed, source)
    quotas = share_out(counts, [source], label, F.col("_want"))
    quotas = quotas.withColumn("sampled", F.col("n_source") > F.col("_want"))
    return _sample_or_keep(df, quotas, source, label, seed, key, replace, bucket_rows)


def class_ratio_sample(
    df: DataFrame,
    size: int = 10_000,
    benign_ratio: float = 0.2,
    seed: int = 42,
    label: str = "label",
    key: str = "row_id",
    refill: bool = True,
    bucket_rows: int = BUCKET_ROWS,
    source: str = "client_id",
) -> DataFrame:
    """An evaluation set of `size` rows, floor(size * benign_ratio) of them benign, without
    replacement, limited by what exists. With `refill` attack rows fill the whole set when
    there is no benign row at all."""
    need_benign = int(size * benign_ratio)
    counts = group_sizes(df, [label])
    has_benign = F.max(F.when(F.col(label) == 0, 1).otherwise(0)).over(W.partitionBy(F.lit(0))) == 1
    need_attack = F.when(has_benign, size - need_benign).otherwise(size if refill else size - need_benign)
    need = F.when(F.col(label) == 0, F.lit(need_benign)).otherwise(need_attack).cast("bigint")
    quotas = counts.withColumn("quota", F.least(need, F.col("n")))
    within = source if source in df.columns else None
    return draw_rows(df, quotas, [label], seed, key, False, bucket_rows, within).drop("draw")


def mixing_needs(
    df: DataFrame, benign_ratio: float = 0.2, source: str = "client_id", label: str = "label"
) -> DataFrame:
    """Benign rows each source lacks to reach `benign_ratio`; sources with enough are absent."""
    counts = df.groupBy(source).agg(
        F.count_if(F.col(label) == 1).alias("attack"), F.count_if(F.col(label) == 0).alias("benign")
    )
    target = F.floor(F.col("attack") * F.lit(benign_ratio) / F.lit(1 - benign_ratio))
    return counts.withColumn("need", target - F.col("benign")).filter(F.col("need") > 0)


def mix_benign(
    attack: DataFrame,
    pool: DataFrame,
    benign_ratio: float = 0.2,
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Top up each attack source with benign rows from a shared pool.

    Every source takes the first `need` rows of the pool in hash order, so the pool is
    ranked once and never crossed with the sources. Without a label column all attack rows
    count as 1 and all pool rows as 0. Sources with enough benign rows are left out.
    """
    if label not in attack.columns:
        attack = attack.withColumn(label, F.lit(1))
    if label not in pool.columns:
        pool = pool.withColumn(label, F.lit(0))
    needs = sized(mixing_needs(attack, benign_ratio, source, label))
    benign = (
        pool.filter(F.col(label) == 0)
        .withColumnRenamed(source, "_home")
        .withColumn("_pool", F.lit(0))
        .withColumn("_key", hash_hex(seed, F.col("_home"), F.col(key)))
    )
    sizes = sized(group_sizes(benign, ["_pool"]), F.col("n"))
    available = F.lit(sizes.largest)
    slots = number_line(needs.table, F.least(F.col("need"), available), "slot").select(F.lit(0).alias("_pool"), source, "slot")
    added = take_slots(benign, ["_pool"], "_key", sizes, slots, bucket_rows)
    own = lookup_join(attack, needs.derive(needs.table.select(source)), [source], "left_semi")
    return own.withColumn("mixed_in", F.lit(False)).unionByName(
        added.withColumn("mixed_in", F.lit(True)).select(*attack.columns, "mixed_in")
    )


def resize(
    df: DataFrame,
    targets: DataFrame,
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Bring each source to `target` rows by stratified draws with replacement, up or down.

    `targets` holds `source, target`; a source of exactly that size, or without a target,
    passes whole.
    """
    counts = group_sizes(df, [source, label]).join(targets.select(source, "target"), source, "left")
    goal = F.coalesce(F.col("target"), F.sum("n").over(W.partitionBy(source)))
    quotas = share_out(counts.withColumn("_goal", goal), [source], label, F.col("_goal"))
    quotas = quotas.withColumn("sampled", F.col("n_source") != F.col("_goal"))
    return _sample_or_keep(df, quotas, source, label, seed, key, True, bucket_rows)


def rebalance(
    df: DataFrame,
    seed: int = 42,
    source: str = "client_id",
    label: str = "label",
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Move each source towards equal classes without growing it.

    With h = floor(n / 2): the smaller class keeps all rows and gains min(h - size, size)
    draws with replacement; the larger is cut to h rows. Sources with one class, equal
    classes or no gap pass whole. `draw` is 0 for original rows. Labels may be numbers or texts: 0
    and BENIGN are one class, everything else, null included, is the other.
    """
    benign = is_benign(F.col(label))
    counts = df.groupBy(source).agg(F.count_if(benign).alias("_n0"), F.count_if(~benign).alias("_n1"))
    half = F.floor((F.col("_n0") + F.col("_n1")) / 2)
    minor, gap = F.least("_n0", "_n1"), half - F.least("_n0", "_n1")
    plan = counts.filter((minor > 0) & (F.col("_n0") != F.col("_n1")) & (gap > 0)).select(
        source,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("cls"), F.col("_n0").alias("n"), (F.col("_n0") > F.col("_n1")).alias("major")),
                F.struct(F.lit(1).alias("cls"), F.col("_n1").alias("n"), (F.col("_n1") > F.col("_n0")).alias("major")),
            )
        ).alias("p"),
        half.alias("half"),
    )
    plan = plan.select(source, F.col("p.cls").alias("_cls"), F.col("p.n").alias("n"), F.col("p.major").alias("_major"), "half")
    plan = sized(plan)
    classed = df.withColumn("_cls", F.when(benign, 0).otherwise(1))
    changed = plan.derive(plan.table.select(source).distinct())
    untouched = lookup_join(df, changed, [source], "left_anti").withColumn("draw", F.lit(0).cast("bigint"))
    keep = plan.derive(plan.table.withColumn("quota", F.when(F.col("_major"), F.col("half")).otherwise(F.col("n"))))
    active = lookup_join(classed, changed, [source], "left_semi")
    groups = [source, "_cls"]
    kept = draw_rows(active, keep, groups, seed, key, False, bucket_rows)
    top_up = plan.table.filter(~F.col("_major")).withColumn("quota", F.least(F.col("half") - F.col("n"), F.col("n")))
    added = draw_rows(active, plan.derive(top_up), groups, seed, key, True, bucket_rows)
    return untouched.unionByName(kept.unionByName(added).drop("_cls"))


def shuffle_rows(df: DataFrame, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Random row order: a `shuffle_key` to order by, rows laid out in ranges of it."""
    keyed = df.withColumn("shuffle_key", hash_hex(seed, F.col(key)))
    return keyed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def clean_validation(
    perturbed: DataFrame,
    clean: DataFrame,
    columns: list[str],
    quality: str = "quality",
    key: str = "row_id",
    split: str = "split",
    tiers: tuple[str, ...] = ("medium", "low"),
    source: str = "client_id",
) -> DataFrame:
    """Validation rows; in `tiers` the values of `columns` come from the clean parent rows."""
    own = perturbed.filter(F.col(split) == "val")
    same = row_key(source, key, perturbed, clean)
    parent = clean.select(*same, *[F.col(c).alias(f"_clean_{c}") for c in columns], F.lit(True).alias("_parent"))
    joined = own.join(parent, same, "left")
    use = F.coalesce(F.col(quality).isin(*tiers) & F.col("_parent"), F.lit(False))
    swapped = joined.withColumns({c: F.when(use, F.col(f"_clean_{c}")).otherwise(F.col(c)) for c in columns})
    return swapped.withColumn("from_parent", use).drop("_parent", *[f"_clean_{c}" for c in columns])
