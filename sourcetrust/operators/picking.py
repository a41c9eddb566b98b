"""Exact "first k of a group" and "k-th row of a group" without sorting whole groups.

A group may hold a third of all rows, so no window ever spans a whole large group. Rows are ordered
by text keys, mostly uniform hex hashes. `key_cuts` finds the key of the quota-th row by descent:
for groups whose open bucket is above `BUCKET_ROWS` rows it counts the rows by the next `DIGITS`
characters after the bucket's common prefix, keeps the one bucket that holds the row, and goes on
there. So each group has a prefix of its own length, a group has at most 16 ** DIGITS counts at a
time, and only the last bucket is sorted.

* `hash_cuts`: the cut of each group in hash order. "rank <= quota" then becomes "hash <= cut": a
  filter, not a shuffle.
* `score_cuts`: the same for rows ordered by an integer score, ties broken by hash.
* `take_slots` fetches the rows at given ranks. Only buckets that are asked for are sorted.
* `medians`: of numbers per group, by the order-preserving digits of doubles.

Groups no larger than a bucket are ranked directly, on the key columns alone. Hashes must
be unique within a group (hash a unique row key). Cuts are stored once found, so that a
chain of operators does not search for them again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sourcetrust.operators.joins import Sized, lookup_join, sized

BUCKET_ROWS = 100_000
DIGITS = 3  # characters of a key that one step of a descent looks at
HIGHEST = (1 << 63) - 1


def prefix_length(largest: int, bucket_rows: int) -> int:
    """Hex digits needed so that the largest group splits into buckets of `bucket_rows`."""
    if largest <= bucket_rows:
        return 0
    return math.ceil(math.log(largest / bucket_rows, 16))


def group_sizes(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(F.count("*").alias("n"))


def _is_open() -> Column:
    """The quota takes some but not all rows of the group."""
    return (F.col("quota") > 0) & (F.col("quota") < F.col("n"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of characters that two texts share from the start."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    same = lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)
    return F.size(F.filter(places, same))


def _narrowed(keys: DataFrame, groups: list[str], key: str, wide: Sized, digits: int) -> DataFrame:
    """Of each group the bucket that holds its row: groups, _p (prefix), _left (rank inside), _c (rows), _alike, _stuck.

    `_alike`: all keys of the bucket are `_p`; `_stuck`: all rows looked at lie in this bucket. Only numbers
    are added up by text, which hash aggregation can do; the ends of a bucket are looked for when it is stuck.
    """
    inside = lookup_join(keys, wide.derive(wide.table.select(*groups, "_p")), groups, "inner").filter(F.col(key).startswith(F.col("_p")))
    digit = F.substring(F.col(key), F.length("_p") + 1, F.lit(digits))
    counts = inside.groupBy(*groups, "_p", digit.alias("_d")).agg(F.count("*").alias("_c"))
    before = W.partitionBy(*groups).orderBy("_d").rowsBetween(W.unboundedPreceding, -1)
    sums = {"_before": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_all": F.sum("_c").over(W.partitionBy(*groups))}
    placed = counts.withColumns(sums).join(wide.table.select(*groups, "_left"), groups)
    held = placed.filter((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_c")))
    return held.select(
        *groups, F.concat("_p", "_d").alias("_p"), (F.col("_left") - F.col("_before")).alias("_left"), "_c",
        (F.length("_d") < digits).alias("_alike"), (F.col("_c") == F.col("_all")).alias("_stuck"),
    )


def _entered(keys: DataFrame, groups: list[str], key: str, stuck: Sized) -> DataFrame:
    """Stuck buckets, entered as deep as their keys agree: groups, _p, _left, _c, _alike."""
    inside = lookup_join(keys, stuck.derive(stuck.table.select(*groups, "_p")), groups, "inner").filter(F.col(key).startswith(F.col("_p")))
    ends = inside.groupBy(*groups).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    deep = F.substring(F.col("_lo"), F.lit(1), common_prefix(F.col("_lo"), F.col("_hi")))
    return stuck.table.drop("_p", "_alike").join(ends, groups).select(
        *groups, deep.alias("_p"), "_left", "_c", (F.col("_lo") == F.col("_hi")).alias("_alike")
    )


def key_cuts(
    df: DataFrame, groups: list[str], key: str, quotas: DataFrame | Sized, bucket_rows: int = BUCKET_ROWS, digits: int = DIGITS,
    prefixes: DataFrame | None = None,
) -> Sized:
    """Per group, the key of the quota-th row in the order of text keys: `groups, n, quota, cut`.

    `quotas` holds one row per group: `groups`, `n` (rows of the group) and `quota`. Keys may repeat.
    `cut` has no meaning when the quota takes all or none. `prefixes` holds groups and `_p`, what all keys
    of a group begin with, where it is known: the descent begins below it.
    """
    quotas = sized(quotas, F.when(_is_open(), F.col("n")))
    table = quotas.table.select(*groups, "n", "quota")
    if quotas.largest == 0:  # every quota takes all rows or none
        return quotas.derive(table.withColumn("cut", F.lit(None).cast("string")))
    keys = df.select(*groups, key)
    open_ = table.filter(_is_open()).select(*groups, F.lit("").alias("_p"), F.col("quota").alias("_left"), F.col("n").alias("_c"))
    ready, found, largest = [open_.filter(F.col("_c") <= bucket_rows).select(*groups, "_p", "_left")], [], quotas.largest
    wide = quotas.derive(open_.filter(F.col("_c") > bucket_rows))
    if prefixes is not None and largest > bucket_rows:
        wide = quotas.derive(wide.table.drop("_p").join(prefixes, groups))
    alike, small = F.col("_alike"), F.col("_c") <= bucket_rows
    while largest > bucket_rows:
        low = sized(_narrowed(keys, groups, key, wide, digits), F.when(~alike, F.col("_c")))
        stuck = sized(low, F.when(~alike & ~small & F.col("_stuck"), F.col("_c")))
        moved = low.table.filter(alike | small | ~F.col("_stuck")).drop("_stuck")
        if stuck.largest:
            some = stuck.derive(low.table.filter(~alike & ~small & F.col("_stuck")).drop("_stuck"))
            low = sized(moved.unionByName(_entered(keys, groups, key, some)), F.when(~alike, F.col("_c")))
            moved = low.table
        found.append(moved.filter(alike).select(*groups, F.col("_p").alias("cut")))
        ready.append(moved.filter(~alike & small).select(*groups, "_p", "_left"))
        wide, largest = low.derive(moved.filter(~alike & ~small)), low.largest
    buckets = ready[0]
    for more in ready[1:]:
        buckets = buckets.unionByName(more)
    edge = lookup_join(keys, quotas.derive(buckets), groups, "inner").filter(F.col(key).startswith(F.col("_p")))
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(key))
    cuts = edge.withColumn("_rank", rank).filter(F.col("_rank") == F.col("_left")).select(*groups, F.col(key).alias("cut"))
    for one in found:
        cuts = cuts.unionByName(one)
    return sized(lookup_join(table, quotas.derive(cuts), groups))


def hash_cuts(
    df: DataFrame, groups: list[str], key: str, quotas: DataFrame | Sized, bucket_rows: int = BUCKET_ROWS
) -> Sized:
    """Per group, the hash of the quota-th row in hash order: `groups, n, quota, cut`, as `key_cuts`."""
    return key_cuts(df, groups, key, quotas, bucket_rows)


def picked_by_hash(key: str, n: str = "n", quota: str = "quota", cut: str = "cut") -> Column:
    """True for the first `quota` rows of the group, given the columns of `hash_cuts`."""
    some = F.when(F.col(quota) >= F.col(n), True).when(F.col(quota) <= 0, False).otherwise(F.col(key) <= F.col(cut))
    return F.coalesce(some, F.lit(False))


def mark_first(
    df: DataFrame,
    groups: list[str],
    key: str,
    quotas: DataFrame | Sized,
    flag: str,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add a boolean `flag` that is true for the first `quota` rows per group in hash order."""
    cuts = hash_cuts(df, groups, key, quotas, bucket_rows)
    renamed = cuts.table.withColumnsRenamed({"n": "_n", "quota": "_quota", "cut": "_cut"})
    marked = lookup_join(df, cuts.derive(renamed), groups)
    return marked.withColumn(flag, picked_by_hash(key, "_n", "_quota", "_cut")).drop("_n", "_quota", "_cut")


def score_cuts(
    df: DataFrame,
    groups: list[str],
    score: str,
    key: str,
    quotas: DataFrame | Sized,
    bucket_rows: int = BUCKET_ROWS,
) -> Sized:
    """Per group, the (score, hash) of the quota-th row by descending integer score, ties by hash.

    The key of a row is the distance of its score from the highest possible one, in hexadecimal
    digits, and then its hash. Scores are not negative. Returns `groups, n, quota, score_cut, cut`.
    """
    reach = F.lpad(F.hex(F.lit(HIGHEST) - F.col(score)), 16, "0")
    keyed = df.select(*groups, F.concat(reach, F.col(key)).alias("_key"))
    quotas, prefixes = sized(quotas, F.when(_is_open(), F.col("n"))), None
    if quotas.largest > bucket_rows:  # keys agree as far as those of the highest and the lowest score do
        ends = df.groupBy(*groups).agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
        far = [F.lpad(F.hex(F.lit(HIGHEST) - F.col(c)), 16, "0") for c in ("_lo", "_hi")]
        prefixes = sized(ends.select(*groups, F.substring(far[0], F.lit(1), common_prefix(*far)).alias("_p"))).table
    cuts = key_cuts(keyed, groups, "_key", quotas, bucket_rows, prefixes=prefixes)
    back = F.lit(HIGHEST) - F.conv(F.substring("cut", 1, 16), 16, 10).cast("bigint")
    return cuts.derive(cuts.table.withColumn("score_cut", back).withColumn("cut", F.substring("cut", 17, 64)).select(*groups, "n", "quota", "score_cut", "cut"))


# fixed values: how hexadecimal digits are turned round, and the bias of a double's exponent
UP, DOWN, BIAS = "0123456789abcdef", "fedcba9876543210", 1100


def double_key(x: Column) -> Column:
    """19 hexadecimal digits in the order of doubles; NaN is the largest."""
    # Java prints a double's bits as 0x1.<mantissa>p<exponent>
    shown = F.format_string("%a", F.abs(x))
    exponent = F.regexp_extract(shown, r"p(-?\d+)$", 1).cast("int") + BIAS
    digits = F.concat(
        F.lpad(F.lower(F.hex(exponent.cast("bigint"))), 4, "0"), F.regexp_extract(shown, r"^0x(\d)", 1),
        F.rpad(F.regexp_replace(F.regexp_extract(shown, r"\.([0-9a-f]+)p", 1), "^0$", ""), 13, "0"),
    )
    digits = F.when(x == 0, "0" * 18).when(F.abs(x) == F.lit(float("inf")), "f" * 18).otherwise(digits)
    signed = F.when(x < 0, F.concat(F.lit("0"), F.translate(digits, UP, DOWN))).otherwise(F.concat(F.lit("1"), digits))
    return F.when(F.isnan(x), "2" + "0" * 18).otherwise(signed)


def medians(df: DataFrame, groups: list[str], value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """groups and `out`, the exact median of the doubles of each group; nulls do not count.

    A group no larger than a bucket is taken directly; in a larger one the lower middle value is found
    by descent and the upper one is it too or the next value. NaN is the largest number.
    """
    rows = df.select(*groups, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    half = F.floor((F.col("n") + 1) / 2)
    sizes = sized(group_sizes(rows, groups).withColumn("quota", half), F.col("n"))
    direct = rows
    if sizes.largest > bucket_rows:
        few = sizes.derive(sizes.table.filter(F.col("n") <= bucket_rows).select(*groups))
        direct = lookup_join(rows, few, groups, "left_semi") if groups else rows.limit(0)
    found = direct.groupBy(*groups).agg(F.median("_v").alias(out))
    if sizes.largest <= bucket_rows:
        return found
    many = sizes.derive(sizes.table.filter(F.col("n") > bucket_rows))
    whole = F.lit(0).alias("_whole")  # names the one group there is without groups
    keyed = rows.select("*", whole, double_key(F.col("_v")).alias("_key"))
    by = [*groups, "_whole"]
    cuts = key_cuts(keyed, by, "_key", many.derive(many.table.select("*", whole)), bucket_rows)
    near = lookup_join(keyed, cuts.derive(cuts.table.select(*by, "n", "cut")), by, "inner")
    below = F.col("_key") <= F.col("cut")
    middle = near.groupBy(*by).agg(
        F.max("n").alias("n"), F.count_if(below).alias("_k"), F.max(F.when(below, F.col("_v"))).alias("_lower"),
        F.min(F.when(~below, F.col("_v"))).alias("_next"),
    )
    upper = F.when(F.col("_k") >= F.floor(F.col("n") / 2) + 1, F.col("_lower")).otherwise(F.col("_next"))
    large = middle.select(*groups, ((F.col("_lower") + upper) / 2).alias(out))
    return large.unionByName(found) if groups else large


def picked_by_score(score: str, key: str, n: str = "n", quota: str = "quota", cut: str = "cut") -> Column:
    """True for the first `quota` rows by (score desc, hash), given `score_cuts` columns."""
    inside = (F.col(score) > F.col("score_cut")) | ((F.col(score) == F.col("score_cut")) & (F.col(key) <= F.col(cut)))
    some = F.when(F.col(quota) >= F.col(n), True).when(F.col(quota) <= 0, False).otherwise(inside)
    return F.coalesce(some, F.lit(False))


def number_line(df: DataFrame, upto: Column, name: str, block: int = 10_000) -> DataFrame:
    """One row per integer 1..`upto`; exploded in two steps so that no array grows long.

    Blocks are dealt over the tasks first, as the table is small and its numbers may be many.
    """
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((upto - 1) / block).cast("bigint"))
    within = F.sequence(
        F.col("_block") * block + 1, F.least(upto.cast("bigint"), (F.col("_block") + 1) * block)
    )
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.filter(upto > 0).withColumn("_block", F.explode(blocks)).repartition(spread)
    return dealt.withColumn(name, F.explode(within)).drop("_block")


def take_slots(
    df: DataFrame,
    groups: list[str],
    key: str,
    sizes: DataFrame | Sized,
    slots: DataFrame,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Fetch the rows at the hash-order ranks in `slots` (`groups`, `slot`, any further columns).

    `sizes` holds `groups, n`. A slot may be asked for many times (draws with replacement). Slots come out
    of few rows, which the optimiser takes for a small table, so their joins are sort-merge joins by hint:
    they never travel through the driver.
    """
    sizes = sized(sizes, F.col("n"))
    if prefix_length(sizes.largest, bucket_rows) == 0:
        asked = slots.withColumnRenamed("slot", "_at")
        bucketed = lookup_join(df, sizes.derive(sizes.table.select(*groups)), groups, "left_semi")
        rank = F.row_number().over(W.partitionBy(*groups).orderBy(key)).cast("bigint")
        return asked.hint("merge").join(bucketed.withColumn("_at", rank), [*groups, "_at"]).drop("_at")

    # a group's buckets are as deep as its own size asks for
    depth = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n") / bucket_rows))).cast("int")
    depths = sizes.derive(sizes.table.select(*groups, depth.alias("_depth")))
    bucketed = lookup_join(df, depths, groups, "inner").withColumn("_b", F.substring(F.col(key), F.lit(1), F.col("_depth"))).drop("_depth")
    counts = bucketed.groupBy(*groups, "_b").agg(F.count("*").alias("_c"))
    before = W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    block = lambda c: F.floor(c / bucket_rows).cast("bigint")
    spans = (
        counts.withColumn("_lo", F.coalesce(F.sum("_c").over(before), F.lit(0)).cast("bigint"))
        .withColumn("_block", F.explode(F.sequence(block(F.col("_lo") + 1), block(F.col("_lo") + F.col("_c")))))
    )
    asked = (
        lookup_join(slots.withColumn("_block", block(F.col("slot"))), sized(spans), [*groups, "_block"], "inner")
        .filter((F.col("slot") > F.col("_lo")) & (F.col("slot") <= F.col("_lo") + F.col("_c")))
        .withColumn("_at", F.col("slot") - F.col("_lo"))
        .drop("_block", "_lo", "_c", "slot")
    )
    needed = asked.select(*groups, "_b").distinct()
    rank = F.row_number().over(W.partitionBy(*groups, "_b").orderBy(key)).cast("bigint")
    ranked = lookup_join(bucketed, needed, [*groups, "_b"], "left_semi").withColumn("_at", rank)
    return asked.hint("merge").join(ranked, [*groups, "_b", "_at"]).drop("_b", "_at")
