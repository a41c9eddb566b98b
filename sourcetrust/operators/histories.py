"""Ordered work along long histories, in blocks of rounds that several tasks share.

* `numbered_rounds` gives every row its place in its source's history.
* `folded` runs a fold whose steps are clamped affine maps. Such maps compose, so a block of steps
  has a summary of four numbers; the trust a block begins with follows from the summaries of the
  blocks before it, found in the same way, block of blocks by block of blocks. Then every block folds
  its own steps from there.
* `recent_frames` lets a window look back a few rows across the border of a block.

No array holds more than a block, and no task needs a whole history. Tables of a row per source or
block grow with the sources and are packed tightly, so they are sort-merged by hint: by the size of
their files the optimiser would send them through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sourcetrust.operators.joins import sized

BLOCK = 256  # steps that are folded in one array


def numbered_rounds(rows: DataFrame, source: str = "client_id", order: str = "round", block: int = 1 << 14) -> DataFrame:
    """Add `_i`, the 0-based place of a row in its source's `order` (an integer column)."""
    spans = rows.withColumn("_span", F.floor(F.col(order) / block))
    counts = spans.groupBy(source, "_span").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(source).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    begun = counts.select(source, "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begun"))
    place = F.row_number().over(W.partitionBy(source, "_span").orderBy(order)) - 1
    return spans.withColumn("_place", place).join(begun.hint("merge"), [source, "_span"]).withColumn(
        "_i", (F.col("_begun") + F.col("_place")).cast("long")
    ).drop("_span", "_place", "_begun")


# x -> least(hi, greatest(lo, a x + b)), with a >= 0, for values from 0 to 1


def affine(a: Column, b: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Bounds are 0 and 1 if not given."""
    low, high = F.lit(0.0) if lo is None else lo, F.lit(1.0) if hi is None else hi
    return F.struct(*[c.cast("double").alias(n) for c, n in ((a, "a"), (b, "b"), (low, "lo"), (high, "hi"))])


def applied(step: Column, x: Column) -> Column:
    return F.least(step["hi"], F.greatest(step["lo"], step["a"] * x + step["b"]))


def composed(first: Column, second: Column) -> Column:
    """The map that applies `first`, then `second`."""
    return affine(second["a"] * first["a"], second["a"] * first["b"] + second["b"], applied(second, first["lo"]), applied(second, first["hi"]))


def entering(steps: DataFrame, starts: DataFrame, last: int, source: str, block: int = BLOCK) -> DataFrame:
    """source, _b, _x: the value that every block of steps begins with.

    `steps` holds source, `_i` (0-based, at most `last`) and the map `_f`; `starts` source and `_x`.
    """
    if last < block:
        return starts.select(source, F.lit(0).cast("long").alias("_b"), "_x")
    own = steps.groupBy(source, F.floor(F.col("_i") / block).cast("long").alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_f"))).alias("_s")
    )
    nothing = affine(F.lit(1.0), F.lit(0.0))
    summary = F.aggregate("_s", nothing, lambda f, s: composed(f, s["_f"]))
    blocks = sized(own.select(source, F.col("_b").alias("_i"), summary.alias("_f"))).table
    above = entering(blocks, starts, last // block, source, block)
    values = _folded(blocks, above, source, block, lambda s: applied(s["_f"], s["_x"]), [])
    # what a block leaves behind is what the next one begins with
    begun = values.select(source, (F.col("_i") + 1).alias("_b"), F.col("_y").alias("_x"))
    return starts.select(source, F.lit(0).cast("long").alias("_b"), "_x").unionByName(begun)


def _folded(steps: DataFrame, begun: DataFrame, source: str, block: int, step: Callable[[Column], Column], carried: list[str]) -> DataFrame:
    """source, _i, _x (before the step), _y (after it) and the `carried` columns."""
    member = F.struct("_i", "_f", *carried)
    own = steps.groupBy(source, F.floor(F.col("_i") / block).cast("long").alias("_b")).agg(F.array_sort(F.collect_list(member)).alias("_s"))
    met = own.join(begun.hint("merge"), [source, "_b"])
    first = F.struct(F.col("_x").alias("x"), F.array().cast("array<double>").alias("seen"))

    def one(state: Column, s: Column) -> Column:
        y = step({"_f": s["_f"], "_x": state["x"]})
        return F.struct(y.alias("x"), F.concat(state["seen"], F.array(state["x"])).alias("seen"))

    # only numbers are gathered: the value before every step, and the last one
    run = F.aggregate("_s", first, one, lambda st: F.concat(st["seen"], F.array(st["x"])))
    made = met.withColumn("_v", run).select(source, "_v", F.posexplode("_s").alias("_k", "_e"))
    return made.select(
        source, "_e._i", F.get("_v", F.col("_k")).alias("_x"), F.get("_v", F.col("_k") + 1).alias("_y"), *[F.col(f"_e.{c}") for c in carried]
    )


def folded(steps: DataFrame, starts: DataFrame, carried: list[str], source: str = "client_id", block: int = BLOCK) -> DataFrame:
    """source, _i, _x and _y (the value before and after each step) and the `carried` columns of `steps`.

    `steps` holds source, `_i` (0-based place, each once) and the map `_f` (`affine`); `starts` one
    row per source with `_x`.
    """
    last = steps.agg(F.max("_i")).first()[0] or 0
    begun = entering(steps, starts, last, source, block)
    return _folded(steps, begun, source, block, lambda s: applied(s["_f"], s["_x"]), carried)


def recent_frames(rows: DataFrame, back: int, add: Callable[[object], dict[str, Column]], source: str = "client_id", block: int = 1 << 14) -> DataFrame:
    """Add columns over windows that look back at most `back` rows; `rows` holds `_i`.

    A block's last rows also go to the next block, where they are only looked at. `add` makes the
    columns from a window specification ordered by `_i`.
    """
    own = F.floor(F.col("_i") / block).cast("long")
    both = F.when(F.col("_i") % block >= block - back, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_b", F.explode(both))
    order = W.partitionBy(source, "_b").orderBy("_i")
    return dealt.withColumns(add(order)).filter(F.col("_b") == own).drop("_b")
