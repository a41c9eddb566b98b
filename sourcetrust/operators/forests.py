"""Forests and boosted trees of every source, grown together level by level.

Features are binned once. A level of all trees of all sources is one aggregate: counts by source,
tree, node, feature and bin. The best split of every node is chosen from these counts, and the rows
move to the children. A task never needs a whole source, and what grows with the data are only the
binned rows. Rows of a source in the same bins take the same way in every tree: where borders are few,
they are one row with the sums of their weights.

Rows carry `x` (array of features), a 0/1 label and a key that is unique within the source. Sampling
and the choice of features are hashes, so a repeated task makes the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sourcetrust.functions.keys import hash_hex
from sourcetrust.functions.vectors import sigmoid
from sourcetrust.operators.deep_forests import POISSON, bin_edges
from sourcetrust.operators.joins import MAX_BROADCAST_CELLS, lookup_join, sized
from sourcetrust.operators.models import in_order

UNITS = 10**9  # gradients are added as whole numbers of this size, so in any order alike
MAX_BIN_CELLS = 2**20  # combinations of bins up to which rows in the same bins are added up


@dataclass(frozen=True)
class Growth:
    """How trees grow. `kind` is `gini` (u: ones, v: rows) or `newton` (u: gradients, v: curvatures)."""

    kind: str = "gini"
    trees: int = 20
    depth: int = 6
    min_leaf: int = 4
    features: int | None = None  # tried per node; none: all
    bagging: bool = True
    shrink: float = 1.0  # added to the curvature
    seed: int = 42

    def worth(self, u: Column, v: Column) -> Column:
        """What a node is worth unsplit; a split gains what its children are worth more."""
        if self.kind == "gini":
            return -2.0 * u * (v - u) / v
        return u * u / (v + F.lit(self.shrink)) / 2.0

    def value(self, u: Column, v: Column) -> Column:
        return u / v if self.kind == "gini" else -u / (v + F.lit(self.shrink))

    def scale(self, s: Column) -> Column:
        return s.cast("double") if self.kind == "gini" else s / float(UNITS)


def binned(df: DataFrame, edges: list[list[float]], source: str, label: str, key: str) -> DataFrame:
    """source, key, y and b, the number of borders below each feature."""
    place = [_below(e, F.get("x", F.lit(i))) for i, e in enumerate(edges)]
    return df.select(source, F.col(key).alias("key"), F.col(label).cast("long").alias("y"), F.array(*place).alias("b"))


def _below(borders: list[float], value: Column) -> Column:
    return _how_many(F.lit(float(v)) < value for v in borders)


def _how_many(conditions: Iterable[Column]) -> Column:
    found = F.lit(0)
    for condition in conditions:
        found = found + F.when(condition, 1).otherwise(0)
    return found


def _poisson(hex_: Column) -> Column:
    """How many of the summed probabilities the hash's first 32 bits, as a share, are not below."""
    return _how_many(hex_ >= f"{math.ceil(p * 2**32):08x}" for p in POISSON)


def _weighted(rows: DataFrame, growth: Growth) -> DataFrame:
    """Rows with `w0`, `w1`, ...: how often the bootstrap of each tree draws them; without `key`."""
    names = [f"w{tree}" for tree in range(growth.trees)]
    if not growth.bagging:
        return rows.withColumns({name: F.lit(1).cast("long") for name in names}).drop("key")
    hashed = rows.withColumns({name: hash_hex(growth.seed, F.col("key"), tree) for tree, name in enumerate(names)})
    return hashed.withColumns({name: _poisson(F.col(name)).cast("long") for name in names}).drop("key")


def _together(rows: DataFrame, growth: Growth, edges: list[list[float]], source: str) -> DataFrame:
    """One row per source, label and bins, with the sums of the weights, if so many borders allow few combinations."""
    sizes = [len(e) + 1 for e in edges]
    if math.prod(sizes) > MAX_BIN_CELLS:
        return rows
    steps = [math.prod(sizes[i + 1:]) for i in range(len(sizes))]
    cell = F.lit(0)
    for i, step in enumerate(steps):
        cell = cell + F.get("b", F.lit(i)) * step
    names = [f"w{tree}" for tree in range(growth.trees)]
    added = rows.select(source, "y", cell.alias("cell"), *names).groupBy(source, "y", "cell").agg(*[F.sum(name).alias(name) for name in names])
    bins = [(F.floor(F.col("cell") / step) % size).cast("int") for step, size in zip(steps, sizes, strict=True)]
    return added.select(source, "y", F.array(*bins).alias("b"), *names)


def _per_source(table: DataFrame, source: str, entry: Column) -> DataFrame:
    """One row per source: `_t`, a map from tree to the array of `entry` in node order."""
    arrays = table.groupBy(source, "tree").agg(F.array_sort(F.collect_list(F.struct("node", entry.alias("e")))).alias("_n"))
    arrays = arrays.select(source, "tree", F.transform("_n", lambda n: n["e"]).alias("_n"))
    return arrays.groupBy(source).agg(
        F.map_from_entries(F.collect_list(F.struct("tree", "_n"))).alias("_t"), F.sum(F.size("_n")).alias("_cells")
    )


def _with_source(rows: DataFrame, table: DataFrame, source: str) -> DataFrame:
    known = sized(table, F.col("_cells"))
    slim = known.derive(known.table.drop("_cells"))
    return lookup_join(rows, slim, [source], "inner", MAX_BROADCAST_CELLS // max(1, 8 * known.largest))


def grow(rows: DataFrame, growth: Growth, width: int, source: str) -> DataFrame:
    """The trees of `rows` (source, key or weights as of `_weighted`, u, v, b): source, tree, level, node, feature, bin, child, value, u, v, n, gain.

    `node` counts from 0 within its level; an inner node's children are `child` and `child` + 1 of the
    next level, rows with at most `bin` go to the first. A leaf has a null feature.
    """
    weighted = rows if "w0" in rows.columns else _weighted(rows, growth)
    weights = F.array(*[F.col(f"w{tree}") for tree in range(growth.trees)])
    state = weighted.select(source, "u", "v", "b", weights.alias("w"), F.array_repeat(F.lit(0), growth.trees).alias("nodes"))
    sources = rows.select(source).distinct()
    nodes = sources.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(growth.trees - 1)))).withColumn("node", F.lit(0))
    stats, done, level = None, [], 0
    while True:
        found = sized(_splits(state, nodes, growth, width, source, level)).table
        if stats is None:  # the roots' sums are those of any feature
            stats = nodes.join(found.select(source, "tree", "node", *[F.col(f"all_{c}").alias(c) for c in "uvn"]), [source, "tree", "node"], "left")
        split = found.filter("gain IS NOT NULL")
        rank = F.row_number().over(W.partitionBy(source, "tree").orderBy("node"))
        split = sized(split.withColumn("child", (2 * (rank - 1)).cast("int")))
        inner = split.table.select(source, "tree", "node", "feature", "bin", "child", "gain")
        done.append(sized(stats.join(inner, [source, "tree", "node"], "left").withColumn("level", F.lit(level))).table)
        if not split.rows:
            break
        sides = F.explode(F.array(*[
            F.struct((F.col("child") + i).alias("node"), *[F.col(f"{side}_{c}").alias(c) for c in "uvn"]) for i, side in enumerate(("left", "right"))
        ]))
        stats = sized(split.table.select(source, "tree", sides.alias("c")).select(source, "tree", "c.*")).table
        level += 1
        if level == growth.depth:
            none = {"feature": "int", "bin": "int", "child": "int", "gain": "double"}
            done.append(stats.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"level": F.lit(level)}))
            break
        state, nodes = sized(_moved(state, nodes, inner, source)).table, stats.select(source, "tree", "node")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    u, v = growth.scale(F.col("u")), growth.scale(F.col("v"))
    return whole.select(
        source, "tree", "level", "node", "feature", "bin", "child", growth.value(u, v).alias("value"), u.alias("u"), v.alias("v"), "n", "gain"
    )


def _splits(state: DataFrame, nodes: DataFrame, growth: Growth, width: int, source: str, level: int) -> DataFrame:
    """Best split of every node: source, tree, node, feature, bin, gain (null: none), sums of both sides and of all."""
    tried = growth.features or width
    every = F.sequence(F.lit(0), F.lit(width - 1))
    if tried < width:
        order = F.array_sort(F.transform(every, lambda f: F.struct(hash_hex(growth.seed, F.col("tree"), F.lit(level), F.col("node"), f).alias("h"), f.alias("f"))))
        every = F.transform(F.slice(order, 1, tried), lambda e: e["f"])
    looked = _with_source(state, _per_source(nodes, source, every), source)
    placed = looked.select(source, "u", "v", "w", "b", "_t", F.posexplode("nodes").alias("tree", "node")).filter("node >= 0")
    placed = placed.withColumn("w", F.get("w", F.col("tree"))).filter("w > 0")
    features = F.element_at(F.element_at("_t", F.col("tree")), F.col("node") + 1)
    cells = placed.select(
        source, "tree", "node", (F.col("u") * F.col("w")).alias("u"), (F.col("v") * F.col("w")).alias("v"), "w", "b", F.explode(features).alias("feature")
    ).select(source, "tree", "node", "feature", F.element_at("b", F.col("feature") + 1).alias("bin"), "u", "v", "w")
    at = [source, "tree", "node"]
    hist = cells.groupBy(*at, "feature", "bin").agg(F.sum("u").alias("u"), F.sum("v").alias("v"), F.sum("w").alias("n"))
    upto = W.partitionBy(*at, "feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*at, "feature")
    summed = hist.select(
        *at, "feature", "bin", *[F.sum(c).over(upto).alias(f"left_{c}") for c in "uvn"], *[F.sum(c).over(whole).alias(f"all_{c}") for c in "uvn"]
    ).withColumns({f"right_{c}": F.col(f"all_{c}") - F.col(f"left_{c}") for c in "uvn"})
    side = lambda s: growth.worth(growth.scale(F.col(f"{s}_u")), growth.scale(F.col(f"{s}_v")))
    fits = (F.col("left_n") >= growth.min_leaf) & (F.col("right_n") >= growth.min_leaf)
    gain = F.when(fits, side("left") + side("right") - side("all"))
    names = [f"{s}_{c}" for s in ("left", "right") for c in "uvn"]
    # the largest gain, then the first feature, then the first bin
    best = F.max(F.when(gain > 1e-9, F.struct(
        gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), *names
    ))).alias("best")
    chosen = summed.groupBy(*at).agg(best, *[F.max(f"all_{c}").alias(f"all_{c}") for c in "uvn"])
    return chosen.select(
        *at, (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin"), "best.gain", *[f"best.{n}" for n in names], *[f"all_{c}" for c in "uvn"]
    )


def _moved(state: DataFrame, nodes: DataFrame, inner: DataFrame, source: str) -> DataFrame:
    """Rows at their nodes of the next level; -1 where they are in a leaf."""
    table = nodes.join(inner, [source, "tree", "node"], "left")
    looked = _with_source(state, _per_source(table, source, F.struct("feature", "bin", "child")), source)

    def child(node: Column, tree: Column) -> Column:
        own = F.element_at(F.element_at("_t", tree), F.greatest(node, F.lit(0)) + 1)
        right = F.when(F.element_at("b", own["feature"] + 1) > own["bin"], 1).otherwise(0)
        return F.when((node < 0) | own["feature"].isNull(), -1).otherwise(own["child"] + right)

    return looked.withColumn("nodes", F.transform("nodes", child)).drop("_t")


# the two learners


def fit_forests(
    df: DataFrame, growth: Growth = Growth(), edges: list[list[float]] | None = None, bins: int = 32,
    source: str = "client_id", label: str = "label", key: str = "row_id",
) -> DataFrame:
    """One forest per source; columns as `grow`, with `threshold`. Each tree sees a bootstrap by Poisson weights.

    Sources with a single class or few rows give roots alone, whose value is their share of ones.
    """
    edges = bin_edges(df, bins) if edges is None else edges
    rows = _together(_weighted(binned(df, edges, source, label, key), growth), growth, edges, source)
    rows = sized(rows).table.withColumns({"u": F.col("y"), "v": F.lit(1).cast("long")})
    trees = grow(rows, growth, len(edges), source)
    return _with_thresholds(trees, edges)


def fit_boosted(
    df: DataFrame, rounds: int = 20, rate: float = 0.1, growth: Growth = Growth("newton", 1, 4, 4, None, False),
    edges: list[list[float]] | None = None, bins: int = 32, source: str = "client_id", label: str = "label", key: str = "row_id",
) -> DataFrame:
    """One boosted model per source, as many trees as `rounds`; leaf values are steps of the log-odds, times `rate`."""
    edges = bin_edges(df, bins) if edges is None else edges
    rows = sized(binned(df, edges, source, label, key).withColumn("margin", F.lit(0.0))).table
    grown = []
    for r in range(rounds):
        p = sigmoid(F.col("margin"))
        whole = lambda c: F.round(c * UNITS).cast("long")
        told = rows.withColumns({"u": whole(p - F.col("y")), "v": whole(p * (1 - p))})
        tree = sized(grow(told.drop("margin", "y"), growth, len(edges), source).withColumn("value", F.col("value") * rate)).table
        grown.append(tree.withColumn("tree", F.lit(r)))
        if r + 1 < rounds:
            step = scored_trees(rows, tree, source, lambda n: F.element_at("b", n["feature"] + 1) > n["bin"], "_step")
            rows = sized(step.withColumn("margin", F.col("margin") + F.col("_step")).drop("_step")).table
    trees = grown[0]
    for tree in grown[1:]:
        trees = trees.unionByName(tree)
    return _with_thresholds(trees, edges)


def _with_thresholds(trees: DataFrame, edges: list[list[float]]) -> DataFrame:
    """Adds the border that a split's last bin ends with."""
    borders = F.array(*[F.array(*[F.lit(float(v)) for v in e]) if e else F.array().cast("array<double>") for e in edges])
    return trees.withColumn("threshold", F.get(F.get(borders, F.col("feature")), F.col("bin")))


def scored_trees(rows: DataFrame, trees: DataFrame, source: str, goes_right, out: str) -> DataFrame:
    """Adds the sum of the leaf values that a row reaches in the trees of its source."""
    entry = F.struct("feature", "bin", *(["threshold"] if "threshold" in trees.columns else []), "child", "value")
    levels = trees.groupBy(source, "tree", "level").agg(F.array_sort(F.collect_list(F.struct("node", entry.alias("e")))).alias("_n"))
    levels = levels.select(source, "tree", "level", F.transform("_n", lambda n: n["e"]).alias("_n"))
    whole = levels.groupBy(source, "tree").agg(in_order("level", "_n").alias("_l"), F.sum(F.size("_n")).alias("_cells"))
    split = F.struct(F.get(F.get("_l", F.lit(0)), F.lit(0)).alias("root"), F.slice("_l", 2, F.size("_l")).alias("below"))
    whole = whole.select(source, "tree", split.alias("_l"), "_cells")
    per = whole.groupBy(source).agg(in_order("tree", "_l").alias("_t"), F.sum("_cells").alias("_cells"))
    looked = _with_source(rows, per, source)

    def step(own: Column, nodes: Column) -> Column:
        right = F.when(goes_right(own), 1).otherwise(0)
        return F.when(own["feature"].isNull(), own).otherwise(F.element_at(nodes, own["child"] + right + 1))

    reached = F.transform("_t", lambda tree: F.aggregate(tree["below"], tree["root"], step, lambda own: own["value"]))
    return looked.withColumn(out, F.aggregate(reached, F.lit(0.0), lambda a, v: a + v)).drop("_t")


def score_forests(df: DataFrame, trees: DataFrame, source: str = "client_id", boosted: bool = False, threshold: float = 0.5) -> DataFrame:
    """Add `y_proba` and `y_pred` of each row by the trees of its source (features in `x`)."""
    right = lambda n: F.element_at("x", n["feature"] + 1) > n["threshold"]
    summed = scored_trees(df, trees, source, right, "_sum")
    if boosted:
        proba = sigmoid(F.col("_sum"))
    else:
        count = trees.groupBy(source).agg(F.count_distinct("tree").alias("_trees"))
        summed = lookup_join(summed, sized(count), [source])
        proba = F.col("_sum") / F.col("_trees")
    scored = summed.withColumn("y_proba", proba).drop("_sum", "_trees")
    return scored.withColumn("y_pred", F.when(F.col("y_proba") >= threshold, 1).otherwise(0))


def importances(trees: DataFrame, width: int, source: str = "client_id") -> DataFrame:
    """source, feature_importances: each tree's gains by feature as shares of its sum, averaged over trees; sums to one.

    A source whose trees never split has zeros.
    """
    gains = trees.filter("feature IS NOT NULL").groupBy(source, "tree", "feature").agg(F.sum("gain").alias("g"))
    share = F.col("g") / F.sum("g").over(W.partitionBy(source, "tree"))
    mean = gains.withColumn("s", share).groupBy(source, "feature").agg(F.sum("s").alias("s"))
    mean = mean.withColumn("s", F.col("s") / F.sum("s").over(W.partitionBy(source)))
    maps = mean.groupBy(source).agg(F.map_from_entries(F.collect_list(F.struct("feature", "s"))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.coalesce(F.element_at("_m", f), F.lit(0.0)))
    return trees.select(source).distinct().join(maps, source, "left").select(source, values.alias("feature_importances"))
