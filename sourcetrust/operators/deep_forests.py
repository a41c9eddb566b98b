"""One forest of many deep trees on all rows, as Spark ML's learner grows it: bins, a bootstrap by
Poisson weights, some features tried per node, gini, sibling leaves of one class merged.

That learner sends a block of counts per node, task and pass, which outweighs the rows by far once most
nodes hold few. Here only nodes of more than `NODE_CELLS` numbers are split by counts that tasks send;
the rows of a smaller node go to one task, which grows all that is below it.

Rows carry `x` (array of features) and a 0/1 label. Draws are hashes of a row's number, the tree and the
node's place in the tree (root 1, children 2n and 2n + 1), so a repeated task grows the same trees.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sourcetrust.operators.joins import sized

# fixed values: Poisson probabilities with mean one, summed
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
           0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
NODE_CELLS = 25_000_000  # numbers of a node that one task grows to its end
TREES_A_TASK = 4  # trees that such a task grows from the root
TREES_A_SCORE, ROWS_A_SCORE = 16, 100_000  # trees and rows that meet in one task of the scoring
UNITS = 10**15  # shares are added as whole numbers of this size, so in any order alike
BINS = 32
SETTINGS = {"numTrees", "maxDepth", "minInstancesPerNode"}

NODES = {"heap": np.int64, "feature": np.int16, "bin": np.uint8, "n": np.int64, "ones": np.int64, "gain": np.float64}
PIECE = "tree int, " + ", ".join(f"{name} binary" for name in NODES)


def bin_edges(df: DataFrame, bins: int = 32, accuracy: int = 10_000) -> list[list[float]]:
    """Inner bin borders per feature from approximate quantiles; width * (bins - 1) numbers."""
    shares = [i / bins for i in range(1, bins)]
    some = df.select(F.size("x")).first()
    width, found = max(0, some[0] or 0) if some else 0, []
    while True:  # once, unless a row has more features than the first one
        widest, *found = df.agg(F.max(F.size("x")), *[F.percentile_approx(F.get("x", F.lit(i)), shares, accuracy) for i in range(width)]).first()
        if (widest or 0) <= width:
            return [sorted(set(e or [])) for e in found]
        width = widest


@dataclass(frozen=True)
class Spec:
    """What tasks need to know of a forest."""

    trees: int
    depth: int
    min_leaf: int
    width: int
    seed: int

    @property
    def tried(self) -> int:
        """Features per node: all for a single tree, else the root of their number, as the learner's `auto`."""
        return self.width if self.trees == 1 else math.ceil(math.sqrt(self.width))

    def weights(self, ids: np.ndarray, tree: int) -> np.ndarray:
        """How often a tree's bootstrap draws each row."""
        if self.trees == 1:
            return np.ones(len(ids))
        u = mixed(self.seed, 0, tree, ids) >> np.uint64(11)
        return np.searchsorted(POISSON, u / 2.0**53, side="right").astype(np.float64)

    def features(self, tree: int, heap: np.ndarray) -> np.ndarray:
        """The features tried in each node, in order."""
        if self.tried == self.width:
            return np.tile(np.arange(self.width), (len(heap), 1))
        order = mixed(self.seed, 1, tree, heap[:, None], np.arange(self.width))
        return np.sort(np.argpartition(order, self.tried - 1, axis=1)[:, :self.tried], axis=1)

    def open(self, heap: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Nodes that may be split."""
        return (heap < 1 << self.depth) & (ones > 0) & (ones < n) & (n >= 2 * self.min_leaf)


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of whole numbers (the finaliser of SplitMix64 after each)."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ np.asarray(part).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def best_cut(hist: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the largest gain of a cut and the last bin left of it, from counts by (node, bin, label)."""
    left = hist.cumsum(axis=1)
    whole = left[:, -1:]
    left = left[:, :-1]
    right = whole - left
    worth = lambda c: 2.0 * c[..., 0] * c[..., 1] / np.maximum(c.sum(axis=2), 1)
    fits = (left.sum(axis=2) >= min_leaf) & (right.sum(axis=2) >= min_leaf)
    gain = np.where(fits, worth(whole) - worth(left) - worth(right), 0.0)
    at = gain.argmax(axis=1)
    return gain[np.arange(len(at)), at], at


def counts(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, slot: np.ndarray, nodes: int) -> np.ndarray:
    """Weights by (node, bin, label) of one feature's bins."""
    return np.bincount((slot * BINS + codes) * 2 + y, weights=weight, minlength=nodes * BINS * 2).reshape(nodes, BINS, 2)


def grown(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, tree: int, start: int, spec: Spec) -> dict[str, np.ndarray]:
    """The node `start` of a tree and all below it, level by level; a leaf's feature is -1."""
    rows = np.flatnonzero(weight)
    slot, heap, levels = np.zeros(len(rows), np.int64), np.array([start]), []
    while len(heap):
        total = np.bincount(slot, weights=weight[rows], minlength=len(heap))
        ones = np.bincount(slot, weights=weight[rows] * y[rows], minlength=len(heap))
        feature, bin_, gain = np.full(len(heap), -1), np.zeros(len(heap), np.int64), np.zeros(len(heap))
        tried = np.flatnonzero(spec.open(heap, total, ones))
        place = np.full(len(heap), -1)
        place[tried] = np.arange(len(tried))
        rows, slot = rows[(own := place[slot]) >= 0], own[own >= 0]
        features = spec.features(tree, heap[tried])
        for j in range(features.shape[1] if len(tried) else 0):
            found, at = best_cut(counts(codes[rows, features[slot, j]], y[rows], weight[rows], slot, len(tried)), spec.min_leaf)
            better = found > np.maximum(gain[tried], 1e-9)
            to = tried[better]
            feature[to], bin_[to], gain[to] = features[better, j], at[better], found[better]
        levels.append((heap, feature, bin_, total, ones, gain))
        split = np.flatnonzero(feature >= 0)
        rank = np.full(len(heap), -1)
        rank[split] = np.arange(len(split))
        node = tried[slot]
        rows, node = rows[rank[node] >= 0], node[rank[node] >= 0]
        slot = 2 * rank[node] + (codes[rows, feature[node]] > bin_[node])
        heap = (2 * heap[split][:, None] + np.arange(2)).ravel()
    return {name: np.concatenate(part).astype(kind) for (name, kind), part in zip(NODES.items(), zip(*levels, strict=True), strict=True)}


def coded(some: pa.ChunkedArray | pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of arrays of features: the number of borders below each."""
    if some.null_count:
        raise ValueError("features must not be null")
    x = np.asarray(some.flatten(), np.float64).reshape(len(some), len(edges))
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def _packed(rows: DataFrame, edges: list[np.ndarray], finite: bool) -> DataFrame:
    """Rows (id, y, x) as blocks of bytes: ids, y, codes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            if some.num_rows:
                if finite and not np.isfinite(np.asarray(some.column(2).flatten(), np.float64)).all():
                    raise ValueError("features must not be NaN or infinite")
                blocks = np.asarray(some.column(0), np.int64), np.asarray(some.column(1)).astype(np.uint8), coded(some.column(2), edges)
                yield _bytes(["ids", "y", "codes"], [blocks])

    return rows.select("id", "y", "x").mapInArrow(pack, "ids binary, y binary, codes binary")


def _bytes(names: list[str], rows: list[tuple], **first) -> pa.RecordBatch:
    """Arrays as rows of bytes, after columns of numbers."""
    columns = [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in first.values()), *columns], [*first, *names])


def _unpacked(some: pa.RecordBatch | pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_py(), kind) for v in some[name]])


def _descended(codes: np.ndarray, top: tuple[np.ndarray, ...] | None) -> np.ndarray:
    """The place that each row has reached in a tree's nodes so far (heap in order, feature, bin)."""
    at = np.ones(len(codes), np.int64)
    if top is None:
        return at
    heap, feature, bin_ = top
    moving = np.arange(len(codes))
    while len(moving):
        found = np.minimum(np.searchsorted(heap, at[moving]), len(heap) - 1)
        inner = heap[found] == at[moving]
        moving, found = moving[inner], found[inner]
        at[moving] = 2 * at[moving] + (codes[moving, feature[found]] > bin_[found])
    return at


def _large_splits(blocks: DataFrame, large: dict[int, np.ndarray], tops: dict[int, tuple], spec: Spec) -> list[dict]:
    """Best split of nodes whose rows lie in many tasks: tree, heap, feature (-1: none), bin, gain, counts of both sides."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for some in batches:
            for i in range(some.num_rows):
                one = some.slice(i, 1)
                ids, y = _unpacked(one, "ids", np.int64), _unpacked(one, "y", np.uint8)
                codes = _unpacked(one, "codes", np.uint8).reshape(len(y), spec.width)
                for tree, nodes in large.items():
                    weight, at = spec.weights(ids, tree), _descended(codes, tops.get(tree))
                    for heap, features in zip(nodes, spec.features(tree, nodes), strict=True):
                        own = np.flatnonzero((at == heap) & (weight > 0))
                        zeros = np.zeros(len(own), np.int64)
                        found = np.concatenate([counts(codes[own, f], y[own], weight[own], zeros, 1) for f in features])
                        sums[tree, heap] = sums[tree, heap] + found if (tree, heap) in sums else found
        for (tree, heap), hist in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([heap], pa.int64()), pa.array([hist.tobytes()], pa.binary())], ["tree", "heap", "hist"])

    def chosen(some: pa.Table) -> pa.Table:
        tree, heap = some["tree"][0].as_py(), some["heap"][0].as_py()
        hist = np.sum([np.frombuffer(v.as_py()).reshape(-1, BINS, 2) for v in some["hist"]], axis=0)
        gain, at = best_cut(hist, spec.min_leaf)
        j = int(gain.argmax())
        whole, left = hist[j].sum(axis=0), hist[j, :at[j] + 1].sum(axis=0)
        feature = int(spec.features(tree, np.array([heap]))[0, j]) if gain[j] > 1e-9 else -1
        numbers = {"tree": tree, "heap": heap, "feature": feature, "bin": int(at[j])}
        numbers |= {"n": int(whole.sum()), "ones": int(whole[1]), "left_n": int(left.sum()), "left_ones": int(left[1])}
        return pa.table({k: pa.array([v], pa.int64()) for k, v in numbers.items()} | {"gain": pa.array([float(gain[j])])})

    schema = "tree long, heap long, feature long, bin long, n long, ones long, left_n long, left_ones long, gain double"
    sums = blocks.mapInArrow(counted, "tree int, heap long, hist binary")
    return [r.asDict() for r in sums.groupBy("tree", "heap").applyInArrow(chosen, schema).collect()]


def _pieces(blocks: DataFrame, units: list[tuple[list[int], int]], tops: dict[int, tuple], spec: Spec) -> DataFrame:
    """The trees below the units' nodes; a unit is a node of some trees, its rows meet in one task."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for i in range(some.num_rows):
                one = some.slice(i, 1)
                ids, y = _unpacked(one, "ids", np.int64), _unpacked(one, "y", np.uint8)
                codes = _unpacked(one, "codes", np.uint8).reshape(len(y), spec.width)
                last, at = None, None
                for unit, (trees, heap) in enumerate(units):
                    if heap > 1 and last != trees:
                        last, at = trees, np.where(spec.weights(ids, trees[0]) > 0, _descended(codes, tops.get(trees[0])), 0)
                    own = slice(None) if heap == 1 else at == heap
                    yield _bytes(["ids", "y", "codes"], [(ids[own], y[own], codes[own])], unit=[unit])

    def finished(some: pa.Table) -> pa.Table:
        trees, heap = units[some["unit"][0].as_py()]
        ids, y = _unpacked(some, "ids", np.int64), _unpacked(some, "y", np.uint8)
        codes = _unpacked(some, "codes", np.uint8).reshape(len(y), spec.width)
        found = [[*grown(codes, y, spec.weights(ids, tree), tree, heap, spec).values()] for tree in trees]
        return pa.Table.from_batches([_bytes([*NODES], found, tree=trees)])

    rows = blocks.mapInArrow(dealt, "unit int, ids binary, y binary, codes binary")
    return rows.repartition(len(units), "unit").groupBy("unit").applyInArrow(finished, PIECE)


def _whole(pieces: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Trees from their pieces, in order of place: feature, bin, child (the left one's number) and value as bytes; gains by feature."""
    width = len(edges)

    def joined(some: pa.Table) -> pa.Table:
        parts = {name: _unpacked(some, name, kind) for name, kind in NODES.items()}
        order = parts["heap"].argsort()
        heap, feature, bin_, n, ones, gain = (v[order] for v in parts.values())
        one, level = 2 * ones > n, np.frexp(heap.astype(np.float64))[1]
        keep = np.ones(len(heap), bool)
        for depth in range(level.max() - 1, 0, -1):  # sibling leaves of one class become their parent
            inner = np.flatnonzero((level == depth) & (feature >= 0))
            left = np.searchsorted(heap, 2 * heap[inner])
            same = (feature[left] < 0) & (feature[left + 1] < 0) & (one[left] == one[left + 1])
            feature[inner[same]] = -1
            keep[left[same]] = keep[left[same] + 1] = False
        heap, feature, bin_, n, ones, gain = (v[keep] for v in (heap, feature, bin_, n, ones, gain))
        child = np.searchsorted(heap, 2 * heap).astype(np.int32)
        inner = feature >= 0
        gains = np.bincount(feature[inner], weights=gain[inner], minlength=width)
        shares = gains / gains.sum() if gains.sum() > 0 else gains
        numbers = _bytes(["feature", "bin", "child", "value"], [(feature, bin_, child, ones / np.maximum(n, 1))], tree=[some["tree"][0].as_py()])
        return pa.Table.from_batches([numbers]).append_column("shares", pa.array([shares.tolist()], pa.list_(pa.float64())))

    return pieces.groupBy("tree").applyInArrow(joined, "tree int, feature binary, bin binary, child binary, value binary, shares array<double>")


@dataclass(frozen=True)
class DeepForest:
    """Trees as rows of bytes in a stored table, and the borders of the bins."""

    trees: DataFrame
    edges: list[np.ndarray]
    count: int

    @property
    def feature_importances(self) -> list[float]:
        """Each tree's gains by feature as shares of its sum, added and made to sum to one."""
        found = self.trees.select(F.posexplode("shares")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
        total = sum(r["s"] for r in found)
        return [r["s"] / total if total else 0.0 for r in found]

    def score(self, df: DataFrame) -> DataFrame:
        """Add `y_proba`, the mean share of ones in the leaves that a row reaches, and `y_pred`."""
        rows = sized(df.withColumn("_rid", F.monotonically_increasing_id()))
        edges, spread = self.edges, max(1, math.ceil(rows.rows / ROWS_A_SCORE))
        blocks = _packed(rows.table.select(F.col("_rid").alias("id"), F.lit(0).alias("y"), "x"), edges, False)
        groups = math.ceil(self.count / TREES_A_SCORE)
        meets = ["_part", "_group"]
        blocks = blocks.select("ids", "codes", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
        trees = self.trees.select(
            "tree", "feature", "bin", "child", "value", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_part"), (F.col("tree") % groups).alias("_group")
        )

        def summed(rows: pa.Table, trees: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.table({"_rid": pa.array([], pa.int64()), "_units": pa.array([], pa.int64())})
            ids = _unpacked(rows, "ids", np.int64)
            codes = _unpacked(rows, "codes", np.uint8).reshape(len(ids), len(edges))
            units = np.zeros(len(ids), np.int64)
            for i in range(trees.num_rows):
                feature, bin_, child, value = (np.frombuffer(trees[c][i].as_py(), k) for c, k in (("feature", np.int16), ("bin", np.uint8), ("child", np.int32), ("value", np.float64)))
                at = np.zeros(len(ids), np.int64)
                moving = np.flatnonzero(feature[at] >= 0)
                while len(moving):
                    node = at[moving]
                    node = child[node] + (codes[moving, feature[node]] > bin_[node])
                    at[moving] = node
                    moving = moving[feature[node] >= 0]
                units += np.round(value * UNITS).astype(np.int64)[at]
            return pa.table({"_rid": ids, "_units": units})

        dealt = spread * groups
        met = blocks.repartition(dealt, *meets).groupBy(*meets).cogroup(trees.repartition(dealt, *meets).groupBy(*meets))
        sums = met.applyInArrow(summed, "_rid long, _units long").groupBy("_rid").agg(F.sum("_units").alias("_units"))
        share = F.col("_units") / (float(UNITS) * self.count)
        return rows.table.join(sums, "_rid").withColumns({"y_proba": share, "y_pred": F.when(share > 0.5, 1).otherwise(0)}).drop("_rid", "_units")


def fit_deep_forest(rows: DataFrame, n: int, width: int, trees: int, depth: int, min_leaf: int, seed: int) -> DeepForest:
    """A forest on `n` rows (label, x) that come in the same order each time."""
    spec = Spec(trees, depth, min_leaf, width, seed)
    edges = [np.array(e) for e in bin_edges(rows, BINS)]
    numbered = rows.select(F.monotonically_increasing_id().alias("id"), F.col("label").alias("y"), "x")
    blocks = sized(_packed(numbered, edges, True)).table
    tops, inner, leaves, below = {}, defaultdict(list), [], []
    most = NODE_CELLS // width
    large = {tree: np.array([1]) for tree in range(trees if n > most else 0)}
    if not large:
        below = [([*range(i, min(trees, i + TREES_A_TASK))], 1) for i in range(0, trees, TREES_A_TASK)]
    while large:
        todo = defaultdict(list)
        for r in _large_splits(blocks, large, tops, spec):
            inner[r["tree"]].append(r)
            sides = ((r["left_n"], r["left_ones"]), (r["n"] - r["left_n"], r["ones"] - r["left_ones"])) if r["feature"] >= 0 else ()
            for side, (size, ones) in enumerate(sides):
                heap = 2 * r["heap"] + side
                if not spec.open(heap, size, ones):
                    leaves.append({"tree": r["tree"], "heap": heap, "feature": -1, "bin": 0, "n": size, "ones": ones, "gain": 0.0})
                elif size > most:
                    todo[r["tree"]].append(heap)
                else:
                    below.append(([r["tree"]], heap))
        large = {tree: np.array(sorted(nodes)) for tree, nodes in todo.items()}
        for tree, nodes in inner.items():
            split = sorted((r["heap"], r["feature"], r["bin"]) for r in nodes if r["feature"] >= 0)
            if split:
                tops[tree] = tuple(np.array(v) for v in zip(*split, strict=True))
    upper = defaultdict(list)
    for r in [*leaves, *(r for nodes in inner.values() for r in nodes)]:
        upper[r["tree"]].append(r)
    pieces = _pieces(blocks, sorted(below), tops, spec) if below else None
    if upper:
        packed = [(tree, *(np.array([r[name] for r in nodes], kind).tobytes() for name, kind in NODES.items())) for tree, nodes in upper.items()]
        known = rows.sparkSession.createDataFrame(packed, PIECE)
        pieces = known if pieces is None else pieces.unionByName(known)
    return DeepForest(sized(_whole(pieces, edges)).table, edges, trees)
