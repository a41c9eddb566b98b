"""Stored steps in the shared folder, and global positions without a single-task window."""

from __future__ import annotations

import atexit
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sourcetrust.functions.session import new_folder

LONGEST_KEY = 64  # longer keys are worked out each time


class Workspace:
    """Parquet tables of one operator call, in the folder `spark.checkpoint.dir` names.

    A stored table cuts the lineage and outlives lost executors. `drop` removes one that no
    later step reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_folder(spark, name)
        atexit.register(self.remove)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.folder}/{name}")

    def remove(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], space: Workspace, name: str) -> DataFrame:
    """Rows with `_pos`, their 0-based position in `order` over the whole table.

    Rows are range-partitioned, sorted and stored with their index in the partition; the
    table of shifts has one row per partition, so broadcasting it is bounded by the number
    of shuffle partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = space.keep(ranged.withColumns({"_pid": F.spark_partition_id(), "_idx": index}), name)
    shifts = running(stored.groupBy("_pid").agg(F.count("*").alias("_n")), "_pid", "_n", "_shift")
    placed = stored.join(F.broadcast(shifts.select("_pid", "_shift")), "_pid")
    return placed.withColumn("_pos", F.col("_idx") + F.col("_shift")).drop("_pid", "_idx", "_shift")


def running(parts: DataFrame, order: str, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of `value` over the earlier rows of a table with one row per stored partition (and key)."""
    earlier = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def worker_value(name: str, make: Callable):
    """A value built once per Python worker process and kept between its tasks.

    A worker keeps one value: another name drops it, so what an operator remembers does not lie
    beside what the next one does.
    """
    home = sys.modules.setdefault("_sourcetrust_worker", types.ModuleType("_sourcetrust_worker"))
    if getattr(home, "name", None) != name:
        home.name, home.value = None, None
        home.value = make()
        home.name = name
    return home.value


def fresh_worker() -> None:
    """What another operator remembered in this Python worker goes, before one that remembers nothing."""
    worker_value("", lambda: pa.default_memory_pool().release_unused())


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int, weigh: str | None = None) -> Iterator[pa.Table]:
    """Batches sorted by an integer column, joined to tables that divide no group.

    A table has about `least` rows, or bytes of the column `weigh`, and is larger only where a
    single group is. Long batches are taken in parts.
    """
    held, size, goal = [], 0, least
    for whole in batches:
        for batch in _parts(whole, least, weigh):
            held.append(batch)
            size += _weight(batch, weigh)
            if size < goal:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size = sum(_weight(b, weigh) for b in held)
            goal = max(least, 2 * size)  # a group longer than `least` is searched seldom
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _weight(batch: pa.RecordBatch, weigh: str | None) -> int:
    return batch.num_rows if weigh is None else pc.sum(pc.binary_length(batch.column(weigh))).as_py() or 0


def _parts(batch: pa.RecordBatch, least: int, weigh: str | None) -> Iterator[pa.RecordBatch]:
    if weigh is None:
        for at in range(0, batch.num_rows, least):
            yield batch.slice(at, least)
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(weigh)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + least, "right")))
        yield batch.slice(at, end - at)
        at = end


def linked(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node reachable by the given links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


class Memory(dict):
    """Results a Python worker remembers: the latest `limit / 2` keys and as many before them.

    Keys asked for again move to the latest, so frequent ones stay while rare ones go.
    """

    def __init__(self, limit: int, make: Callable | None = None):
        super().__init__()
        self.half, self.make, self.old = limit // 2, make, {}

    def __missing__(self, key):
        if key in self.old:
            value = self[key] = self.old[key]  # at most `limit / 2` keys can move
            return value
        if self.make is None:
            raise KeyError(key)
        value = self.make(key)
        if len(key) <= LONGEST_KEY:
            self._store({key: value})
        return value

    def learn(self, keys: set, make: Callable[[list], list]) -> list:
        """Have all `keys` at hand until the next call; gives those that had to be made."""
        absent = keys.difference(self)
        moved = {key: self.old[key] for key in absent if key in self.old}
        new = [key for key in absent if key not in moved]
        self._store(moved | dict(zip(new, make(new), strict=True)))
        return new

    def has(self, key) -> bool:
        return key in self or key in self.old

    def add(self, items: dict) -> None:
        """Remember `items`, none of them long, which stay at hand until as many more have come."""
        if items:
            self._store(items)

    def forget_long(self, keys: list) -> None:
        for key in keys:
            if len(key) > LONGEST_KEY:
                self.pop(key, None)

    def _store(self, items: dict) -> None:
        if len(self) + len(items) > self.half:
            self.old = dict(self)
            self.clear()
        self.update(items)
