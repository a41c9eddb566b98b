"""Mixture-controlled packing of documents into training sequences.

Every source has a queue of its documents' tokens. A window is `window_sequences` sequences long.
In each window every queue gains its share of tokens as credit and is served the whole part of
its credit; what the window still lacks goes round to the queues with the largest deficits, and
the rest of a credit is carried to the next window. What a queue has been served after k windows
is therefore a function of k alone (`Lanes.served`), so a task can start at any window with the
right deficits and no state passes from task to task.

Only the last sequence can be shorter than the others. Inside a window the queues follow each
other, so documents are cut at window shares and sequence ends alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from sourcetrust.llm.encoding import encoded_texts, encoder
from sourcetrust.llm.tables import Workspace

NO_SOURCE = "\x00none"  # queue of rows without a source
REST = "\x00rest"  # queue of the sources too small for one of their own
BROADCAST_ROWS = 200_000  # rows of the shifts table (about 50 bytes each) up to which it is broadcast


class Lanes:
    """How many tokens each queue has been served after any number of windows, at any rates above zero."""

    def __init__(self, tokens: list[int], rates: list[float], window: int):
        self.tokens, self.rates = np.asarray(tokens, np.int64), np.asarray(rates, np.float64)
        self.window, self.total = window, int(self.tokens.sum())
        # every queue runs at its rate until it is empty; between these times the sum is linear in time
        self.times = np.unique(np.concatenate([[0.0], self.tokens / self.rates]))
        self.sums = np.array([self._at(t).sum() for t in self.times])

    def _at(self, time) -> np.ndarray:
        return np.minimum(self.tokens, self.rates * time)

    def ideal(self, position: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first `position` of the stream, as fractions."""
        return self._at(np.interp(position, self.sums, self.times)[:, None])

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Whole tokens of each queue in the first `windows` windows; a row's sum is the stream's length there."""
        position = np.minimum(windows * self.window, self.total)
        exact = self.ideal(position)
        whole = np.floor(exact).astype(np.int64)
        lacking = position - whole.sum(axis=1)
        order = np.argsort(whole - exact, axis=1, kind="stable")  # largest deficit first, then first queue
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        whole += rank < lacking[:, None]
        whole -= rank >= order.shape[1] + np.minimum(lacking, 0)[:, None]  # only where a float was rounded up
        return whole

    def windows_of(self, lane: int, start: int, end: int) -> tuple[int, int]:
        """Windows that may serve tokens start to end of a queue; one too many on either side."""
        rate = self.rates[lane]
        position = np.interp([start / rate, end / rate], self.times, self.sums)
        return max(0, int(position[0] // self.window) - 1), int(position[1] // self.window) + 2


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, `offset` bigint, source string, ids binary"
)


def pack_sequences(
    df: DataFrame, tokenizer: str, end_id: int = 0, id_: str = "doc_id", text: str = "text", source: str = "source",
    kind: str = "whole", sequence: int = 1024, window_sequences: int = 64, targets: dict[str, float] | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    Each document (null text: empty) is its ids and then `end_id`; `ids` are the piece's ids as
    little-endian unsigned 32-bit integers. `targets` weighs sources against each other; a source
    it does not name weighs as much as its share of the tokens, and without targets all do. A
    source that is emptied leaves its share to the others. Sources with a share below two tokens a
    window share one queue, so there are at most window / 2 queues; in it every document stands at its
    virtual time, the tokens before it in its source by the source's rate, so each of these sources
    advances in proportion too and what it is behind is carried along. A null source is a source. Rows that repeat an id are packed each. An empty
    table gives no rows. Without `with_ids` the column `ids` is left out.
    """
    schema = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    space, window = Workspace(df.sparkSession, "packing"), sequence * window_sequences
    rows = df.select(
        F.col(id_).cast("long").alias("_id"),
        F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("_queue"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    stored = space.keep(rows.mapInArrow(_encoded(tokenizer, kind, end_id), ENCODED), "encoded")
    totals = stored.groupBy("queue").agg(F.sum("n").cast("long").alias("n"))
    rates = _rated(totals, targets)
    lanes, lane_of = _lanes(rates, window)
    if lanes is None:
        return df.sparkSession.createDataFrame([], schema)

    # start of every part within its lane: running sums in lane order, over range partitions; a part is
    # what a task has of a queue, or one document of a small source, which go by virtual time
    named = df.sparkSession.createDataFrame([(q, n) for q, n in lane_of.items()], "queue string, lane int")
    rest = lane_of.get(REST, -1)
    laned = stored.join(F.broadcast(named), "queue", "left").withColumns({
        "lane": F.coalesce("lane", F.lit(rest)), "sub": F.when(F.col("lane").isNull(), F.col("at")).otherwise(F.lit(-1)),
    })
    parts = laned.groupBy("lane", "queue", "pid", "sub").agg(F.sum("n").alias("n"))
    parts = _timed(parts, stored, rates, rest) if rest >= 0 else parts.withColumn("time", F.lit(0.0))
    order = [F.col(c) for c in ("lane", "time", "queue", "pid", "sub")]
    ranged = space.keep(parts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parts")
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = ranged.groupBy("_part").agg(F.sum("n").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    begun = ranged.join(F.broadcast(shifts), "_part").withColumn(
        "base", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_shift")
    )
    lane_starts = np.concatenate([[0], np.cumsum(lanes.tokens)])
    begun = space.keep(begun.select("queue", "pid", "sub", "base"), "begun")
    placed = None
    for some in ("sub < 0", "sub >= 0") if rest >= 0 else ("sub < 0",):
        starts = begun.filter(some)
        if starts.count() <= BROADCAST_ROWS:
            starts = F.broadcast(starts)
        inside_part = F.when(F.col("sub") < 0, F.col("at")).otherwise(F.lit(0))
        found = laned.filter(some).join(starts, ["queue", "pid", "sub"]).select(
            "id", "queue", "lane", (F.col("base") + inside_part).alias("at"), "n", "ids"
        )
        placed = found if placed is None else placed.unionByName(found)
    return placed.mapInArrow(_pieces(lanes, lane_starts, sequence, encoder_dtype(tokenizer, kind), with_ids), schema)


ENCODED = "pid int, id bigint, queue string, at bigint, n bigint, ids binary"


def encoder_dtype(tokenizer: str, kind: str) -> str:
    return encoder(tokenizer, kind).dtype.str


def _encoded(tokenizer: str, kind: str, end_id: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, at = encoder(tokenizer, kind), TaskContext.get().partitionId(), {}
        end = np.asarray([end_id], encode.dtype).tobytes()
        for batch in batches:
            queues, starts, sizes, ids = batch.column(1).to_pylist(), [], [], []
            made = encoded_texts(encode, (value.as_py() for value in batch.column(2)))
            for queue, value in zip(queues, made, strict=True):
                ids.append(value + end)
                sizes.append(len(ids[-1]) // encode.dtype.itemsize)
                starts.append(at.get(queue, 0))
                at[queue] = starts[-1] + sizes[-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([pid] * len(ids), pa.int32()), batch.column(0), batch.column(1),
                pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
            ], ["pid", "id", "queue", "at", "n", "ids"])

    return encoded


def _rated(totals: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """queue, n and rate: the target's share, or else the queue's share of the tokens."""
    weights = targets or {}
    scale = sum(weights.values())
    rate = F.col("n").cast("double") / totals.agg(F.sum("n").cast("double")).scalar()
    if weights:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w / scale)])
        rate = F.coalesce(F.try_element_at(given, F.col("queue")), rate)
    return totals.withColumn("rate", rate)


def _lanes(rated: DataFrame, window: int) -> tuple[Lanes | None, dict[str, int]]:
    """Queues with at least two tokens a window (so at most window / 2 of them), the others as one."""
    whole, sum_rate = rated.agg(F.sum("n"), F.sum("rate")).first()
    if not whole:
        return None, {}
    large = rated.filter(F.col("rate") * window >= 2 * sum_rate).orderBy("queue").collect()
    names, tokens, rates = [r["queue"] for r in large], [r["n"] for r in large], [r["rate"] for r in large]
    lane_of, rest = {q: i for i, q in enumerate(names)}, whole - sum(tokens)
    if rest:
        small = rated.filter(F.col("rate") * window < 2 * sum_rate).agg(F.sum("rate")).first()[0]
        lane_of[REST] = len(names)
        tokens.append(rest)
        rates.append(max(small, 1e-12))
    return Lanes(tokens, rates, window), lane_of


def _timed(parts: DataFrame, stored: DataFrame, rates: DataFrame, rest: int) -> DataFrame:
    """Adds `time`: of a small source's documents the tokens before them in the source, by its rate."""
    earlier = W.partitionBy("queue").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    begun = stored.groupBy("queue", "pid").agg(F.sum("n").alias("_n")).select(
        "queue", "pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begun")
    )
    known = parts.join(begun, ["queue", "pid"]).join(rates.select("queue", "rate"), "queue")
    time = F.when(F.col("lane") == rest, (F.col("_begun") + F.col("sub")) / F.col("rate")).otherwise(F.lit(0.0))
    return known.withColumn("time", time).drop("_begun", "rate")


def _pieces(lanes: Lanes, lane_starts: np.ndarray, sequence: int, dtype: str, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.binary()]
    if not with_ids:
        names, kinds = names[:-1], kinds[:-1]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def window_at(k: int):
            if k not in known:
                if len(known) > 64:
                    known.clear()
                after = lanes.served(np.arange(k, k + 2))
                given = after[1] - after[0]
                known[k] = after[0], after[1], np.cumsum(given) - given
            return known[k]

        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, queue, lane, at, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = np.frombuffer(ids, dtype).astype("<u4").tobytes()
                begin = at - int(lane_starts[lane])
                source = None if queue == NO_SOURCE else queue
                for k in range(*lanes.windows_of(lane, begin, begin + n)):
                    low, high, before = window_at(k)
                    u, end = max(begin, int(low[lane])), min(begin + n, int(high[lane]))
                    while u < end:
                        position = k * lanes.window + int(before[lane]) + u - int(low[lane])
                        size = min(end - u, sequence - position % sequence)
                        part = wide[4 * (u - begin):4 * (u - begin + size)]
                        row = (doc, u - begin, size, zlib.crc32(part), n,
                               position // sequence, position % sequence, source, part)
                        for column, value in zip(out, row, strict=with_ids):
                            column.append(value)
                        u += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return pieces
