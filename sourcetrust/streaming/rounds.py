"""Trust as a stream: round metrics by window, stateful trust, decay timers, drop alerts.

A round is a tumbling window of event time. `round_metrics` and `trust_rounds` accept
streaming and batch frames alike, so the batch result is the twin of the stream over closed
windows; rows later than the watermark are dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sourcetrust.functions.session import new_folder
from sourcetrust.operators.joins import sized
from sourcetrust.operators.metrics import evaluate
from sourcetrust.operators.trust import DIRECT_BELOW, QUICK_BELOW, QUICK_FACTOR, TrustParams
from sourcetrust.sources.history import write_history

WINDOW = "7 days"
DELAY = "1 day"
DAY_MS = 86_400_000
BUCKETS = 1024  # groups of sources that share one state value
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

OUTPUT = (
    "client_id string, window_end timestamp, round int, event string, computed double, "
    "previous double, trust double, magnitude double, alert boolean"
)


def round_metrics(events: DataFrame, window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """Confusion counts and rates per source and tumbling window.

    Events carry `ts` (timestamp), `client_id`, `y_true` and `y_pred`. The window span comes
    first, so that a stream emits each window once, when the watermark passes its end.
    """
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    spanned = timed.withColumn("window", F.window("ts", window))
    table = evaluate(spanned, ["window", "client_id"])
    return table.select("client_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                        *[c for c in table.columns if c not in ("window", "client_id")])


class TrustProcessor(StatefulProcessor):
    """Keeps trust, last window end and round number of the sources of one bucket, in one state value.

    Windows of a micro-batch are sorted before they are folded in. A window without events
    decays trust: gaps when the next window arrives, trailing ones by an event-time timer of the bucket,
    set for the source that is first to miss a window. After `idle_windows` windows in a row without
    events (None: never) a source is retired: its state goes, no more decay rows are made, and a later
    window starts it anew.
    """

    def __init__(self, params: TrustParams, window_ms: int, idle_windows: int | None = None) -> None:
        self.params = params
        self.window_ms = window_ms
        self.idle_windows = idle_windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trust", (
            "client_id array<string>, trust array<double>, last_end array<bigint>, round array<int>, idle array<int>, timer bigint"
        ))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Go on from the last stored round of each source; windows up to it are not applied again."""
        known, timer = self._read()
        rows = initialState.sort_values("round")
        for client, end, trust, number, idle in zip(rows["client_id"], _millis(rows["window_end"]), rows["trust"], rows["round"], rows["idle"]):
            known[client] = float(trust), end, int(number), int(idle)
        self._write(known, timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["client_id", "window_end"])
        known, timer = self._read()
        out = []
        for client, end_ms, computed in zip(table["client_id"], _millis(table["window_end"]), table["computed"]):
            trust, last, number, idle = known.get(client) or self._unknown()
            if last is not None and end_ms <= last:
                continue
            if last is not None:
                trust, last, number, idle = self._idle(client, trust, last, number, idle, end_ms - self.window_ms, out)
            number += 1
            trust = self._record(client, end_ms, number, "update", computed, trust, self._next(trust, computed, number), out)
            known[client] = trust, end_ms, number, 0
        self._write(known, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, _ = self._read()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for client, state in known.items():
            known[client] = self._idle(client, *state, now, out)
        self._write(known, None)  # the timer that has fired goes by itself
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[dict[str, tuple], int | None]:
        """Trust, last end, round and idle windows by source, and the time the timer is set for."""
        stored = self.state.get()
        if stored is None:
            return {}, None
        *columns, timer = stored
        return {client: tuple(state) for client, *state in zip(*columns)}, timer

    def _unknown(self):
        return self.params.initial, None, 0, 0

    def _write(self, known: dict[str, tuple], timer: int | None) -> None:
        known = {client: state for client, state in known.items() if state[1] is not None}
        due = min(state[1] for state in known.values()) + self.window_ms if known else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.state.clear()
            return
        self.state.update((list(known), *(list(column) for column in zip(*known.values())), due))
        if timer != due:
            self.handle.registerTimer(due)

    def _idle(self, client, trust, last, number, idle, until_ms, out):
        """Decay once for every window that ended by `until_ms` without events, up to retirement."""
        while last + self.window_ms <= until_ms:
            if self.idle_windows is not None and idle >= self.idle_windows:
                return self._unknown()
            last, number, idle = last + self.window_ms, number + 1, idle + 1
            trust = self._record(client, last, number, "decay", None, trust, trust * self.params.decay, out)
        return trust, last, number, idle

    def _next(self, old, computed, number) -> float:
        if computed is None or computed != computed or abs(computed) == float("inf"):
            return self.params.initial
        if computed < DIRECT_BELOW or (number == 1 and self.params.first_update == "direct"):
            return computed
        alpha = self.params.alpha * (QUICK_FACTOR if computed < QUICK_BELOW else 1.0)
        return alpha * old + (1 - alpha) * computed

    def _record(self, client, end_ms, number, event, computed, old, new, out) -> float:
        new = min(1.0, max(0.0, new))
        drop = old - new
        out.append((client, end_ms, number, event, computed, old, new, drop, drop > self.params.anomaly))
        return new

    def _frame(self, out) -> pd.DataFrame:
        names = [field.split()[0] for field in OUTPUT.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        frame["window_end"] = frame["window_end"].astype("int64").astype("datetime64[ms]")
        return frame.astype({"window_end": "datetime64[us]", "computed": "float64", "alert": "bool", "round": "int32"})


def _millis(times: pd.Series) -> list[int]:
    return times.astype("datetime64[ms]").astype("int64").tolist()


def trust_stream(
    events: DataFrame, params: TrustParams = TrustParams(), window: str = WINDOW, window_ms: int = 7 * DAY_MS, delay: str = DELAY,
    idle_windows: int | None = None, stored: DataFrame | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Trust per source and window with decay and alerts, from a stream of predictions.

    With `idle_windows`, a source without events for that many windows is forgotten. With `stored`, rows
    of an earlier run (as this stream makes them), each source goes on from its last stored round,
    and windows that are stored already make no rows; so a stream without its checkpoint can be run
    again over all events.

    Sources are kept by bucket of a hash, so a micro-batch calls Python once a bucket and not once a source. A
    checkpoint holds its number of `buckets`; give more where a bucket would have very many sources.

    Needs the RocksDB state store (`run_stream` and `run_history` set it).
    """
    measured = round_metrics(events, window, delay).select("client_id", "window_end", F.col("accuracy").alias("computed"))
    bucket = F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int").alias("bucket")
    return measured.select("*", bucket).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TrustProcessor(params, window_ms, idle_windows),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="EventTime",
        initialState=None if stored is None else sized(last_states(stored).select("*", bucket)).table.groupBy("bucket"),
    )


def last_states(stored: DataFrame) -> DataFrame:
    """client_id, window_end, round, trust of each source's last stored round, and for how many rounds it was idle."""
    last = F.max_by(F.struct("window_end", "trust"), "round").alias("l")
    busy = F.coalesce(F.max(F.when(F.col("event") == "update", F.col("round"))), F.lit(0))
    found = stored.groupBy("client_id").agg(F.max("round").cast("int").alias("round"), last, busy.alias("busy"))
    return found.select("client_id", "l.window_end", "round", "l.trust", (F.col("round") - F.col("busy")).cast("int").alias("idle"))


def drop_alerts(trust: DataFrame) -> DataFrame:
    return trust.filter("alert").select("client_id", "window_end", "round", "previous", "trust", "magnitude")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_stream(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into a Parquet table in the shared folder and read it."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    with rocksdb(spark):
        run = (
            stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/state").start(f"{folder}/rows")
        )
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_history(stream: DataFrame, path: str, state: str | None = None) -> DataFrame:
    """Process all available input into the history table at `path` and read it.

    Every micro-batch replaces its rows by source and round, so a batch that is repeated after a
    failure changes nothing. `state` is the stream's checkpoint; without one a new stream begins,
    which goes on from the history if it was given to `trust_stream`.
    """
    spark = stream.sparkSession
    with rocksdb(spark):
        run = (
            stream.writeStream.foreachBatch(lambda rows, _: write_history(rows, path)).outputMode("append")
            .trigger(availableNow=True).option("checkpointLocation", state or new_folder(spark, "history-state")).start()
        )
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_late(events: DataFrame, name: str, window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """Process all available events and read those that came too late: their window had been closed before.

    What has been closed follows from the latest event time of the micro-batches before. Marks and
    late rows are stored by batch, and a repeated batch replaces its own.
    """
    spark = events.sparkSession
    folder = new_folder(spark, name)
    spark.createDataFrame([], "mark timestamp").withColumn("batch", F.lit(-1)).write.parquet(f"{folder}/marks")
    events.sparkSession.createDataFrame([], events.schema).write.parquet(f"{folder}/late/batch=-1")

    def sorted_out(rows: DataFrame, batch: int) -> None:
        before = spark.read.parquet(f"{folder}/marks").filter(F.col("batch") < batch)
        closed = before.select(F.max("mark") - F.expr(f"interval {delay}")).scalar()
        spanned = rows.withColumn("_w", F.window("ts", window))
        late = spanned.filter(F.col("_w.end") <= closed).drop("_w")
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={batch}")
        mark = rows.agg(F.max("ts").alias("mark")).withColumn("batch", F.lit(batch))
        old = sized(before.unionByName(mark)).table
        old.write.mode("overwrite").parquet(f"{folder}/marks")

    run = (
        events.writeStream.foreachBatch(sorted_out).trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start()
    )
    run.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/late/*")


def read_events(spark: SparkSession, folder: str, names: str = "*.parquet") -> DataFrame:
    """Stream the Parquet files of a folder whose names match the glob `names`."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)


def closed_windows(table: DataFrame, events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Batch windows that a stream over the same events would have closed by now."""
    mark = events.select(F.max("ts") - F.expr(f"interval {delay}")).scalar()
    return table.filter(F.col("window_end") <= mark)
