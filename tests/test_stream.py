"""Streams against their batch twins."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scales import SMALL
from sourcetrust.operators.trust import adaptive_trust, round_spine
from sourcetrust.plans import fixtures as fx
from sourcetrust.streaming import rounds

SCHEMA = "ts timestamp, client_id string, y_true int, y_pred int"


def write(spark, folder, name, rows):
    frame = pd.DataFrame([(pd.Timestamp(t), c, y, p) for t, c, y, p in rows], columns=["ts", "client_id", "y_true", "y_pred"])
    spark.createDataFrame(frame, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_weekly_metrics_equal_batch(spark):
    events = fx.weekly(spark, SMALL)
    batch = rounds.closed_windows(rounds.round_metrics(events), events)
    stream = rounds.run_stream(rounds.round_metrics(fx.predictions(rounds.read_events(spark, SMALL, "events.parquet"))), "t")
    assert batch.count() > 0
    assert batch.exceptAll(stream).isEmpty() and stream.exceptAll(batch).isEmpty()


@pytest.fixture
def batches(spark, tmp_path):
    """The last file holds a row for a window that is closed by then."""
    day = lambda d, h=12: f"2024-01-{d:02d} {h:02d}:00:00"
    write(spark, tmp_path, "a", [(day(1), "x", 1, 1), (day(1), "y", 1, 1), (day(2), "x", 1, 1), (day(5), "x", 1, 0)])
    write(spark, tmp_path, "b", [(day(6), "x", 1, 1)])
    write(spark, tmp_path, "c", [(day(1, 13), "x", 1, 0), (day(9), "x", 1, 1)])
    return str(tmp_path)


def read(spark, folder):
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .option("latestFirst", False).parquet(folder)
    )


def test_late_rows_are_dropped(spark, batches):
    table = rounds.run_stream(rounds.round_metrics(read(spark, batches), "1 day", "1 day"), "late")
    first = table.filter("client_id = 'x' and window_end = timestamp'2024-01-02'").first()
    assert (first["tp"], first["fn"]) == (1, 0)


def test_stateful_trust_equals_the_batch_fold(spark, batches):
    table = rounds.run_stream(rounds.trust_stream(read(spark, batches), window="1 day", window_ms=rounds.DAY_MS), "state")
    got = [(r["round"], r["event"], round(r["trust"], 9)) for r in table.filter("client_id = 'x'").orderBy("round").collect()]
    days = [(1, 1.0), (2, 1.0), (5, 0.0), (6, 1.0)]
    observed = spark.createDataFrame([("x", d, v) for d, v in days], "client_id string, round int, computed double")
    batch = adaptive_trust(round_spine(observed, 1, 7), decay=True).filter("round > 0").orderBy("round").collect()
    assert got == [(r["round"], r["event"], round(r["trust"], 9)) for r in batch]
    alerts = rounds.drop_alerts(table).collect()
    assert [(r["client_id"], r["round"]) for r in alerts] == [("x", 5)]
    idle = [r["event"] for r in table.filter("client_id = 'y'").orderBy("round").collect()]
    assert idle == ["update"] + ["decay"] * 6


def test_idle_source_is_retired(spark, batches):
    stream = rounds.trust_stream(read(spark, batches), window="1 day", window_ms=rounds.DAY_MS, idle_windows=2)
    rows = rounds.run_stream(stream, "retired").orderBy("window_end").collect()
    assert [r["event"] for r in rows if r["client_id"] == "y"] == ["update", "decay", "decay"]
    assert [(r["round"], r["event"]) for r in rows if r["client_id"] == "x"][:5] == [
        (1, "update"), (2, "update"), (3, "decay"), (4, "decay"), (5, "update")]


def test_late_rows_are_kept_aside(spark, batches):
    late = rounds.run_late(read(spark, batches), "late", "1 day", "1 day").collect()
    assert [(str(r.ts), r.client_id, r.y_pred) for r in late] == [("2024-01-01 13:00:00", "x", 0)]


def test_stream_goes_on_from_its_history(spark, batches, tmp_path_factory):
    """Given up after two days, run again twice over all events: the table is that of one run."""
    settings = {"window": "1 day", "window_ms": rounds.DAY_MS}
    whole = rounds.run_stream(rounds.trust_stream(read(spark, batches), **settings), "whole")
    path = str(tmp_path_factory.mktemp("history") / "rounds")
    early = read(spark, batches).filter("ts < timestamp'2024-01-05 12:30:00'")
    first = rounds.run_history(rounds.trust_stream(early, **settings), path)
    before = first.count()
    for _ in range(2):
        again = rounds.run_history(rounds.trust_stream(read(spark, batches), stored=spark.read.parquet(path), **settings), path)
    keys = ["client_id", "window_end", "round", "event", F.round("trust", 9).alias("trust"), "alert"]
    assert 0 < before < whole.count()
    assert sorted(map(tuple, again.select(*keys).collect())) == sorted(map(tuple, whole.select(*keys).collect()))


@pytest.mark.parametrize("idle_windows", [None, 2])
def test_sources_of_one_bucket_do_not_touch_each_other(spark, batches, idle_windows):
    """Sources that share a state value and a timer have the rows they have apart."""
    def rows(buckets):
        stream = rounds.trust_stream(read(spark, batches), window="1 day", window_ms=rounds.DAY_MS, idle_windows=idle_windows, buckets=buckets)
        return sorted(rounds.run_stream(stream, f"buckets-{buckets}").select("client_id", "round", "event", "trust", "alert").collect())

    apart = rows(997)
    assert {r["client_id"] for r in apart} == {"x", "y"}
    assert rows(1) == apart
