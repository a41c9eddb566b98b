"""Histories folded in blocks against a plain loop, and the order statistics of large groups."""

import math
import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sourcetrust.operators import histories, picking, trust
from sourcetrust.operators.picking import double_key, key_cuts, medians
from sourcetrust.sources import history as stored_history


def plain_trust(rows, params=trust.TrustParams(), decay=False, last=None):
    """(round, trust, event) of one source's sorted (round, computed) rows; `last` is a stored (round, trust)."""
    old, out = (last[1] if last else params.initial), []
    for i, (r, c) in enumerate((r, c) for r, c in rows if last is None or r > last[0]):
        if c is None and decay:
            new, event = old * params.decay, "decay"
        else:
            event = "update"
            if c is None or math.isnan(c) or math.isinf(c):
                new = params.initial
            elif c < 0.1 or (params.first_update == "direct" and ((last is None and i == 0) or r == 1)):
                new = c
            else:
                alpha = params.alpha * (0.3 if c < 0.2 else 1.0)
                new = alpha * old + (1 - alpha) * c
        old = min(1.0, max(0.0, new))
        out.append((r, old, event))
    return out


def observed(seed, sources=4, rounds=700):
    rnd = random.Random(seed)
    odd = [None, float("nan"), float("inf"), 1.4, -0.2, 0.05, 0.15]
    value = lambda: rnd.choice(odd) if rnd.random() < 0.1 else rnd.random()
    return {f"s{k}": [(r, value()) for r in range(1, rounds) if rnd.random() < 0.8 or k == 0] for k in range(sources)}


@pytest.mark.parametrize("decay,first", [(False, "direct"), (True, "direct"), (True, "smoothed")])
def test_adaptive_trust_against_a_loop(spark, decay, first):
    rows, params = observed(3), trust.TrustParams(first_update=first)
    table = spark.createDataFrame([(s, r, c) for s, rs in rows.items() for r, c in rs], "client_id string, round int, computed double").repartition(5)
    got = trust.adaptive_trust(table, params, decay).filter("round > 0").toPandas().sort_values("round")
    for s, rs in rows.items():
        own, expected = got[got.client_id == s], plain_trust(rs, params, decay)
        assert own["round"].tolist() == [e[0] for e in expected] and own["event"].tolist() == [e[2] for e in expected]
        assert max(abs(own["trust"] - [e[1] for e in expected])) < 1e-12
    # resumed half-way, with the stored rounds given again
    half = trust.adaptive_trust(table.filter("round <= 300"), params, decay)
    again = trust.adaptive_trust(table, params, decay, stored=half).filter("round > 0").toPandas().sort_values(["client_id", "round"])
    whole = got.sort_values(["client_id", "round"])
    assert again["round"].tolist() == whole["round"].tolist()
    assert max(abs(again["trust"].to_numpy() - whole["trust"].to_numpy())) < 1e-12


@pytest.mark.parametrize("block", [3, 16, 5000])
def test_blocks_of_blocks(spark, block):
    rnd = random.Random(block)
    steps = [(s, i, rnd.choice([0.0, 0.5, 0.95, 1.0]), rnd.uniform(-0.4, 0.6)) for s, n in (("a", 400), ("b", 1), ("c", 57)) for i in range(n)]
    table = spark.createDataFrame(steps, "client_id string, _i long, a double, b double").withColumn("_f", histories.affine(F.col("a"), F.col("b")))
    starts = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 0.0)], "client_id string, _x double")
    got = {(r.client_id, r._i): r for r in histories.folded(table, starts, ["a"], block=block).collect()}
    value = {"a": 0.5, "b": 1.0, "c": 0.0}
    assert len(got) == len(steps)
    for s, i, a, b in steps:
        assert abs(got[s, i]._x - value[s]) < 1e-12 and got[s, i].a == a
        value[s] = min(1.0, max(0.0, a * value[s] + b))
        assert abs(got[s, i]._y - value[s]) < 1e-12


def test_long_history_of_one_source(spark):
    """A hundred thousand rounds: no array or task holds them all."""
    rounds = 100_000
    table = spark.range(1, rounds + 1).select(
        F.lit("s").alias("client_id"), F.col("id").cast("int").alias("round"), ((F.col("id") * 7919) % 1000 / 1000.0).alias("computed"))
    got = trust.adaptive_trust(table).agg(F.max_by("trust", "round"), F.count("*"), F.sum("trust")).first()
    expected = plain_trust([(r, r * 7919 % 1000 / 1000.0) for r in range(1, rounds + 1)])
    assert got[1] == rounds + 1 and abs(got[0] - expected[-1][1]) < 1e-9
    assert abs(got[2] - 0.5 - sum(e[1] for e in expected)) < 1e-5


def test_windows_look_back_across_blocks(spark):
    rows = spark.range(100).select(F.lit("s").alias("client_id"), (F.col("id") * 3).alias("round"), F.col("id").alias("v"))
    numbered = histories.numbered_rounds(rows, block=16)
    assert sorted((r.round, r._i) for r in numbered.collect()) == [(3 * i, i) for i in range(100)]
    add = lambda order: {"sum": F.sum("v").over(order.rowsBetween(-5, -1))}
    got = histories.recent_frames(numbered, 5, add, block=8).collect()
    assert {r._i: r["sum"] or 0 for r in got} == {i: sum(range(max(0, i - 5), i)) for i in range(100)}


def test_history_writes_repeat_without_effect(spark, tmp_path):
    path = str(tmp_path / "history")
    kind = "client_id string, round int, trust double"
    stored_history.write_history(spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.6), ("b", 1, 0.7)], kind), path)
    for _ in range(2):
        stored_history.write_history(spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8)], kind), path)
    stored_history.write_history(spark.createDataFrame([], kind), path)
    got = stored_history.read_history(spark, path).select("client_id", "round", "trust").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0.5), ("a", 1, 0.9), ("a", 2, 0.8), ("b", 1, 0.7)]


# order statistics


NUMBERS = [0.0, -0.0, 1.0, -1.0, 1.5, 1e-310, -1e-310, 5e-324, 1e308, -1e308, float("inf"), float("-inf"), 2.0 ** -1022, 0.1, 0.3, 1e17, 3.0]


def test_double_keys_are_in_order(spark):
    rnd = random.Random(1)
    values = NUMBERS + [struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(500)] + [rnd.gauss(0, 1) for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", double_key(F.col("v")).alias("k")).collect()
    keyed = sorted((r.k, r.v) for r in got if r.v == r.v)
    assert [v for _, v in keyed] == sorted(v for _, v in keyed) and {len(r.k) for r in got} == {19}
    assert len({k for k, _ in keyed}) == len({v for _, v in keyed})
    assert all(r.k > keyed[-1][0] for r in got if r.v != r.v)


@pytest.mark.parametrize("bucket_rows", [4, 100])
def test_medians_by_descent(spark, bucket_rows):
    rnd = random.Random(bucket_rows)
    rows = [(g, rnd.choice(NUMBERS[:15]) if g == "odd" else rnd.gauss(0, 3)) for g, n in (("a", 900), ("odd", 301), ("b", 3), ("c", 1)) for _ in range(n)]
    rows += [("same", 2.5)] * 200 + [("two", 1.0)] * 100 + [("two", 4.0)] * 100 + [("none", None)] * 5
    table = spark.createDataFrame(rows, "g string, v double").repartition(4)
    expected = {r.g: r.m for r in table.groupBy("g").agg(F.median("v").alias("m")).collect() if r.m is not None}
    assert {r.g: r.m for r in medians(table, ["g"], "v", "m", bucket_rows).collect()} == expected
    whole = table.filter("g in ('a', 'two')")
    assert medians(whole, [], "v", "m", bucket_rows).first()[0] == whole.agg(F.median("v")).first()[0]


def test_descent_counts_large_groups_alone(spark, monkeypatch):
    """One hot and many small sources: only the hot one's rows are counted, by few digits at a time."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 300).cast("string"))).alias("g"),
        F.md5(F.col("id").cast("string")).alias("key"))
    quotas = picking.group_sizes(df, ["g"]).withColumn("quota", F.floor(F.col("n") * 0.4).cast("bigint"))
    seen, narrowed = [], picking._narrowed

    def spied(keys, groups, key, wide, digits):
        seen.append((sorted(r.g for r in wide.table.collect()), digits))
        return narrowed(keys, groups, key, wide, digits)

    monkeypatch.setattr(picking, "_narrowed", spied)
    cuts = {r.g: r.cut for r in key_cuts(df, ["g"], "key", quotas, bucket_rows=120, digits=2).table.collect()}
    assert seen and all(groups == ["hot"] for groups, _ in seen)
    pdf = df.toPandas().sort_values("key")
    for g, own in pdf.groupby("g"):
        assert cuts[g] == own["key"].iloc[int(len(own) * 0.4) - 1]
    assert isinstance(pdf, pd.DataFrame)


def test_tables_of_sources_do_not_go_through_the_driver(spark):
    """A row per source, or per block of rounds, grows with the sources: such joins are shuffles."""
    rows = spark.range(400).select((F.col("id") % 40).cast("string").alias("client_id"), F.floor(F.col("id") / 40).cast("int").alias("round"), F.lit(0.7).alias("computed"))
    for history in (trust.adaptive_trust(rows), trust.adaptive_trust(rows, stored=trust.adaptive_trust(rows.filter("round < 5")))):
        assert "BroadcastHashJoin" not in history._jdf.queryExecution().sparkPlan().toString()
        assert history.count() == 440
