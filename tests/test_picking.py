"""Exact picks in large groups against a sort of the whole group."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sourcetrust.functions.keys import hash_hex
from sourcetrust.operators.joins import lookup_join, sized
from sourcetrust.operators.picking import (
    group_sizes, mark_first, number_line, picked_by_score, prefix_length, score_cuts, take_slots,
)

ROWS = 6_000


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds two thirds of the rows; a third of all rows share one score."""
    df = spark.range(ROWS).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.col("id").cast("string").alias("row_id"),
        F.when(F.col("id") % 3 == 0, 777_777).otherwise((F.col("id") * 7919) % 100_003).cast("bigint").alias("s"),
    )
    return df.withColumn("key", hash_hex(42, F.col("row_id")))


def ranked(pdf, order, ascending):
    pdf = pdf.sort_values(order, ascending=ascending)
    return pdf.groupby("g").cumcount() + 1


def test_prefix_length_grows_with_the_group():
    assert prefix_length(100, 100) == 0
    assert prefix_length(101, 100) == 1
    assert prefix_length(10**12, 10**5) == 6


def test_hash_matches_hashlib(skewed):
    row = skewed.filter("row_id = '5'").first()
    assert row["key"] == hashlib.md5(b"42|5").hexdigest()


@pytest.mark.parametrize("bucket_rows", [10, 300, 100_000])
def test_mark_first(skewed, bucket_rows):
    quotas = group_sizes(skewed, ["g"]).withColumn("quota", F.floor(F.col("n") * 0.37).cast("bigint"))
    got = mark_first(skewed, ["g"], "key", quotas, "in", bucket_rows).toPandas()
    rank = ranked(got, ["key"], True)
    n = got.groupby("g")["g"].transform("size")
    assert (got["in"] == (rank.reindex(got.index) <= (n * 0.37).astype(int))).all()


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
@pytest.mark.parametrize("bucket_rows", [10, 100_000])
def test_score_cuts_with_ties(skewed, share, bucket_rows):
    quotas = group_sizes(skewed, ["g"]).withColumn("quota", F.floor(F.col("n") * share).cast("bigint"))
    cuts = score_cuts(skewed, ["g"], "s", "key", quotas, bucket_rows)
    got = lookup_join(skewed, cuts, ["g"]).withColumn("in", picked_by_score("s", "key")).toPandas()
    rank = ranked(got, ["s", "key"], [False, True])
    n = got.groupby("g")["g"].transform("size")
    assert (got["in"] == (rank.reindex(got.index) <= (n * share).astype(int))).all()


@pytest.mark.parametrize("bucket_rows", [10, 300, 100_000])
def test_take_slots(spark, skewed, bucket_rows):
    sizes = group_sizes(skewed, ["g"])
    slots = number_line(sizes, F.lit(40), "draw").withColumn("slot", (F.col("draw") * 13) % F.least(F.col("n"), F.lit(90)) + 1)
    slots = slots.select("g", "draw", "slot").persist()
    got = take_slots(skewed, ["g"], "key", sizes, slots, bucket_rows).select("g", "draw", "row_id").toPandas()
    pdf = skewed.toPandas()
    pdf["slot"] = ranked(pdf, ["key"], True)
    want = slots.toPandas().merge(pdf, on=["g", "slot"])[["g", "draw", "row_id"]]
    order = ["g", "draw", "row_id"]
    pd.testing.assert_frame_equal(
        got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), check_dtype=False
    )


def test_number_line_crosses_blocks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 10)], "k string, n bigint")
    got = number_line(df, F.col("n"), "i", block=10).groupBy("k").agg(F.count("*"), F.min("i"), F.max("i")).collect()
    assert sorted(map(tuple, got)) == [("a", 25, 1, 25), ("c", 10, 1, 10)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_without_broadcast(skewed, how):
    table = skewed.groupBy("g").agg(F.max("s").alias("top")).filter("g <> 'g3'")
    small = lookup_join(skewed, table, ["g"], how)
    big = lookup_join(skewed, table, ["g"], how, max_cells=0)
    assert small.columns == big.columns
    assert small.count() == big.count()
    assert small.exceptAll(big).isEmpty() and big.exceptAll(small).isEmpty()


def test_sized_counts_and_measures(skewed):
    known = sized(group_sizes(skewed, ["g"]), F.col("n"))
    assert known.rows == 8 and known.largest == ROWS * 2 // 3


@pytest.mark.parametrize("bucket_rows", [500, 100_000])
def test_slots_are_never_broadcast(skewed, bucket_rows):
    """A few rows that give many slots look small to the optimiser; slots must be joined by a shuffle."""
    sizes = group_sizes(skewed, ["g"])
    slots = number_line(sizes, F.col("n") * 3, "draw").select("g", (F.col("draw") % F.col("n") + 1).alias("slot"))
    taken = take_slots(skewed, ["g"], "key", sizes, slots, bucket_rows)
    plan = taken._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert not [line for line in plan if "BroadcastHashJoin" in line and "_at#" in line]
    assert [line for line in plan if "SortMergeJoin" in line and "_at#" in line]
    assert taken.count() == 3 * ROWS


def test_numbers_are_dealt_over_tasks(spark):
    numbers = number_line(spark.createDataFrame([(45_000,)], "n int"), F.col("n"), "i", block=100)
    used = numbers.groupBy(F.spark_partition_id()).count().count()
    assert numbers.agg(F.count_distinct("i")).first()[0] == 45_000 and used > 1


def test_digits_are_counted_by_hash_aggregation(skewed):
    """Ends of text in the same aggregate would sort all rows; they are looked for in stuck buckets only."""
    from sourcetrust.operators.picking import _narrowed

    wide = sized(group_sizes(skewed, ["g"]).select("g", F.lit("").alias("_p"), F.lit(5).alias("_left")))
    plan = _narrowed(skewed.select("g", "key"), ["g"], "key", wide, 3)._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
