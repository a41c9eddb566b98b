"""Global running sums and ordinals without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sourcetrust.functions.session import shared_folder
from sourcetrust.operators.joins import lookup_join


def global_prefix_sum(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Running sums (inclusive) of `values` over the whole table in `order`.

    Rows are range-partitioned and the layout is frozen by a checkpoint in the shared
    folder. Each partition is summed locally and shifted by the totals of the partitions
    before it; the table of totals has one row per partition.
    """
    spark = df.sparkSession
    shared_folder(spark)
    names = list(values)
    staged = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    ranged = staged.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("_pid").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in names])
    earlier = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(
        "_pid", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_s_{k}") for k in names]
    )
    local = W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = lookup_join(ranged, shifts, ["_pid"])
    for k in names:
        summed = summed.withColumn(k, F.sum(f"_v_{k}").over(local) + F.col(f"_s_{k}"))
    return summed.drop("_pid", *[f"{p}{k}" for k in names for p in ("_v_", "_s_")])
