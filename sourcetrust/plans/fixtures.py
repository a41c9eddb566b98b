"""The driver's tables read as labelled sources.

`flows`  : lineitem rows, twelve sources by supplier, label from the return flag
`tiers`  : quality tier per source
`agreement` : rows with the clean label and the label after tier noise
`weekly` : events, twelve sources by user, weekly rounds, a rule as predictor
`vectors`: embeddings, five sources, seven rounds
`sources`: documents with quality labels, one source per `source` value
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcetrust.operators.perturb import flip_by_tier

FEATURES = ["quantity", "extendedprice", "discount", "tax"]
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    return line.select(
        F.concat(F.lit("client_"), (F.col("l_suppkey") % 12).cast("string")).alias("client_id"),
        F.concat_ws(
            "|", text("l_orderkey"), text("l_partkey"), text("l_suppkey"), text("l_linenumber"),
            F.col("l_shipdate").cast("date").cast("string"),
        ).alias("row_id"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_shipdate").alias("ts"),
        (F.year("l_shipdate") - 1994).alias("round"),
        F.when(F.col("l_returnflag") == "N", "BENIGN")
        .otherwise(F.concat(F.lit("ATTACK_"), F.col("l_returnflag")))
        .alias("label_raw"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("label"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def tier_of(number):
    """Quality tier of source number 0..11."""
    return F.when(number < 3, "high").when(number < 6, "medium").when(number < 9, "low").otherwise("compromised")


def tiers(df: DataFrame) -> DataFrame:
    number = F.regexp_extract("client_id", r"(\d+)$", 1).cast("int")
    return df.select("client_id").distinct().withColumn("quality", tier_of(number))


def named_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with file-like source names of every kind, sixteen by supplier."""
    m = F.col("supplier") % 16
    number = m.cast("string")
    stem = F.concat(F.lit("mixed_s"), number, F.lit(".csv"))
    head = F.concat(F.lit("client_"), (m + 1).cast("string"), F.lit("_"))
    name = (
        F.when(m < 9, F.concat(head, tier_of(m), F.lit("_quality_"), stem))
        .when(m < 12, F.concat(head, F.lit("compromised_"), stem))
        .when(m == 12, stem)
        .when(m == 13, F.concat(F.lit("s"), number, F.lit(".csv")))
        .when(m == 14, F.lit("prepared_test_set.csv"))
        .otherwise(F.concat(F.lit("Benign_s"), number, F.lit(".csv")))
    )
    return flows(spark, sf_dir).withColumn("source_name", name)


def noisy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with `label` after tier noise and the clean label as `label_clean`."""
    df = flows(spark, sf_dir)
    noisy = flip_by_tier(df, tiers(df), FEATURES, SEED)
    return noisy.withColumn("label_clean", F.when(F.col("label_raw") == "BENIGN", 0).otherwise(1))


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: truth and prediction, by source, quality and round."""
    return noisy_labels(spark, sf_dir).select(
        "client_id", "quality", "round", "row_id",
        F.col("label_clean").alias("y_true"), F.col("label").alias("y_pred"),
    )


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "events"))


def predictions(events: DataFrame, source: str = "client") -> DataFrame:
    """Events as predictions: truth is an error event, the rule predicts value > 50.

    A source is one of twelve user groups, or with `source="user"` a single user.
    """
    number = F.col("user_id") % 12 if source == "client" else F.col("user_id")
    return events.select(
        "event_id",
        F.concat(F.lit(f"{source}_"), number.cast("string")).alias("client_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y_true"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("y_pred"),
        F.col("value").alias("score"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("client_"), (v % 5).cast("string")).alias("client_id"),
        (F.floor(v / 5) % 7 + 1).cast("int").alias("round"),
        v.cast("string").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("label") < 5, 0).otherwise(1).alias("label"),
    )


def rated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated documents: truth is the quality label, a length rule predicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rated = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rated.select(
        F.col("source").alias("client_id"), F.col("doc_id").cast("string").alias("row_id"),
        F.col("quality").cast("int").alias("y_true"),
        F.when(F.col("n_chars").between(200, 20_000), 1).otherwise(0).alias("y_pred"),
    )
