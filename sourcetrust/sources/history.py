"""Trust histories on storage: a Parquet table by round, and one JSON document per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sourcetrust.operators.joins import sized
from sourcetrust.operators.models import in_order

METRICS = "validation_accuracy double, consistency_score double, trend string, decay_applied boolean, decay_rate double"
DOCUMENT = (
    "client_id string, trust_scores array<double>, timestamps array<string>, round_numbers array<int>, "
    "performance_metrics array<struct<" + ",".join(p.replace(" ", ":") for p in METRICS.split(", ")) + ">>, "
    "metadata struct<initial_trust:double,last_updated:string,update_count:int,created_at:string>"
)


def with_metrics(history: DataFrame, ts: Column, decay_rate: float = 0.95) -> DataFrame:
    """History rows with a `ts` string and a `metrics` struct (null in round 0)."""
    decayed = F.col("event") == "decay"
    metrics = F.struct(
        F.when(~decayed, F.col("computed")).alias("validation_accuracy"),
        F.when(~decayed, F.col("consistency")).alias("consistency_score"),
        F.when(~decayed, F.col("trend")).alias("trend"),
        F.when(decayed, True).alias("decay_applied"),
        F.when(decayed, F.lit(decay_rate)).alias("decay_rate"),
    )
    return history.select(
        "client_id", "round", "trust", ts.cast("string").alias("ts"), "event",
        F.when(F.col("round") > 0, metrics).alias("metrics"),
    )


def write_history(history: DataFrame, path: str) -> None:
    """Put rounds into the history table, one partition per round.

    A stored row with the source and round of a given one is replaced, all others stay, so writing
    the same rows again changes nothing. Only partitions of the given rounds are rewritten; a write
    that is cut short is mended by repeating it. `history` has one row per source and round.
    """
    spark, rows = history.sparkSession, sized(history).table
    if _exists(spark, path):
        stored = read_history(spark, path)
        touched = stored.join(rows.select("round").distinct(), "round", "left_semi")
        kept = touched.join(rows.select("client_id", "round"), ["client_id", "round"], "left_anti")
        # stored first, as the partitions read are those written
        rows = sized(rows.unionByName(kept, allowMissingColumns=True)).table
    writer = rows.repartition("round").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("round").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    return files.exists(place) and any(f.isDirectory() and "=" in f.getPath().getName() for f in files.listStatus(place))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def resume_point(history: DataFrame) -> DataFrame:
    """The last stored row of each source, from which updates continue."""
    row = F.max_by(F.struct("trust", "ts", "event", "metrics"), "round")
    return history.groupBy("client_id").agg(F.max("round").alias("round"), row.alias("_row")).select(
        "client_id", "round", "_row.*"
    )


def to_documents(history: DataFrame) -> DataFrame:
    """One row per source: `client_id` and `document`, its history as nested JSON.

    The metrics array has no entry for round 0.
    """
    later = F.filter(
        F.array_sort(F.collect_list(F.struct("round", "metrics"))), lambda e: e["round"] > 0
    )
    per = history.groupBy("client_id").agg(
        in_order("round", "trust").alias("trust_scores"),
        in_order("round", "ts").alias("timestamps"),
        F.array_sort(F.collect_list("round")).alias("round_numbers"),
        F.transform(later, lambda e: e["metrics"]).alias("performance_metrics"),
        F.struct(
            F.min_by("trust", "round").alias("initial_trust"),
            F.max_by("ts", "round").alias("last_updated"),
            (F.count("*") - 1).cast("int").alias("update_count"),
            F.min_by("ts", "round").alias("created_at"),
        ).alias("metadata"),
    )
    return per.select("client_id", F.to_json(F.struct(*per.columns)).alias("document"))


def from_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """Long history rows from JSON documents; metrics are matched one place later."""
    parsed = documents.select(F.from_json(column, DOCUMENT).alias("d")).select("d.*")
    entries = F.posexplode(F.arrays_zip("round_numbers", "trust_scores", "timestamps"))
    rows = parsed.select("client_id", "performance_metrics", entries.alias("_i", "_e"))
    return rows.select(
        "client_id",
        F.col("_e.round_numbers").alias("round"),
        F.col("_e.trust_scores").alias("trust"),
        F.col("_e.timestamps").alias("ts"),
        F.when(F.col("_i") > 0, F.get("performance_metrics", F.col("_i") - 1)).alias("metrics"),
    )


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All stored documents under `paths`, one JSON document per line."""
    return from_documents(spark.read.text(paths), "value")


def write_documents(history: DataFrame, path: str) -> None:
    """JSON lines, one document per source, in one folder per source.

    Replaces the documents of the sources in `history` alone; a repeated write changes nothing.
    """
    documents = to_documents(history).select(F.col("client_id").alias("source"), F.col("document").alias("value"))
    writer = documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("source").text(path)
