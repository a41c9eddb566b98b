"""Result documents and text logs of earlier runs, and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sourcetrust.operators.joins import lookup_join, sized

# fixed values: metric titles as logs print them, and the columns of a comparison row
LOG_METRICS = {"accuracy": "Accuracy", "f1_score": "F1 Score", "precision": "Precision", "recall": "Recall"}
TABLE_METRICS = {"accuracy": "Accuracy", "f1_score": "F1-Score"}
LOG_APPROACHES = ("centralized", "equal_weight", "trust_weighted")
RESULT_METRICS = ("accuracy", "f1_score", "precision", "recall", "false_positive_rate")

APPROACH_MAP = "map<string, struct<" + ", ".join(f"{m}: double" for m in RESULT_METRICS) + ">>"


def parse_results(documents: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Long rows `keys..., approach, metric, value` from JSON result documents.

    Unreadable documents, and metrics a document does not hold, give no rows.
    """
    parsed = documents.select(*keys, F.from_json(column, APPROACH_MAP).alias("_r"))
    per = parsed.select(*keys, F.explode("_r").alias("approach", "_m"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_m.{m}").alias("value")) for m in RESULT_METRICS])
    return per.select(*keys, "approach", F.inline(pairs)).filter(F.col("value").isNotNull())


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Results of all documents under `paths`, one whole file each, with the file name."""
    text = spark.read.text(paths, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return parse_results(text, "value", ["file"])


def write_results(results: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Long result table (`approach, metric, value`, ...) as JSON lines or Parquet."""
    results.write.mode(mode).format(fmt).save(path)


def write_sources(df: DataFrame, path: str, fmt: str = "parquet", source: str = "client_id", rows_per_file: int = 250_000) -> None:
    """One folder per source. A source is divided by a hash of its rows into files of about `rows_per_file`
    rows, so what a task sorts does not grow with the source; a smaller one is one file."""
    name = F.coalesce(F.col(source).cast("string"), F.lit("\x00"))
    counts = sized(df.groupBy(name.alias("_source")).agg(F.ceil(F.count("*") / rows_per_file).alias("_files")))
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
    dealt = lookup_join(df.withColumn("_source", name), counts, ["_source"]).withColumn("_file", F.pmod(row, F.col("_files")))
    tasks = max(1, counts.table.agg(F.sum("_files")).first()[0] or 0)
    writer = dealt.repartition(tasks, "_source", "_file").select(*df.columns).write.mode("overwrite").partitionBy(source)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def trial_summaries(logs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Long rows `keys..., approach, metric, mean, std` from lines `Metric m±s m±s m±s`.

    The first such line per metric counts.
    """
    # fixed values: the shape of a printed line
    pair, lines = r"([\d.]+)±([\d.]+)", {}
    for metric, title in LOG_METRICS.items():
        line = F.regexp_extract(F.col(text), title + r"\s+" + r"\s+".join([pair] * len(LOG_APPROACHES)), 0)
        lines[metric] = F.transform(F.regexp_extract_all(line, F.lit(pair), F.lit(0)), lambda p: F.split(p, "±"))
    found = logs.select(*keys, *[pairs.alias(f"_{metric}") for metric, pairs in lines.items()])
    entries = [
        F.struct(
            F.lit(approach).alias("approach"), F.lit(metric).alias("metric"),
            F.get(F.get(f"_{metric}", F.lit(i)), F.lit(0)).try_cast("double").alias("mean"),
            F.get(F.get(f"_{metric}", F.lit(i)), F.lit(1)).try_cast("double").alias("std"),
        )
        for metric in LOG_METRICS for i, approach in enumerate(LOG_APPROACHES)
    ]
    return found.select(*keys, F.inline(F.array(*entries))).filter(F.col("mean").isNotNull())


def comparison_rows(logs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Long rows `keys..., approach, metric, value` from the table after RESULTS COMPARISON.

    The last line per metric counts.
    """
    after = F.regexp_extract(F.col(text), r"(?s)RESULTS COMPARISON(.*)", 1)
    entries = []
    for metric, title in TABLE_METRICS.items():
        pattern = r"(?m)^\s*" + title + r"[ \t]+" + r"[ \t]+".join([r"(\d+(?:\.\d+)?)"] * len(LOG_APPROACHES))
        for i, approach in enumerate(LOG_APPROACHES):
            found = F.regexp_extract_all(after, F.lit(pattern), F.lit(i + 1))
            value = F.try_element_at(found, F.lit(-1)).try_cast("double")
            entries.append(F.struct(F.lit(approach).alias("approach"), F.lit(metric).alias("metric"), value.alias("value")))
    return logs.select(*keys, F.inline(F.array(*entries))).filter(F.col("value").isNotNull())


def test_accuracy(text: Column) -> Column:
    """The first `Test Accuracy:` number printed in the section of the trust-weighted approach."""
    return _number(text, r"(?s)(?:Approach 3|Trust-Aware).*?Test Accuracy:\s+(\d+\.\d+)", 1)


# fixed values: what marks a comparison table, how far below it rows count, and the row that counts
TABLE_TITLE, TABLE_HEAD, TABLE_LINES, TRUST_ROW = "RESULTS COMPARISON", ("Metric", "Centralized"), 15, "Trust-Aware"


def trust_row(text: Column) -> Column:
    """The number of the first `Trust-Aware` row of a comparison table: its third, or the only one it has.

    A table begins at its title or its head and its rows lie in the fourteen lines below; rows with
    another count of numbers are passed over.
    """
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(
        i.alias("i"), (line.contains(TABLE_TITLE) | (line.contains(TABLE_HEAD[0]) & line.contains(TABLE_HEAD[1]))).alias("head"),
        line.contains(TRUST_ROW).alias("row"), F.regexp_extract_all(line, F.lit(r"\d+\.\d+"), F.lit(0)).alias("n"),
    ))

    def found(lines: Column) -> Column:
        heads = F.transform(F.filter(lines, lambda e: e["head"]), lambda e: e["i"])
        below = lambda e: F.exists(heads, lambda h: (e["i"] > h) & (e["i"] < h + TABLE_LINES))
        rows = F.filter(lines, lambda e: e["row"] & ((F.size(e["n"]) >= 3) | (F.size(e["n"]) == 1)) & below(e))
        numbers = F.get(rows, F.lit(0))["n"]
        return F.coalesce(F.get(numbers, F.lit(2)), F.get(numbers, F.lit(0))).try_cast("double")

    return F.transform(F.array(lines), found)[0]


def trust_number(text: Column) -> Column:
    """The first number that follows `Trust-Aware` and blanks."""
    return _number(text, r"Trust-Aware\s+(\d+\.\d+)", 1)


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text logs under `paths`, one whole file each: file, log."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("log"))
