"""Scans of per-source tables: one DataFrame for all sources, identified by a column."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sourcetrust.operators.clean import union_sources
from sourcetrust.operators.joins import Sized, lookup_join, sized
from sourcetrust.operators.ordering import global_prefix_sum

# fixed values: words in source names and the tiers they stand for
TIERS = ("high", "medium", "low", "compromised")
TIER_MARKS = ("high_quality", "medium_quality", "low_quality", "compromised")
HELD_OUT_MARK = "test_set"
BENIGN_MARK = "benign"
MIXED_PREFIX = "mixed_"


def scan_sources(
    spark: SparkSession, paths: str | list[str], fmt: str = "csv", schema: StructType | str | None = None
) -> DataFrame:
    """Read every source file under `paths` in one scan, with a `source_name` column.

    CSV files need a header. Give `schema` for large inputs; inference reads them twice.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    elif schema:
        reader = reader.schema(schema)
    return reader.load(paths).withColumn("source_name", F.col("_metadata.file_name"))


def scan_mixed_sources(spark: SparkSession, paths: list[str], fmt: str = "csv") -> DataFrame:
    """Read sources whose columns differ: union by name, absent features become 0.

    One scan whatever the number of files: Parquet with a merged schema, CSV by an index of headers.
    """
    if fmt == "parquet":
        merged = spark.read.option("mergeSchema", True).parquet(*paths)
        return union_sources([merged.withColumn("source_name", F.col("_metadata.file_name"))])
    rows = scan_headed(spark, paths).filter("NOT bad_row").drop("file_path", "bad_row")
    numeric = [c for c in rows.columns if c != "source_name" and _holds_numbers(rows, c)]
    united = rows.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numeric})
    return united.select(*[F.col(f"`{c}`") for c in sorted(united.columns)])


def scan_headed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of CSV files, each with a header of its own, in one scan: all columns as text, `source_name`, `file_path`, `bad_row`.

    The first line of every file is its header; the plan holds the names found, not the files. A
    column a file lacks is null. `bad_row` marks rows with more or fewer fields than their header;
    lines that repeat it are dropped. Fields may be quoted but not hold line ends.
    """
    lines = spark.read.text(paths).select(
        F.col("value"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("source_name"),
        F.col("_metadata.file_block_start").alias("_start"),
    ).filter("trim(value) <> ''")
    # the block that begins a file is read by one task, in order
    begun = lines.filter("_start = 0").select("file_path", F.col("value").alias("_head"))
    heads = sized(begun.mapInArrow(_first_lines, begun.schema))
    kinds = [r["_head"] for r in heads.table.select("_head").distinct().collect()]
    width = max((len(_fields(h)) for h in kinds), default=0)
    shape = ", ".join(f"c{i} string" for i in range(width + 1))
    names = sorted({n for h in kinds for n in _fields(h)})
    joined = lookup_join(lines, heads, ["file_path"]).filter(F.col("value") != F.col("_head"))
    cells = lambda c: F.array(*[F.col(f"{c}.c{i}") for i in range(width + 1)])
    parsed = joined.withColumns({"_row": F.from_csv("value", shape), "_names": F.from_csv("_head", shape)})
    parsed = parsed.withColumns({"_cells": cells("_row"), "_titles": F.filter(cells("_names"), lambda n: n.isNotNull())})
    # fields are counted outside of quotes: an empty last field is null like an absent one
    fields = lambda c: F.length(F.regexp_replace(F.regexp_replace(c, r'"[^"]*"', ""), "[^,]", "")) + 1
    told = F.map_from_arrays(F.col("_titles"), F.slice("_cells", 1, F.size("_titles")))
    marked = parsed.withColumns({"_map": told, "bad_row": fields(F.col("value")) != F.size("_titles")})
    return marked.select(*[F.try_element_at("_map", F.lit(n)).alias(n) for n in names], "source_name", "file_path", "bad_row")


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each file, whose rows follow each other; an aggregate of texts would sort them all."""
    last = None
    for batch in batches:
        files = batch.column(0)
        changed = pc.not_equal(files.slice(1), files.slice(0, max(0, len(files) - 1))).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate([[files[0].as_py() != last], changed])) if len(files) else []
        last = files[-1].as_py() if len(files) else last
        if len(begins):
            yield batch.take(pa.array(begins))


def _fields(line: str) -> list[str]:
    return [f.strip() for f in next(csv.reader([line]))]


def _holds_numbers(rows: DataFrame, column: str) -> bool:
    """Whether a text column has values and all of them are numbers."""
    values = rows.filter(F.col(column).isNotNull() & (F.trim(column) != ""))
    return not values.isEmpty() and values.filter(F.col(column).try_cast("double").isNull()).isEmpty()


def scan_preferred(spark: SparkSession, folder: str, fmt: str = "csv", schema=None) -> DataFrame:
    """Scan only the files of the best kind of training source in a folder, by its listing."""
    files = [unquote(f) for f in spark.read.format("text").load(folder).inputFiles()]
    listed = spark.createDataFrame([(f, f.rsplit("/", 1)[-1]) for f in files], "path string, source_name string")
    chosen = [r["path"] for r in prefer_sources(listed).collect()]
    if not chosen:
        raise ValueError(f"no training source in {folder}")
    return scan_sources(spark, chosen, fmt, schema)


def _marked(name: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.lower(name).contains(mark)
    return found


def source_class(name: Column) -> Column:
    """'benign', 'held_out', 'tiered', 'mixed' or 'plain', from the source name."""
    return (
        F.when(F.lower(name).contains(BENIGN_MARK), "benign")
        .when(F.lower(name).contains(HELD_OUT_MARK), "held_out")
        .when(_marked(name, TIER_MARKS), "tiered")
        .when(name.startswith(MIXED_PREFIX), "mixed")
        .otherwise("plain")
    )


def prefer_sources(df: DataFrame, name: str = "source_name") -> DataFrame:
    """Keep the best kind of training source present: tiered, else mixed, else plain.

    Benign and held-out sources are never training sources.
    """
    order = {"tiered": 1, "mixed": 2, "plain": 3}
    kind = source_class(F.col(name))
    priority = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in order.items()])
    ranked = df.withColumn("_priority", priority).filter(F.col("_priority").isNotNull())
    best = df.select(F.min(priority)).scalar()
    return ranked.filter(F.col("_priority") == best).drop("_priority")


def benign_sources(df: DataFrame, name: str = "source_name") -> DataFrame:
    return df.filter(F.lower(F.col(name)).contains(BENIGN_MARK))


def quality_tier(name: Column) -> Column:
    """Tier named in a source name, 'unknown' when there is none."""
    tier = F.regexp_extract(name, r"(high|medium|low|compromised)_quality", 1)
    return (
        F.when(tier != "", tier)
        .when(F.lower(name).contains("compromised") & name.contains("_compromised_"), "compromised")
        .otherwise("unknown")
    )


def identify_sources(df: DataFrame, name: str = "source_name") -> DataFrame:
    """One row per source: ordinal in name order, `client_id` and `quality`."""
    names = df.select(name).distinct()
    numbered = global_prefix_sum(names, [F.col(name)], {"ordinal": F.lit(1).cast("bigint")})
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    return numbered.select(
        name,
        "ordinal",
        F.concat(F.lit("client_"), F.col("ordinal").cast("string"), F.lit("_"), stem).alias("client_id"),
        quality_tier(F.col(name)).alias("quality"),
    )


def parent_name(name: Column) -> Column:
    """Name of the clean table a perturbed source was made from ('' when unknown)."""
    return F.regexp_extract(name, r"mixed_[^.]+\.csv", 0)


def reserve_source(df: DataFrame, name: str = "source_name") -> DataFrame:
    """The one source to hold out: a prepared test set, else the first mixed, high or
    medium source, else the last one. None where there is only one source."""
    names = df.select(name).distinct().filter(~F.lower(F.col(name)).contains(BENIGN_MARK))
    lower = F.lower(F.col(name))
    priority = (
        F.when(lower.contains(HELD_OUT_MARK), 1)
        .when(F.col(name).startswith(MIXED_PREFIX), 2)
        .when(lower.contains("high_quality"), 3)
        .when(lower.contains("medium_quality"), 4)
        .otherwise(5)
    )
    best = names.withColumn("_p", priority).groupBy("_p").agg(F.min(name).alias("_a"), F.max(name).alias("_z"))
    chosen = best.orderBy("_p").limit(1).select(F.when(F.col("_p") == 5, F.col("_z")).otherwise(F.col("_a")).alias(name))
    # a lone source is needed for training
    return chosen.filter(df.select(F.count_distinct(name) > 1).scalar())


def training_sources(df: DataFrame, reserved: DataFrame, name: str = "source_name") -> DataFrame:
    """Rows of all sources but the reserved ones."""
    return lookup_join(df, reserved.select(name).distinct(), [name], "left_anti")


def first_sources(df: DataFrame, n: int, name: str = "source_name") -> DataFrame:
    """Rows of the first `n` sources in name order."""
    names = df.select(name).distinct().orderBy(name).limit(n)
    return lookup_join(df, Sized(names, n), [name], "left_semi")


def exclude_sources(df: DataFrame, fragments: list[str], name: str = "source_name") -> DataFrame:
    """Drop sources whose name contains one of the fragments, ignoring case."""
    keep = F.lit(True)
    for fragment in fragments:
        keep = keep & ~F.lower(F.col(name)).contains(fragment.lower())
    return df.filter(keep)
