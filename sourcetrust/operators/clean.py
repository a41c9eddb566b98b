"""Label and feature cleaning for many sources at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from sourcetrust.operators.joins import lookup_join

# fixed values: columns that identify a row or hold its label, never features
NON_FEATURES = (
    "flow_id", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "Label", "label",
)
CLIP = 1e6
STD_GUARD = 1e-8


def find_column(df: DataFrame, wanted: str) -> str:
    """First column whose name equals `wanted` ignoring case."""
    for name in df.columns:
        if name.lower() == wanted.lower():
            return name
    raise ValueError(f"column {wanted!r} not found")


def rename_column(df: DataFrame, wanted: str) -> DataFrame:
    return df.withColumnRenamed(find_column(df, wanted), wanted)


def binary_labels(
    df: DataFrame, raw: str = "label_raw", source: str = "client_id", out: str = "label", strict: bool = False
) -> DataFrame:
    """0/1 label per row. A source whose labels are all 0 or 1 keeps them; in any other
    source the text BENIGN (any case) is 0 and everything else, null included, is 1.

    `strict` leaves the label null where the raw label is null.
    """
    number = F.col(raw).cast("string").try_cast("double")
    is_binary = F.coalesce(number.isin(0.0, 1.0), F.lit(False))
    kinds = df.groupBy(source).agg(F.bool_and(is_binary).alias("_binary"))
    text = F.when(F.upper(F.col(raw).cast("string")) == "BENIGN", 0).otherwise(1)
    label = F.when(F.col("_binary"), number.cast("int")).otherwise(text)
    if strict:
        label = F.when(F.col(raw).isNotNull(), label)
    return lookup_join(df, kinds, [source]).withColumn(out, label.cast("int")).drop("_binary")


def is_benign(label: Column) -> Column:
    """Whether a label of any kind is benign: 0, or the text BENIGN in any case; null is not."""
    text = label.cast("string")
    return F.coalesce((F.upper(text) == "BENIGN") | (text.try_cast("double") == 0.0), F.lit(False))


def feature_columns(df: DataFrame, exclude: Iterable[str] = NON_FEATURES) -> list[str]:
    """Numeric columns that are neither identifiers nor labels (schema only, no job)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, NumericType)]


def finite(x: Column) -> Column:
    """Null, NaN and infinities become 0."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def clipped(x: Column, limit: float = CLIP) -> Column:
    return F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))


def finite_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: finite(F.col(f)) for f in features})


def clip_features(df: DataFrame, features: list[str], limit: float = CLIP) -> DataFrame:
    return df.withColumns({f: clipped(F.col(f), limit) for f in features})


def standardise(df: DataFrame, features: list[str], source: str = "client_id") -> DataFrame:
    """Centre and scale each feature by the mean and population std of its source.

    Statistics are one row per source, so rows themselves are not shuffled.
    """
    stats = df.groupBy(source).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"_d_{f}") for f in features],
    )
    joined = lookup_join(df, stats, [source])
    scaled = {}
    for f in features:
        std = F.when(F.col(f"_d_{f}") == 0.0, F.lit(1.0)).otherwise(F.col(f"_d_{f}"))
        scaled[f] = (F.col(f) - F.col(f"_m_{f}")) / (std + STD_GUARD)
    return joined.withColumns(scaled).drop(*[f"_{k}_{f}" for k in "md" for f in features])


def prepare_features(df: DataFrame, features: list[str], source: str = "client_id") -> DataFrame:
    """Finite, clipped and standardised features."""
    ready = df.withColumns({f: clipped(finite(F.col(f))) for f in features})
    return standardise(ready, features, source)


def union_sources(tables: list[DataFrame], keys: Iterable[str] = ()) -> DataFrame:
    """Union by name; a feature missing in a table is 0 there, a missing identifier or label is null.
    Columns come out as `keys` followed by the rest in name order."""
    keys = list(keys)
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    rest = sorted(c for c in merged.columns if c not in keys)
    absent = [c for c in feature_columns(merged.select(*rest))]
    return merged.fillna(0, subset=absent).select(*keys, *rest) if absent else merged.select(*keys, *rest)


def align_features(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Exactly `features`, in that order: absent ones are 0, extra ones are dropped."""
    have = set(df.columns)
    return df.select(*keys, *[F.col(f) if f in have else F.lit(0.0).alias(f) for f in features])


def of_class(df: DataFrame, value: int, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) == value)


def feature_vector(df: DataFrame, features: list[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(f).cast("double") for f in features]))
