"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Texts are compared without white space. Three combining stages, all grouped by the digest
*and* the full normalised text, so a digest collision can never merge two texts:

1. each task combines its own rows (the partial aggregate before the shuffle),
2. groups of (digest, salt, text) combine what tasks found; the salt is a hash of the id, so
   copies of a hot text are dealt over `salts` groups,
3. the at most `salts` winners of a text are combined to the global winner.

The winner goes back to the rows by an equi-join on the whole SHA-256, a second hash and the
length, whose hot partitions adaptive execution splits. This stage alone compares hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed value: the white space that does not count
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def mark_duplicates(
    df: DataFrame, id_: str = "doc_id", text: str = "text", salts: int = 64, out: str = "dedup", digest_bits: int = 256
) -> DataFrame:
    """All rows and columns of `df` plus the struct `out`: keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the smallest id. Null text counts as empty;
    empty texts are one group. A null id loses every tie; if all ids of a group are null, keep_id
    is null and its rows are kept. Rows repeating an id are the same document: they count in
    group_size and share the decision. A column named `out` is replaced, others may have any name.
    Long texts are compared as a whole. An empty table gives none.
    """
    kept = [c for c in df.columns if c != out]
    # the caller's columns travel as one, so their names meet none of those used here
    rows = df.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"),
        F.col(f"`{id_}`").cast("long").alias("id"), F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("length"),
        normalised(F.col(f"`{text}`")).alias("norm"),
    ).withColumn("sha", F.sha2("norm", 256))
    rows = rows.withColumns({"digest": F.substring("sha", 1, digest_bits // 4), "check": F.xxhash64("norm"), "size": F.length("norm")})
    # the bitwise complement turns the smallest id into the largest without overflow; null sorts first
    rank = F.struct(F.col("length").alias("n"), F.bitwise_not(F.col("id")).alias("r"))
    salted = (
        rows.select("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "norm", rank.alias("best"))
        .groupBy("digest", "salt", "norm")
        .agg(F.count("*").alias("n"), F.max("best").alias("best"))
    )
    whole = F.col("digest") if digest_bits >= 256 else F.sha2("norm", 256)
    winners = (
        salted.groupBy("digest", "norm")
        .agg(F.sum("n").alias("n"), F.max("best").alias("best"))
        .select(
            whole.alias("d"), F.xxhash64("norm").alias("c"), F.length("norm").alias("s"),
            F.col("n").alias("copies"), F.bitwise_not(F.col("best.r")).alias("keep"),
        )
    )
    same = (F.col("sha") == F.col("d")) & (F.col("check") == F.col("c")) & (F.col("size") == F.col("s"))
    marks = F.struct(
        F.col("keep").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    joined = rows.drop("norm").join(winners, same)
    return joined.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept)], marks.alias(out))


def drop_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df` that stay, with its columns."""
    name = "_dedup"
    while name in df.columns:
        name += "_"
    marked = mark_duplicates(df, id_, text, out=name, **options)
    return marked.filter(F.col(name)["kept"]).drop(name)
