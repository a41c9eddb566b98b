"""Near duplicates by 64-bit SimHash and the pigeonring principle.

A fingerprint is a ring of five segments. If two differ in at most four bits, then on some segment
starts a chain in which the first segment differs in at most 4/5 bits (none), the first two in at
most 8/5 (one), three in at most two, four in at most three. The first two conditions are an
equi-join on 25 or 26 bits - one side also enters its key with each bit of the second segment
flipped - and the other two prune before the full comparison.

Dense groups do not make all their pairs: fingerprints that agree outside one segment are linked
first (at most 2**13 distinct ones share a bucket, so a bucket fits into a task), and the join
keeps only pairs which that step has not already put below the same smallest fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sourcetrust.llm.components import components
from sourcetrust.llm.tables import Workspace, fresh_worker, linked, whole_groups

SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, bits
MOST = 4  # differing bits
SEED = 42


def text_fingerprint(text: str, shingle: int = 4, block: int = 1 << 16) -> int:
    """SimHash of a whole text, in blocks of shingles; zero where there is no word."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    last = max(1, len(words) - shingle + 1)
    ends = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, last, block):
        spans = zip(starts[at:min(at + block, last)], ends[at:at + block])
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """id, fp (bigint) per row; null text counts as empty and has fingerprint zero."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            values = [text_fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            column = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["id", "fp"])

    rows = df.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(hashed, "id bigint, fp bigint")


def _segment(fp: Column, i: int) -> Column:
    first, bits = SEGMENTS[i % 5]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _chain_key(fp: Column, i: int) -> Column:
    return F.shiftleft(_segment(fp, i), 13).bitwiseOR(_segment(fp, i + 1)).bitwiseOR(F.lit(i << 32))


def fingerprint_links(nodes: DataFrame, space: Workspace) -> DataFrame:
    """Links (a, b: fingerprints) that join all distinct fingerprints (column fp) within four bits of each other."""
    masks = [((1 << bits) - 1) << first for first, bits in SEGMENTS]
    signed = [((~m & (1 << 64) - 1) ^ (1 << 63)) - (1 << 63) for m in masks]
    buckets = nodes.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(keep))) for i, keep in enumerate(signed)
    ])).alias("bucket"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket", 1 << 16):
            bucket, fp = (table.column(c).to_numpy() for c in ("bucket", "fp"))
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[starts, len(bucket)])
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                some = fp[at:at + size]
                left, right = [], []
                for k in range(0, size, 512):
                    i, j = np.nonzero(np.bitwise_count((some[k:k + 512, None] ^ some).view(np.uint64)) <= MOST)
                    left.append(i[i + k < j] + k)
                    right.append(j[i + k < j])
                low = linked(size, np.concatenate(left), np.concatenate(right))
                hung = low != np.arange(size)
                found.append((some[hung], some[low[hung]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    near = buckets.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(inside, "a bigint, b bigint")
    near = space.keep(near, "near")
    hung = near.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("low"))
    # a root hangs below itself, so that it and what hangs below it are known to be linked
    known = nodes.join(hung, "fp", "left").withColumn("low", F.coalesce("low", "fp"))
    known = space.keep(known, "known")

    exact = known.select("fp", "low", F.explode(F.array(*[_chain_key(F.col("fp"), i) for i in range(5)])).alias("key"))
    flips = [(i, 1 << b) for i in range(5) for b in range(SEGMENTS[(i + 1) % 5][1])]
    variants = [_chain_key(F.col("fp"), i) for i in range(5)]
    variants += [_chain_key(F.col("fp"), i).bitwiseXOR(F.lit(bit)) for i, bit in flips]
    probe = known.select(F.col("fp").alias("a"), F.col("low").alias("a_low"), F.explode(F.array(*variants)).alias("key"))
    differing = F.col("a").bitwiseXOR(F.col("fp"))
    chain = _budgets(F.shiftright(F.col("key"), 32), differing)
    pairs = probe.join(exact, "key").filter(
        (F.col("a") < F.col("fp")) & (F.col("a_low") != F.col("low")) & chain & (F.bit_count(differing) <= MOST)
    )
    far = pairs.select("a", F.col("fp").alias("b"))
    return near.unionByName(far)


def _budgets(start: Column, differing: Column) -> Column:
    """The chain's third and fourth budgets."""
    test = F.lit(True)
    for i in range(5):
        counts = [F.bit_count(_segment(differing, i + k)) for k in range(4)]
        fits = (counts[0] + counts[1] + counts[2] <= 2) & (counts[0] + counts[1] + counts[2] + counts[3] <= 3)
        test = F.when(start == i, fits).otherwise(test)
    return test


def near_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """Per row: id, fp, component (smallest id reachable over fingerprints at most four bits apart).

    Null and empty texts have fingerprint zero and are linked like others. Rows with a null id get
    the component of their fingerprint, null if no row with an id has it. A repeated row gets the
    result of the first; other columns are not read. An empty table gives no rows.
    """
    space = Workspace(df.sparkSession, "simhash")
    rows = space.keep(fingerprints(df, id_, text, shingle), "fingerprints")
    nodes = space.keep(rows.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    links = fingerprint_links(nodes.select("fp"), space)
    first = nodes.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a"))
    second = nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b"))
    named = links.join(first, "a").join(second, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    found = components(named, space)
    of_fp = nodes.join(found, nodes["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component")
    )
    return rows.join(space.keep(of_fp, "of-fingerprint"), "fp", "left").select("id", "fp", "component")


def drop_near_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df` whose id is the smallest of its component, with all columns; rows without an id stay."""
    found = near_duplicates(df, id_, text, **options).filter("id <> component")
    gone = found.select(F.col("id").alias("id")).distinct()
    rows = df.select(F.col(id_).cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return rows.join(gone, "id", "left_anti").select("row.*")
