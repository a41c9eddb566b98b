"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one row with a count from the start. In each pass a vector's key is the
concatenated signs of the products of random directions with what the vector has besides its label's
mean, and the vectors of all labels are range-partitioned and sorted by (pass, label, key). Vectors
at a small angle share a long prefix of the key with good probability, so each is compared with its
next `window` neighbours, as they stream through a task; pairs at the threshold are links. Rounds of
passes go on for a label until one adds at most `NEW` of the links that join its components, so that
recall holds whatever the label's size and density; a label within one window is done in one round.

Within a component all pairs are then compared, in blocks that return counts instead of pairs, so
that a group denser than the window still gets every one of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from sourcetrust.llm.components import components
from sourcetrust.llm.tables import Workspace, linked, whole_groups

BITS = 48  # of each of a key's two words
BLOCK = 512  # vectors of a slice; two slices are one piece of work
NEW = 0.005  # share of a label's joining links that the last round of passes may add
USUAL = 16384  # vectors of a label; each doubling above takes two more passes a round


def unit_rows(vectors: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Vectors of one dimension scaled to length one, in double precision and without overflow."""
    table = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    table = table / np.abs(table).max(axis=1, keepdims=True)
    return table / np.sqrt((table * table).sum(axis=1, keepdims=True))


def number_kind(df: DataFrame, vector: str) -> str:
    """Single precision where the column has it: it holds the same numbers in half the bytes."""
    return "<f4" if isinstance(getattr(df.schema[vector].dataType, "elementType", None), FloatType) else "<f8"


def usable(df: DataFrame, id_: str, vector: str, label: str) -> DataFrame:
    """id, label, dim, vec (numbers as bytes) of the rows that can link, one per id."""
    kind = number_kind(df, vector)
    values = F.col("vector")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(
        F.col(id_).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.filter(F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # -0.0 and 0.0 are the same number
            vectors = [np.asarray(v, kind) + 0.0 for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(v) for v in vectors], pa.int32()),
                pa.array([v.astype(kind).tobytes() for v in vectors], pa.binary()),
            ], ["id", "label", "dim", "vec"])

    return rows.mapInArrow(packed, "id bigint, label string, dim int, vec binary")


def label_means(vectors: DataFrame, kind: str) -> DataFrame:
    """part, mean (doubles as bytes): mean of the unit vectors of each part."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            parts = batch.column(0).to_numpy()
            order = np.argsort(parts, kind="stable")
            vecs = batch.column(1).to_pylist()
            for at in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1) if len(order) else []:
                unit = unit_rows([vecs[i] for i in at], kind)
                sums[int(parts[at[0]])] = np.r_[unit.sum(axis=0), len(unit)]
            yield pa.RecordBatch.from_arrays([
                pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary()),
            ], ["part", "sum"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.frombuffer(v) for v in rows["sum"]], axis=0)
        mean = np.round(whole[:-1] / whole[-1], 6)  # the same in any order of summing
        return pd.DataFrame({"part": rows["part"].iloc[:1], "mean": [mean.tobytes()]})

    sums = vectors.select("part", "vec").mapInArrow(summed, "part bigint, sum binary")
    return sums.groupBy("part").applyInPandas(total, "part bigint, mean binary")


def projected(vectors: DataFrame, passes: int, seed: list[int], kind: str) -> DataFrame:
    """Every vector (part, dim, id, vec, mean) once per pass, with the pass's sort key."""
    names = ["pass", "part", "dim", "id", "vec", "key", "more"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes = {dim: np.random.default_rng([*seed, dim]).standard_normal((dim, passes * 2 * BITS))}
                some = batch.filter(pa.array(dims == dim))
                for at in range(0, some.num_rows, 1024):
                    part = some.slice(at, 1024)
                    mean = np.frombuffer(b"".join(part.column(4).to_pylist())).reshape(part.num_rows, dim)
                    signs = (unit_rows(part.column(3).to_pylist(), kind) - mean) @ planes[dim] > 0
                    keys = signs.reshape(part.num_rows, passes, 2, BITS) @ weights
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(part.num_rows, p, np.int32)), *part.columns[:4],
                            pa.array(keys[:, p, 0]), pa.array(keys[:, p, 1]),
                        ], names)

    rows = vectors.select("part", "dim", "id", "vec", "mean")
    return rows.mapInArrow(keyed, "pass int, part bigint, dim int, id bigint, vec binary, key bigint, more bigint")


def window_links(keyed: DataFrame, threshold: float, window: int, kind: str) -> DataFrame:
    """Links a, b that connect whatever neighbour windows connect, at most one per row and batch.

    Windows end at the borders of the range partitions, which lie elsewhere in every pass.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # pass and part of the rows held, their ids and vectors
        for batch in batches:
            if not batch.num_rows:
                continue
            pass_, part, ids = (batch.column(i).to_numpy() for i in (0, 1, 3))
            vecs = batch.column(4).to_pylist()
            cuts = [0, *(np.flatnonzero((np.diff(pass_) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(ids)]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, some, where = ids[a:b], vecs[a:b], (pass_[a], part[a])
                if last is not None and last[0] == where:
                    own, some = np.r_[last[1], own], last[2] + some
                unit, left, right = unit_rows(some, kind), [], []
                for k in range(0, len(own), 256):
                    i, j = np.nonzero(unit[k:k + 256] @ unit[k:k + 256 + window].T >= threshold)
                    inside = (j > i) & (j - i <= window)
                    left.append(i[inside] + k)
                    right.append(j[inside] + k)
                low = linked(len(own), np.concatenate(left), np.concatenate(right))
                hung = low != np.arange(len(own))
                found.append((own[hung], own[low[hung]]))
                last = where, own[-window:], some[-window:]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    order = [F.col(c) for c in ("pass", "part", "key", "more", "id")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("pass", "part", "dim", "id", "vec").mapInArrow(compared, "a bigint, b bigint")


def slice_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Rows dealt to pieces of work (`work`, sorted) that hold every pair of a group at least once.

    A group of n vectors is dealt by a hash of the id into n / BLOCK slices; each pair of slices is
    one piece of work.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices"))
    sliced = rows.join(sizes, group).withColumn("s", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    others = F.sequence(F.lit(0), F.col("slices") - 1)
    dealt = sliced.withColumn("o", F.explode(others)).withColumns({
        "low": F.least("s", "o"), "high": F.greatest("s", "o"),
    }).withColumn("work", F.xxhash64(group, "low", "high"))
    work = dealt.select("work", F.col(group).alias("group"), "low", "high", "id", "s", "copies", "vec")
    return work.repartition("work").sortWithinPartitions("work")


def pass_links(
    vectors: DataFrame, parts: DataFrame, space: Workspace, threshold: float, passes: int, window: int, seed: int, kind: str
) -> DataFrame:
    """Links a, b of all parts (part, rows), by rounds of passes until hardly any are new."""
    means = space.keep(label_means(vectors, kind), "means")
    links, turn = None, 0
    active = parts.filter("rows > 1").withColumn("joined", F.lit(0).cast("long"))
    while True:
        most = active.agg(F.max("rows")).first()[0]
        if most is None:
            break
        some = vectors.join(active.select("part"), "part", "left_semi").join(means, "part")
        # larger parts take more passes a round, as a long prefix is shared less often
        more = passes + 2 * max(0, int(np.ceil(np.log2(most / USUAL))))
        new = window_links(projected(some, more, [seed, turn], kind), threshold, window, kind).distinct()
        new = space.keep(new, f"links-{turn}")
        links = new if links is None else links.unionByName(new)
        hung = components(links, space, f"round-{turn}").filter("node <> component")
        now = hung.join(vectors.select("part", "id"), F.col("node") == F.col("id")).groupBy("part").agg(F.count("*").alias("now"))
        counted = active.join(now, "part", "left").withColumn("now", F.coalesce("now", F.lit(0)))
        # a part within a window has had all its pairs compared
        going = (F.col("rows") > window + 1) & (F.col("now") - F.col("joined") > NEW * F.col("now"))
        active = space.keep(counted.filter(going).select("part", "rows", F.col("now").alias("joined")), f"active-{turn}")
        turn += 1
    return vectors.sparkSession.createDataFrame([], "a bigint, b bigint") if links is None else links


def link_counts(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """id, n_links: exact number of links of each distinct vector to the rows of its component."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "work", 4 * BLOCK):
            rows = table.to_pandas()
            for key, group in rows.groupby(["work", "group", "low", "high"], sort=False):
                ids, slices, low, high = group["id"].to_numpy(), group["s"].to_numpy(), key[2], key[3]
                unit, copies = unit_rows(group["vec"].tolist(), kind), group["copies"].to_numpy().astype(np.float64)
                links = np.zeros(len(ids), np.int64)
                for k in range(0, len(ids), 512):
                    near = unit[k:k + 512] @ unit.T >= threshold
                    if low != high:
                        near &= slices[k:k + 512, None] != slices
                    near[np.arange(near.shape[0]), np.arange(k, k + near.shape[0])] = False
                    links[k:k + 512] = near @ copies
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["id", "n_links"])

    found = slice_pairs(members, "component").mapInArrow(counted, "id bigint, n_links bigint")
    return found.groupBy("id").agg(F.sum("n_links").alias("n_links"))


def near_vectors(
    df: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = 0.98, passes: int = 6, window: int = 64, seed: int = 7,
) -> DataFrame:
    """Per row: id, n_links, component (smallest id reachable), kept (id = component).

    Only vectors of equal label and dimension are compared. A null label, id or vector, an empty or
    zero vector, and one with null or non-finite components link with nothing: n_links 0, their own
    component (a null id has none, and stays). Rows that repeat an id are one vector, the smallest of
    them by label and components. Equal vectors link. An empty table gives no rows.
    """
    space, kind = Workspace(df.sparkSession, "embeddings"), number_kind(df, vector)
    vectors = space.keep(usable(df, id_, vector, label), "vectors")
    same = ["label", "dim", "vec"]
    distinct = space.keep(vectors.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "distinct")
    parts = distinct.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    parts = space.keep(parts.withColumn("part", F.monotonically_increasing_id()), "parts")
    rows = distinct.join(parts, ["label", "dim"]).select("part", "dim", F.col("rep").alias("id"), "copies", "vec")
    rows = space.keep(rows, "rows")
    links = pass_links(rows, parts.select("part", "rows"), space, threshold, passes, window, seed, kind)
    found = space.keep(components(links, space), "members")
    members = rows.join(found, rows["id"] == found["node"]).select("component", "id", "copies", "vec")
    counts = link_counts(members, threshold, kind)
    near = found.join(counts, found["node"] == counts["id"]).select("node", "component", "n_links")
    # a copy has the links of the first of its kind, and one to each other copy
    several = distinct.filter("copies > 1").join(near, F.col("rep") == F.col("node"), "left").select(
        *same, "copies", F.coalesce("component", "rep").alias("component"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    copied = vectors.join(several, same).select(F.col("id").alias("node"), "component", "n_links")
    single = rows.filter("copies = 1").select("id").join(near, F.col("id") == F.col("node")).select("node", "component", "n_links")
    result = single.unionByName(copied)
    ids = df.select(F.col(id_).cast("long").alias("id"))
    joined = ids.join(result, ids["id"] == result["node"], "left")
    component = F.coalesce("component", "id")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
