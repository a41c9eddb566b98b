"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of whole documents in ascending id order, about `chunk_ids` of them:

    magic "PFR1" | n_ids u32 | n_blocks u32 | minimum u32[n_blocks] | width u8[n_blocks]
    | n_exceptions u8[n_blocks] | block start u32[n_blocks] | packed blocks
    | exception positions u8[] | exception values u32[]

A block has 128 ids (the last is filled up with its minimum). Its minimum is subtracted, the
rest is packed at the width that holds the given percentile, and what does not fit is listed
as exceptions. Files lie as one binary value per row in a Parquet folder beside their document
index, so Spark's commit protocol covers them when a task is run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcetrust.llm.encoding import encoded_texts, encoder
from sourcetrust.llm.tables import running

BLOCK, MAGIC = 128, b"PFR1"


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One file of unsigned ids below 2**32."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    table = np.empty((n_blocks, BLOCK), np.uint32)
    flat = table.reshape(-1)
    flat[:n] = ids
    if n < len(flat):
        flat[n:] = flat[n_blocks * BLOCK - BLOCK:n].min()
    low = table.min(axis=1) if n_blocks else np.empty(0, np.uint32)
    rest = table - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    typical = np.partition(rest, at, axis=1)[:, at] if n_blocks else low
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    packed = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = (rest[rows][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
        size = int(w) * BLOCK // 8
        packed[starts[rows][:, None] + np.arange(size)] = np.packbits(bits.reshape(len(rows), -1), axis=1)
    parts = (
        np.array([n, n_blocks], "<u4"), low.astype("<u4"), width, over.sum(axis=1).astype(np.uint8),
        starts[:-1].astype("<u4"), packed, np.nonzero(over)[1].astype(np.uint8), rest[over].astype("<u4"),
    )
    return MAGIC + b"".join(p.tobytes() for p in parts)


def unpack(file: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks `first` to `last` (all by default) of a file, found by their starts."""
    if file[:4] != MAGIC:
        raise ValueError("not a token file")
    n, n_blocks = (int(x) for x in np.frombuffer(file, "<u4", 2, 4))
    at = 12
    columns = []
    for kind in ("<u4", "u1", "u1", "<u4"):
        columns.append(np.frombuffer(file, kind, n_blocks, at))
        at += columns[-1].nbytes
    low, width, n_over, starts = columns
    size = int(width.astype(np.int64).sum()) * (BLOCK // 8)
    packed = np.frombuffer(file, "u1", size, at)
    n_all = int(n_over.astype(np.int64).sum())
    where = np.frombuffer(file, "u1", n_all, at + size)
    values = np.frombuffer(file, "<u4", n_all, at + size + n_all)

    last = n_blocks if last is None else min(last, n_blocks)
    chosen = slice(first, last)
    out = np.zeros((max(0, last - first), BLOCK), np.uint32)
    for w in np.unique(width[chosen]):
        if w:
            rows = np.flatnonzero(width[chosen] == w)
            at_bytes = starts[chosen][rows].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)
            bits = np.unpackbits(packed[at_bytes], axis=1).reshape(len(rows), BLOCK, int(w))
            out[rows] = bits @ (1 << np.arange(int(w), dtype=np.int64))
    before = np.concatenate([[0], np.cumsum(n_over.astype(np.int64))])
    mine = slice(before[first] if first < n_blocks else n_all, before[last])
    out[np.repeat(np.arange(len(out)), n_over[chosen]), where[mine]] = values[mine]
    out += low[chosen, None]
    return out.reshape(-1)[: max(0, min(n, last * BLOCK) - first * BLOCK)]


FILES = "part int, chunk int, before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, file binary"


def write_token_files(
    df: DataFrame, folder: str, tokenizer: str, end_id: int, id_: str = "doc_id", text: str = "text",
    kind: str = "whole", chunk_ids: int = 1 << 16, percentile: float = 0.9,
) -> None:
    """Encode all texts (null: empty) and write their ids in ascending id order.

    Each document ends with `end_id`, so an empty text has one id. Null ids come first; rows that
    repeat an id are ordered by a hash of their text. A long document is never divided: it makes
    a longer file. An empty table makes an empty folder.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, kind), TaskContext.get().partitionId()
        end = np.asarray([end_id], encode.dtype).tobytes()
        doc_ids, lengths, parts, chunk, before, size = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            file = pack(np.frombuffer(b"".join(parts), encode.dtype), percentile)
            return pa.RecordBatch.from_pylist([{
                "part": part, "chunk": chunk, "before": before, "n_ids": size,
                "doc_ids": doc_ids, "lengths": lengths, "file": file,
            }], schema=ARROW)

        for batch in batches:
            made = encoded_texts(encode, (value.as_py() for value in batch.column(1)))
            for doc, value in zip(batch.column(0).to_pylist(), made, strict=True):
                ids = value + end
                n = len(ids) // encode.dtype.itemsize
                doc_ids.append(doc)
                lengths.append(n)
                parts.append(ids)
                size += n
                if size >= chunk_ids:
                    yield closed()
                    doc_ids, lengths, parts, chunk, before, size = [], [], [], chunk + 1, before + size, 0
        if doc_ids:
            yield closed()

    rows = df.select(F.col(id_).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ranged = rows.repartitionByRange("_id").sortWithinPartitions("_id", F.xxhash64("_text"), "_text")
    ranged.mapInArrow(files, FILES).write.mode("overwrite").parquet(folder)


ARROW = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("file", pa.binary()),
])


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first, docs, lengths, file = (batch.column(i)[row].as_py() for i in range(4))
                ids = unpack(file).astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - np.asarray(lengths)
                spans = [ids[a:b] for a, b in zip(begins, ends, strict=True)]
                columns = [
                    pa.array(docs, pa.int64()), pa.array(begins + first, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(s.tobytes()) for s in spans], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([s.astype(np.int64) for s in spans], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    stored = spark.read.schema(FILES).parquet(folder)
    # one row per range partition
    shifts = running(stored.groupBy("part").agg(F.sum("n_ids").alias("_n")), "part", "_n", "_shift")
    placed = stored.join(F.broadcast(shifts.select("part", "_shift")), "part")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return placed.select(F.col("before") + F.col("_shift"), "doc_ids", "lengths", "file").mapInArrow(documents, schema)
