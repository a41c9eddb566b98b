"""Fill-in-middle: texts cut at unit ends in three parts and put together in another order.

A unit is a word with the white space before it, or the white space that ends a text. Unit ends
are found eight bytes at a time: the UTF-8 bytes are viewed as 64-bit words, arithmetic on whole
words marks the bytes that end a unit, and the marks of a word are counted at once. A cut after k
units is a search of k in the running counts, then a select of the mark inside the word found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

# fixed values: the marks before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = r"<[PSM]>"

BLOCK = 1 << 17  # words (of 8 bytes) marked at a time
BATCH_BYTES = 4 << 20  # texts are taken together up to this size


def _lanes(byte: int) -> np.uint64:
    """The byte in all eight lanes."""
    return np.uint64(byte * 0x0101010101010101)


HIGH, LOW = _lanes(0x80), _lanes(0x7F)


def _blank_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is 0x20 or 0x09 to 0x0D."""
    low = words & LOW
    space = ~((low ^ _lanes(0x20)) + LOW)  # no lane exceeds 0xFE, so nothing is carried over
    control = (low + _lanes(0x80 - 0x09)) & ~(low + _lanes(0x80 - 0x0E))
    return (space | control) & HIGH & ~words


def unit_ends(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words of `data` (bytes, padded to whole words with blanks) with the high bit of each unit-ending byte.

    A unit ends where white space follows another byte, and at the `last` byte of every text.
    """
    words = data.view("<u8")
    ends = np.empty(len(words), np.uint64)
    for at in range(0, len(words), BLOCK):
        blank = _blank_marks(words[at:at + BLOCK + 1])
        n = min(BLOCK, len(words) - at)
        following = blank[:n] >> np.uint64(8)
        following[:len(blank) - 1] |= blank[1:n + 1] << np.uint64(56)
        ends[at:at + n] = following & ~blank[:n]
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << (8 * (last & 7)).astype(np.uint64))
    return ends


def select(ends: np.ndarray, upto: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place after the `rank`-th (from 1) marked byte; `upto` are the running counts of marks."""
    word = np.searchsorted(upto, rank, side="left")
    marks = ends[word]
    left = rank - upto[word] + np.bitwise_count(marks)  # rank inside the word
    for step in range(2, 9):
        marks = np.where(left >= step, marks & (marks - np.uint64(1)), marks)
    lowest = marks & (~marks + np.uint64(1))
    return word * 8 + (np.bitwise_count(lowest - np.uint64(1)) >> 3) + 1


def draws(id_: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).digest()
    return np.frombuffer(digest, ">u4", 4).tolist()


def transform(texts: list[str], ids: list, share: int, first: int, seed: int) -> list[tuple]:
    """Per text: n, form, output, prefix_chars, middle_chars."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(t) for t in raw], np.int64)
    padded = (sizes + 7) & ~7
    begins = np.cumsum(padded) - padded
    data = np.frombuffer(b"".join(t + b" " * (-len(t) % 8) for t in raw), np.uint8)
    filled = sizes > 0
    ends = unit_ends(data, (begins + sizes - 1)[filled])
    upto = np.cumsum(np.bitwise_count(ends), dtype=np.int64)
    before = np.r_[0, upto][begins >> 3]
    units = np.r_[0, upto][(begins + padded) >> 3] - before

    hashes = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(hashes[:, :2] % (units + 1)[:, None], axis=1)
    places = np.zeros(cuts.shape, np.int64)
    some = cuts > 0
    places[some] = select(ends, upto, (before[:, None] + cuts)[some]) - np.broadcast_to(begins[:, None], cuts.shape)[some]

    out = []
    for k, text in enumerate(raw):
        marked = any(m in text for m in (b"<P>", b"<S>", b"<M>"))
        n = int(units[k])
        if not text or marked or hashes[k, 2] % 100 >= share:
            out.append((n, "plain", texts[k], None, None))
            continue
        a, b = places[k].tolist()
        prefix, middle, suffix = text[:a].decode(), text[a:b].decode(), text[b:].decode()
        form = "spm" if hashes[k, 3] % 100 < first else "psm"
        ahead = f"{SUFFIX}{suffix}{PREFIX}{prefix}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}"
        out.append((n, form, f"{ahead}{MIDDLE}{middle}", len(prefix), len(middle)))
    return out


RESULT = StructType().add("n", "long").add("form", "string").add("output", "string").add(
    "prefix_chars", "long").add("middle_chars", "long")


def fill_in_middle(
    df: DataFrame, id_: str = "doc_id", text: str = "text", share: int = 50, spm_share: int = 80, seed: int = 42,
    out: str = "fim",
) -> DataFrame:
    """All rows and columns of `df` plus the struct `out`: n, form, output, prefix_chars, middle_chars.

    `share` of 100 texts are transformed, `spm_share` of 100 of these with the suffix first. Cuts and
    form hang on the seed and the id alone; rows that repeat an id draw alike, a null id draws as an
    empty one. Null text counts as empty; empty texts and those that hold a mark stay plain, with
    null lengths. A text without white space is one unit. A text takes about five times its size in
    the task's memory, however long it is. A column named `out` is replaced, others may have any
    name. An empty table gives no rows.
    """
    kept = [c for c in df.columns if c != out]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = df.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), whole)
    arrow = pa.struct([
        ("n", pa.int64()), ("form", pa.string()), ("output", pa.string()),
        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([0, *(len(t.as_buffer()) for t in batch.column(1))])
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BATCH_BYTES, "right")) - 1)
                some = batch.slice(at, end - at)
                found = transform(some.column(1).to_pylist(), some.column(0).to_pylist(), share, spm_share, seed)
                values = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [f.type for f in arrow], strict=True)]
                struct = pa.StructArray.from_arrays(values, fields=list(arrow))
                yield pa.RecordBatch.from_arrays([some.column(2), struct], ["row", "fim"])
                at = end

    schema = StructType().add("row", rows.schema["row"].dataType).add("fim", RESULT)
    result = rows.mapInArrow(made, schema)
    return result.select(*[F.col("row")[c].alias(c) for c in kept], F.col("fim").alias(out))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone; it held no mark, so the marks part it."""
    parts = F.split(output, MARK, -1)
    part = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )
