"""Removal of long repeated byte strings by per-shard suffix arrays.

Every string of `length` bytes (a window) has one anchor: the 32-byte gram in it with the least
hash, the leftmost on ties. Equal windows have equal anchors, so only windows with the same anchor
gram need to meet. The windows of one anchor in a document are a run of starts; the run and the
bytes its windows cover are a segment.

1. Segments are stored and counted by (gram hash, segment hash), 128 bits together. A gram seen once
   repeats nothing. Of a segment seen twice all windows are repeated.
2. Grams with several distinct segments go, one copy of each segment, to shards of at most about
   `shard_segments` segments: a gram's segments are dealt over as many shards as they need. A shard
   builds its suffix array by Larsson-Sadakane refinement and the common prefixes of neighbours by
   Kasai's rule, walked over all segments in step; a window is repeated where a neighbour shares
   `length` bytes.
3. Shards of one gram hand on their distinct windows: for each slice of the windows' hashes one row
   of sorted 128-bit hashes, seeded with the gram. Slices are merged by binary search of every
   shard's list. A gram that lies in one shard has nothing to merge.
4. Documents get the repeated windows of their segments, and lose the bytes these cover.

No step gathers a hot gram: counts are partial aggregates, the joins are split by adaptive
execution, and a shard's and a slice's size are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from sourcetrust.llm.tables import Workspace, fresh_worker, whole_groups

GRAM = 32
PLACE_BITS = 20  # documents are scanned in pieces of at most 2**20 bytes
NO_ID = -(1 << 63)

_table = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on."""
    factor, hashes, width = 0x9E3779B97F4A7C15, _table[data], 1
    while width < GRAM:
        hashes = hashes[:-width] * np.uint64(factor) + hashes[width:]
        factor, width = factor * factor % (1 << 64), width * 2
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    return hashes


def _runs(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined to at most 2**20 bytes: gram hash, first window and last window of every segment."""
    nothing = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) < length:
        return nothing
    hashes, span = gram_hashes(np.frombuffer(data, np.uint8)), length - GRAM + 1
    mask = np.uint64((1 << PLACE_BITS) - 1)
    n = len(hashes)
    ranked = np.full((-(-n // span) + 1) * span, ~np.uint64(0))
    ranked[:n] = (hashes & ~mask) | np.arange(n, dtype=np.uint64)
    blocks = ranked.reshape(-1, span)
    upto = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(since[:n - span + 1], upto[span - 1:n]) & mask).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    change = np.zeros(len(anchor) + 1, np.int32)
    long = ends - begins >= length
    np.add.at(change, begins[long], 1)
    np.add.at(change, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(change[:-1]))
    if not len(window):
        return nothing
    chosen, text = anchor[window], np.searchsorted(ends, window, side="right")
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    return hashes[chosen[new]], window[new], window[np.r_[new[1:] - 1, len(window) - 1]]


def segments(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Per text with windows: its index, gram hashes, first and last windows, segment hashes.

    Short texts are scanned together, long ones in overlapping pieces.
    """
    limit = 1 << PLACE_BITS
    at = 0
    while at < len(texts):
        if len(texts[at]) > limit:
            text, parts = texts[at], []
            for piece in range(0, len(text) - length + 1, limit - length + 1):
                some = text[piece:piece + limit]
                grams, first, last = _runs(some, np.array([len(some)]), length)
                parts.append((grams, first + piece, last + piece))
            grams, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield at, grams, first, last, _digests(text, grams, first, last, length)
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= limit:
            size, end = size + len(texts[end]), end + 1
        data = b"".join(texts[at:end])
        ends = np.cumsum([len(t) for t in texts[at:end]])
        grams, first, last = _runs(data, ends, length)
        hashes = _digests(data, grams, first, last, length)
        text = np.searchsorted(ends, first, side="right")
        cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True][:len(text) + 1]).tolist() if len(text) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            begin = int(ends[text[a]] - len(texts[at + text[a]]))
            yield at + int(text[a]), grams[a:b], first[a:b] - begin, last[a:b] - begin, hashes[a:b]
        at = end


def _digests(data: bytes, grams: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    rows = zip(first.tolist(), (last + length).tolist(), grams.tolist(), strict=True)
    return [digest(data[a:b], g) for a, b, g in rows]


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


# suffix arrays


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the first 8 bytes of each suffix as a number.

    Ordered by 8 bytes first; each round doubles the ordered length, and only suffixes that are still
    alike take part. They are ordered to the end, as Kasai's rule holds in the full order alone.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i:n + i]
    order = np.argsort(words)
    new = np.r_[True, words[order[1:]] != words[order[:-1]]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    known = 8
    while True:
        alone = new & np.r_[new[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        suffix = order[open_]
        key = (rank[suffix] << 32) | (rank[np.minimum(suffix + known, n)] + 1)
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[open_] = suffix
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[open_] = fresh
        rank[suffix] = open_[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        known *= 2
    return order, words


def common_prefixes(words: np.ndarray, before: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Kasai: bytes (at most `most`) a window shares with the one before it in order, -1 where there is none.

    `before` is that window's place. The segments' windows, `sizes` from `starts` on, are walked in
    step; a window shares at least one byte less than the one to its left did.
    """
    shared = np.full(len(words), -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    have = np.zeros(len(starts), np.int64)
    padded = np.concatenate([words, np.zeros(most + 8, np.uint64)])
    for step in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -step))  # segments with more windows than `step` come first
        here = starts[:n] + step
        other = before[here]
        if step:
            # the rule needs the neighbour's successor to be its successor's neighbourhood: a window too
            follows = (before[here - 1] >= 0) & (before[np.minimum(before[here - 1] + 1, len(before) - 1)] != -2)
            have = np.where(follows, np.maximum(have[:n] - 1, 0), 0)
        have = have[:n].copy()
        open_ = np.flatnonzero(other >= 0)
        have[other < 0] = 0
        while len(open_):
            differing = padded[here[open_] + have[open_]] ^ padded[other[open_] + have[open_]]
            equal = np.zeros(len(open_), np.int64)
            for i in range(8):
                equal += differing < np.uint64(1 << (56 - 8 * i)) if i < 7 else differing == 0
            have[open_] += equal
            open_ = open_[(equal == 8) & (have[open_] < most)]
        shared[here] = np.where(other >= 0, np.minimum(have, most), -1)
    return shared


def repeated_windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of distinct segments: segment, offset, whether it is repeated, and its class of equals."""
    sizes = np.array([len(p) - length + 1 for p in parts], np.int64)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    order, words = suffix_order(data)
    segment = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = starts[segment] + offset
    index = np.full(len(data), -1, np.int64)
    index[place] = np.arange(len(place))
    ordered = order[index[order] >= 0]
    before = np.full(len(data), -2, np.int64)  # -2: no window starts here
    before[ordered] = np.r_[-1, ordered[:-1]]
    shared = common_prefixes(words, before, starts, sizes, length)
    joins = shared[ordered] >= length
    alike = np.zeros(len(data), bool)
    alike[ordered[joins]] = True
    alike[before[ordered[joins]]] = True
    class_of = np.empty(len(data), np.int64)
    class_of[ordered] = np.cumsum(~joins) - 1
    return segment, offset, alike[place], class_of[place]


def _packed(offsets: np.ndarray) -> bytes:
    return np.asarray(offsets, "<i4").tobytes()


# the Spark steps


def texts_columns(id_: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(id_).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")]


def _texts(df: DataFrame, id_: str, text: str) -> DataFrame:
    return df.select(*texts_columns(id_, text))


def _found(texts: DataFrame, length: int) -> DataFrame:
    """gram, segment, id, n: the segments of every document, those repeated inside it once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, batch.num_rows, 512):
                some = [t.as_py().encode() for t in batch.column(1).slice(at, 512)]
                out: list[list] = [[], [], [], []]
                for i, grams, _, _, hashes in segments(some, length):
                    hashes, where, n = np.unique(np.array(hashes, np.uint64), return_index=True, return_counts=True)
                    out[0].append(grams[where])
                    out[1].append(hashes)
                    out[2].append(np.full(len(hashes), ids[at + i]))
                    out[3].append(n)
                if out[0]:
                    g, s, d, n = (np.concatenate(c) for c in out)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(g), _signed(s), pa.array(d), pa.array(n.astype(np.int32))], ["gram", "segment", "id", "n"]
                    )

    return texts.mapInArrow(found, "gram bigint, segment bigint, id bigint, n int")


def _squeezed(texts: DataFrame) -> DataFrame:
    """Texts packed before a shuffle; further columns go along."""
    fields = StructType().add("id", "long").add("packed", "binary")
    for field in texts.schema.fields[2:]:
        fields = fields.add(field.name, field.dataType)

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([pack(t.as_py().encode()) for t in batch.column(1)], pa.binary())
            names = ["id", "packed", *batch.schema.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, *batch.columns[2:]], names)

    return texts.mapInArrow(squeezed, fields)


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(p.as_py()) for p in column]


SHIPPED = "shard bigint, gram bigint, segment bigint, id bigint, n bigint, parts bigint, bytes binary"
REPEATS = "id bigint, segment bigint, offsets binary, slice bigint, shard bigint, hashes binary, open binary, ids binary, segments binary"
SHARD_BYTES = 1 << 20  # of segments, in a suffix array together


def _shipped(squeezed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of one copy of each wanted segment."""

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts, wants = _unpacked(rows.column("packed")), rows.column("wants").to_pylist()
                ids = rows.column("id").to_pylist()
                out = []
                for i, grams, first, last, hashes in segments(texts, length):
                    signed = np.array(hashes, np.uint64).view(np.int64).tolist()
                    at_of = {s: k for k, s in enumerate(signed)}
                    for want in wants[i]:
                        k = at_of.get(want["segment"])
                        if k is not None:
                            out.append(want | {"id": ids[i], "bytes": texts[i][int(first[k]):int(last[k]) + length]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=SHIPPED_ARROW)

    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("shard", "gram", "segment", "n", "parts")).alias("wants"))
    return squeezed.join(lists, "id").select("id", "packed", "wants").mapInArrow(shipped, SHIPPED)


SHIPPED_ARROW = pa.schema([
    ("shard", pa.int64()), ("gram", pa.int64()), ("segment", pa.int64()), ("id", pa.int64()), ("n", pa.int64()),
    ("parts", pa.int64()), ("bytes", pa.binary()),
])


def _sharded(shipped: DataFrame, length: int) -> DataFrame:
    """Repeated windows of segments seen once (offsets), and the windows of divided grams, packed by slice."""

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for table in whole_groups(batches, "shard", SHARD_BYTES, "bytes"):
            # an id that is not unique can ship a segment twice
            keep = np.unique(table.column("segment").to_numpy(), return_index=True)[1]
            rows = table.take(pa.array(np.sort(keep)))
            parts = rows.column("bytes").to_pylist()
            shard, gram, segment, id_, n, pieces = (rows.column(c).to_numpy() for c in ("shard", "gram", "segment", "id", "n", "parts"))
            of, offset, repeated, class_of = repeated_windows(parts, length)
            out = []
            marked = np.flatnonzero(repeated & (n[of] == 1))
            for at in np.split(marked, np.flatnonzero(np.diff(of[marked])) + 1) if len(marked) else []:
                k = of[at[0]]
                out.append({"id": id_[k], "segment": segment[k], "offsets": _packed(offset[at])})
            divided = np.flatnonzero(pieces[of] > 1)
            if len(divided):
                # a window whose suffix order has it several times is handed on once, and only answers others
                heads = divided[np.unique(class_of[divided] * len(rows) + _rank(shard)[of[divided]], return_index=True)[1]]
                out += _handed_on(parts, of[heads], offset[heads], repeated[heads], length, shard, gram, segment, id_, n, pieces)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=REPEATS_ARROW)

    dealt = shipped.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(sharded, REPEATS)


def _rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def _handed_on(parts, of, offset, repeated, length, shard, gram, segment, id_, n, pieces) -> Iterator[dict]:
    """One row per shard and slice: sorted hashes of windows, and whose windows they are.

    `open` holds, per window, the place of its segment in `segments` and its offset, both -1 where
    the window needs no answer.
    """
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join(
        digest(parts[k][o:o + length], g) for k, o, g in zip(of.tolist(), offset.tolist(), gram.view(np.uint64)[of].tolist(), strict=True)
    ), ">u8").reshape(-1, 2).astype(np.uint64)
    slices = (hashes[:, 0] % pieces[of].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((hashes[:, 1], hashes[:, 0], slices, shard[of]))
    new = np.flatnonzero((np.diff(shard[of][order]) != 0) | (np.diff(slices[order]) != 0)) + 1
    for at in np.split(order, new):
        k = of[at[0]]
        asks = ~repeated[at] & (n[of[at]] == 1)
        used, place = np.unique(of[at][asks], return_inverse=True)
        open_ = np.full((len(at), 2), -1, np.int32)
        open_[asks] = np.stack([place, offset[at][asks]], axis=1)
        name = xxhash.xxh3_64_intdigest(int(slices[at[0]]).to_bytes(8, "little"), int(np.uint64(gram.view(np.uint64)[k])))
        yield {
            "slice": int(np.uint64(name).view(np.int64)), "shard": shard[k], "hashes": hashes[at].tobytes(),
            "open": open_.tobytes(), "ids": id_[used].tobytes(), "segments": segment[used].tobytes(),
        }


REPEATS_ARROW = pa.schema([
    ("id", pa.int64()), ("segment", pa.int64()), ("offsets", pa.binary()), ("slice", pa.int64()), ("shard", pa.int64()),
    ("hashes", pa.binary()), ("open", pa.binary()), ("ids", pa.binary()), ("segments", pa.binary()),
])


def elsewhere(lists: list[np.ndarray]) -> list[np.ndarray]:
    """Of sorted lists of 128-bit hashes (rows of two words): whether another list has the hash too."""
    every = np.concatenate(lists)
    order = np.lexsort((every[:, 1], every[:, 0]))
    ordered = every[order]
    merged = np.cumsum(np.r_[False, (ordered[1:] != ordered[:-1]).any(axis=1)])
    number = np.empty(len(every), np.int64)
    number[order] = merged
    found, at = [], 0
    for one in lists:
        mine = number[at:at + len(one)]  # sorted, as the list is
        total = np.searchsorted(merged, mine, "right") - np.searchsorted(merged, mine, "left")
        found.append(total > np.searchsorted(mine, mine, "right") - np.searchsorted(mine, mine, "left"))
        at += len(one)
    return found


def _merged(windows: DataFrame) -> DataFrame:
    """id, segment, offsets of windows that another shard has too."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "slice", SHARD_BYTES, "hashes"):
            names = table.column("slice").to_numpy()
            for cut in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
                rows = table.slice(int(cut[0]), len(cut))
                lists = [np.frombuffer(h.as_py(), np.uint64).reshape(-1, 2) for h in rows.column("hashes")]
                out = []
                for hit, row in zip(elsewhere(lists), rows.select(["open", "ids", "segments"]).to_pylist(), strict=True):
                    open_ = np.frombuffer(row["open"], np.int32).reshape(-1, 2)
                    open_ = open_[hit & (open_[:, 0] >= 0)]
                    open_ = open_[np.argsort(open_[:, 0], kind="stable")]
                    ids, segments_ = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["segments"], np.int64)
                    for some in np.split(open_, np.flatnonzero(np.diff(open_[:, 0])) + 1) if len(open_) else []:
                        k = some[0, 0]
                        out.append({"id": ids[k], "segment": segments_[k], "offsets": _packed(some[:, 1])})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(REPEATS_ARROW)[:3]))

    dealt = windows.repartition("slice").sortWithinPartitions("slice", "shard")
    return dealt.mapInArrow(merged, "id bigint, segment bigint, offsets binary")


def whole_letters(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the letters that lie wholly inside a span."""
    out, at = [], 0
    for start, end in spans:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while start < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]]).decode()


def _removed(joined: DataFrame, length: int, rest: StructType | None) -> DataFrame:
    """With `rest` (the type of that column) the remaining letters beside it, else spans and remaining bytes."""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts, marks = _unpacked(rows.column("packed")), rows.column("marks").to_pylist()
                cover = [None] * len(texts)
                scanned = [t if m else b"" for t, m in zip(texts, marks, strict=True)]
                for i, _, first, last, hashes in segments(scanned, length):
                    own: dict[int, list] = {}
                    for mark in marks[i]:
                        own.setdefault(mark["segment"], []).append(mark["offsets"])
                    change = np.zeros(len(texts[i]) + 1, np.int32)
                    signed = np.array(hashes, np.uint64).view(np.int64).tolist()
                    for k, s in enumerate(signed):
                        for offsets in own.get(s, ()):
                            a = int(first[k])
                            if offsets is None:
                                change[a] += 1
                                change[int(last[k]) + length] -= 1
                            else:
                                starts = a + np.frombuffer(offsets, "<i4").astype(np.int64)
                                np.add.at(change, starts, 1)
                                np.add.at(change, starts + length, -1)
                    cover[i] = np.cumsum(change[:-1]) > 0
                spans = []
                for gone in cover:
                    edges = [] if gone is None else np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
                    spans.append(list(zip(edges[::2], edges[1::2], strict=True)))
                if rest is not None:
                    left = [whole_letters(t, s) for t, s in zip(texts, spans, strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.column("rest"), pa.array(left, pa.string())], ["rest", "text"])
                    continue
                kept = [np.frombuffer(t, np.uint8)[~g].tobytes() if s else t for t, g, s in zip(texts, cover, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS), pa.array(kept, pa.binary()),
                ], ["id", "n_bytes", "spans", "kept"])

    if rest is not None:
        schema = StructType().add("rest", rest).add("text", "string")
        return joined.select("id", "packed", "marks", "rest").mapInArrow(removed, schema)
    return joined.select("id", "packed", "marks").mapInArrow(
        removed, "id bigint, n_bytes bigint, spans array<struct<start bigint, end bigint>>, kept binary"
    )


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _marks(texts: DataFrame, length: int, shard_segments: int) -> DataFrame:
    """Per id, the segments with repeated windows and the windows' offsets (null: all)."""
    space = Workspace(texts.sparkSession, "suffixes")
    listed = space.keep(_found(texts, length), "segments")
    counted = space.keep(listed.groupBy("gram", "segment").agg(F.sum("n").alias("n"), F.min("id").alias("id")), "counted")
    grams = counted.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    known = space.keep(counted.join(grams.filter("total > 1"), "gram"), "known")
    space.drop("counted")
    wanted = known.filter("distinct > 1").withColumn("parts", F.ceil(F.col("distinct") / shard_segments).cast("long"))
    wanted = wanted.withColumn("shard", F.xxhash64("gram", F.pmod(F.col("segment"), F.col("parts"))))
    found = space.keep(_sharded(_shipped(_squeezed(texts), wanted, length), length), "repeats")
    across = _merged(found.filter("slice IS NOT NULL").select("slice", "shard", "hashes", "open", "ids", "segments"))
    once = found.filter("slice IS NULL").select("id", "segment", "offsets").unionByName(across)
    twice = known.filter("n > 1").select("gram", "segment")
    every = listed.join(twice, ["gram", "segment"]).select("id", "segment", F.lit(None).cast("binary").alias("offsets"))
    return every.unionByName(once).groupBy("id").agg(F.collect_list(F.struct("segment", "offsets")).alias("marks"))


def repeated_spans(
    df: DataFrame, id_: str = "doc_id", text: str = "text", length: int = 200, shard_segments: int = 1024
) -> DataFrame:
    """Per row: id, n_bytes, spans (start, end of the maximal removed runs, in bytes), kept (binary).

    A byte goes if a string of `length` bytes (at least 64) that covers it also starts anywhere else
    in the table. Null text counts as empty: no bytes and spans. Rows that repeat an id are texts of
    their own; so are rows without an id, whose id is null in the result. Identical rows remove each
    other. An empty table gives no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    texts = _texts(df, id_, text)
    result = _removed(_squeezed(texts).join(_marks(texts, length, shard_segments), "id", "left"), length, None)
    return result.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))


def drop_repeats(
    df: DataFrame, id_: str = "doc_id", text: str = "text", length: int = 200, shard_segments: int = 1024
) -> DataFrame:
    """All rows and columns of `df`, the text without repeated strings; a letter goes if all its bytes do.

    Cases are those of `repeated_spans`; a text that goes wholly becomes empty, a null one too.
    """
    kept = [c for c in df.columns if c != text]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("one")).alias("rest")
    texts = _texts(df, id_, text)
    packed = _squeezed(df.select(*texts_columns(id_, text), rest))
    joined = packed.join(_marks(texts, length, shard_segments), "id", "left")
    result = _removed(joined, length, packed.schema["rest"].dataType)
    return result.select(*[
        F.col("text").alias(c) if c == text else F.col("rest")[f"c{kept.index(c)}"].alias(c) for c in df.columns
    ])
