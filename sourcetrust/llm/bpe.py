"""Byte-pair encoding by segment trees, and decoding.

The ranks of a word's adjacent pairs are the leaves of a segment tree over (rank, place), so the
root is the leftmost pair of the lowest rank. Merging it changes three leaves: the pair itself,
the pair to its left, and the one whose first symbol is gone; each is a logarithmic point update.
Trees of many words of similar length are advanced together, one merge each per step, in numpy.

A Python worker remembers the ids of at most `KNOWN` chunks, so memory is bounded at any size.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from sourcetrust.llm.tables import Memory, worker_value

KNOWN = 1_000_000
NONE = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
PLACE = np.uint64(0xFFFF_FFFF)
# fixed values: split patterns of the vocabularies, with white space as Unicode defines it
WHITE = r"\p{White_Space}"
SPACED = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|{WHITE}+(?!\P{{White_Space}})|{WHITE}+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class PairEncoder:
    """Encoder and decoder of a `tokenizers` BPE file, without that library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.byte_ids = np.array([vocabulary[x] for x in letters], np.int64)
        self.last_ids = np.array([vocabulary[x + suffix] for x in letters], np.int64)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.uint64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        self.marks = tuple(s.encode() for s in self.special)
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        self.cased = not any(s["type"] == "Lowercase" for s in steps)
        self.composed = any(s["type"] == "NFC" for s in steps)
        splits = spec["pre_tokenizer"].get("pretokenizers", [])
        self.spaced = not splits
        pattern = SPACED if self.spaced else splits[0]["pattern"]["Regex"].replace(r"\s", WHITE)
        self.words = regex.compile(pattern)
        self.dtype = np.dtype("<u2" if self.size + len(self.special) <= 1 << 16 else "<u4")
        names = {i: s for s, i in vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.glue = b"" if spec["decoder"] else b" "
        self.bytes_of = {c: bytes([b]) for b, c in enumerate(letters)}
        self.known = Memory(KNOWN)

    # encoding

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids (`dtype`) of each text."""
        if self.spaced:  # a text is one chunk: its spaces belong to the words
            return [self._assembled([self._pieces(t)])[0] for t in texts]
        chunks = [t.encode().split() for t in texts]  # no token spans white space
        new = self.known.learn(set().union(*chunks), lambda some: self._assembled([self._pieces(c.decode()) for c in some]))
        out = [b"".join(map(self.known.__getitem__, c)) for c in chunks]
        self.known.forget_long(new)
        return out

    def _pieces(self, chunk: str) -> list[bytes | int]:
        """Words of a chunk in UTF-8, and ids of special strings."""
        if any(mark in chunk for mark in self.special):
            parts = self.split_special.split(chunk)
            return [x for p in parts for x in ([self.special[p]] if p in self.special else self._pieces(p) if p else [])]
        if self.composed and not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        if not self.cased:
            chunk = chunk.replace("Σ", "σ").lower()  # letter by letter, so no final sigma
        if chunk.isalpha():
            return [chunk.encode()]
        return [w.encode() for w in self.words.findall(chunk)]

    def _assembled(self, pieces: list[list[bytes | int]]) -> list[bytes]:
        words = list({w for p in pieces for w in p if isinstance(w, bytes)})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        return [
            b"".join(ids[w] if isinstance(w, bytes) else np.asarray([w], self.dtype).tobytes() for w in p)
            for p in pieces
        ]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words; words of similar length share a step."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        classes = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for width in np.unique(classes):
            members = np.flatnonzero(classes == width)
            step = max(1, (1 << 21) // int(width))  # bounds the memory of the trees
            for at in range(0, len(members), step):
                some = members[at:at + step]
                for i, ids in zip(some, self._merge([words[i] for i in some], int(width)), strict=True):
                    out[i] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaves of pairs: rank and place, or NONE where a pair does not merge (or a side is missing: -1)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, (self.ranks[at] << np.uint64(32)) | place.astype(np.uint64), NONE)

    def _merge(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        symbol = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no symbol"
        symbol[:, :width] = np.where(place < sizes[:, None], self.byte_ids[raw], -1)
        row = np.arange(n)
        filled = sizes > 0
        symbol[row[filled], sizes[filled] - 1] = self.last_ids[raw[row[filled], sizes[filled] - 1]]
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        tree = np.empty((n, 2 * width), np.uint64)
        tree[:, width:] = self._rank(symbol[:, :width], symbol[:, 1:], np.broadcast_to(place, (n, width)))
        for level in _levels(width):
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        tree[:, 0] = NONE

        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            left = (root & PLACE).astype(np.int64)
            right = after[live, left]
            symbol[live, left] = self.merged[(root >> np.uint64(32)).astype(np.int64)]
            symbol[live, right] = -1
            beyond = after[live, right]
            after[live, left] = beyond
            before[live, beyond] = left  # column `width` takes the writes of "no symbol"
            earlier = before[live, left]
            here = symbol[live, left]
            self._set(tree, live, right, np.full(len(live), NONE), width)
            self._set(tree, live, left, self._rank(here, symbol[live, beyond], left), width)
            has = earlier < width
            rows, first = live[has], earlier[has]
            self._set(tree, rows, first, self._rank(symbol[rows, first], here[has], first), width)
            live = live[tree[live, 1] != NONE]

        alive = symbol[:, :width] >= 0
        flat = symbol[:, :width][alive].astype(self.dtype).tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * self.dtype.itemsize
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[rows, node] = value
        while node.size and node[0] > 1:  # all leaves have the same depth
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    # decoding

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 text of ids; special strings are kept.

        A vocabulary without a decoder shows its pieces, joined by spaces; a byte-level one gives
        its bytes back, with U+FFFD for what is not UTF-8.
        """
        shown = self.glue.join(map(self.names.__getitem__, ids))
        if self.glue:
            return shown
        raw = b"".join(self.bytes_of.get(c, c.encode()) for c in shown.decode())
        return raw.decode("utf-8", "replace").encode()


def _levels(width: int) -> Iterable[int]:
    while width > 1:
        width //= 2
        yield width


def pair_encoder(path: str) -> PairEncoder:
    return worker_value(f"pairs {path}", lambda: PairEncoder(path))


def encode_texts(df: DataFrame, tokenizer: str, id_: str = "doc_id", text: str = "text", block: int = 256) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    Null text counts as empty and has no ids; rows that repeat an id or have none are encoded each.
    Texts are taken whole, `block` at a time. An empty table gives no rows.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pair_encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                ids = [np.frombuffer(x, pairs.dtype) for x in pairs.encode(some.column(1).to_pylist())]
                decoded = [pairs.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    some.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    pa.array([d.decode() for d in decoded], pa.string()),
                ], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = df.select(F.col(id_).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(encoded, "doc_id bigint, n_tokens bigint, ids binary, decoded string")

