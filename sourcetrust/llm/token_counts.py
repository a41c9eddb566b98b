"""Greedy word-piece counts in one pass over the bytes, without building pieces.

The pieces form a trie. A node whose string cannot be extended by the next byte pops the pieces
that longest matching takes from the front of its string and goes to the node of what is left;
both (the number popped and the failure link) are computed once per vocabulary. So a word costs
at most two steps per byte. Words advance together in numpy, one byte per step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sourcetrust.llm.bpe import byte_letters
from sourcetrust.llm.tables import Memory, worker_value

KNOWN = 1_000_000  # words remembered by one Python worker, at most


class MatchAutomaton:
    """Longest-match automaton over byte strings; every single byte must be a piece."""

    def __init__(self, pieces: list[bytes]):
        pieces = sorted(set(pieces) - {b""})
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][byte]
            final[node] = True
        if len(children[0]) < 256 or not all(final[c] for c in children[0].values()):
            raise ValueError("every single byte must be a piece")
        self.next = np.full((len(children), 256), -1, np.int32)
        self.link, self.popped = np.zeros(len(children), np.int32), np.zeros(len(children), np.int32)
        queue = [0]
        for node in queue:  # parents before children
            for byte, child in children[node].items():
                queue.append(child)
                self.next[node, byte] = child
                if final[child]:
                    self.popped[child] = 1  # the whole string is one piece, nothing is left
                    continue
                count, back = self.popped[node], self.link[node]
                while byte not in children[back]:
                    count, back = count + self.popped[back], self.link[back]
                self.popped[child], self.link[child] = count, children[back][byte]
        self.known = Memory(KNOWN)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each word."""
        out = np.zeros(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            longest = int(sizes[order[at]])
            some = order[at:at + max(1, (1 << 23) // max(1, longest))]  # bounds the memory of a step
            at += len(some)
            out[some] = self._walk([words[i] for i in some], sizes[some], longest)
        return out

    def _walk(self, words: list[bytes], sizes: np.ndarray, longest: int) -> np.ndarray:
        raw = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest)
        node, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for place in range(longest):
            n = int(np.searchsorted(-sizes, -place))  # words longer than `place`: they come first
            byte = raw[:n, place]
            target = self.next[node[:n], byte]
            stuck = np.flatnonzero(target < 0)
            while len(stuck):
                count[stuck] += self.popped[node[stuck]]
                node[stuck] = self.link[node[stuck]]
                target[stuck] = self.next[node[stuck], byte[stuck]]
                stuck = stuck[target[stuck] < 0]
            node[:n] = target
        left = np.flatnonzero(node > 0)
        while len(left):
            count[left] += self.popped[node[left]]
            node[left] = self.link[node[left]]
            left = left[node[left] > 0]
        return count

    def count_texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """Words and pieces of each text; a word is what white space parts, with a space before it."""
        split = [t.encode().split() for t in texts]
        new = self.known.learn(set().union(*split), lambda some: self.count([b" " + w for w in some]).tolist())
        out = [(len(s), sum(map(self.known.__getitem__, s))) for s in split]
        self.known.forget_long(new)
        return out


def vocabulary_pieces(path: str) -> list[bytes]:
    """Byte strings of a byte-level `tokenizers` file."""
    with open(path, encoding="utf-8") as file:
        pieces = json.load(file)["model"]["vocab"]
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    return [bytes(byte_of[c] for c in piece) for piece in pieces]


def count_tokens(df: DataFrame, tokenizer: str, id_: str = "doc_id", text: str = "text", block: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes, n_words, n_tokens.

    Words are parted by ASCII white space and matched with one space before them, greedily from
    the left, always the longest piece. Null text counts as empty: no words and tokens. Rows that
    repeat an id or have none are counted each. An empty table gives no rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = worker_value(f"match {tokenizer}", lambda: MatchAutomaton(vocabulary_pieces(tokenizer)))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                counts = automaton.count_texts(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1),
                    pa.array([w for w, _ in counts], pa.int64()), pa.array([t for _, t in counts], pa.int64()),
                ], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    shown = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_).cast("long").alias("_id"), F.octet_length(shown).cast("long").alias("_b"), shown.alias("_t"))
    return rows.mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_words bigint, n_tokens bigint")
