"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams, hashed into `BUCKETS` rows of
one table, and a text's vector the mean of its words'. A softmax over two classes reads it. Table
and softmax are trained together in numpy by Adam, in one task, on a bounded sample. Words never seen in
training share the n-grams of their relatives, so misspellings and inflections are scored too.

As everything before the softmax is linear, gradients need one number per n-gram and class, and a
trained model scores a text by adding up one number per word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from sourcetrust.llm.tables import Memory, fresh_worker, worker_value

BUCKETS = 1 << 18
DIM = 8
SIZES = (3, 4, 5, 6)
KNOWN = 400_000  # chunks, and words, remembered by one Python worker, at most
PLAIN, NO_WORD = 0, None  # a word without a trained n-gram, a chunk without a word
HELD_OUT = 1  # remainder of crc32(id) modulo 3


def word_of(chunk: str) -> str:
    """Lower-case word without the signs around it; empty if nothing is left."""
    low, first, last = chunk.lower(), 0, len(chunk.lower())
    while first < last and not low[first].isalnum():
        first += 1
    while last > first and not low[last - 1].isalnum():
        last -= 1
    return low[first:last]


def buckets_of(word: str) -> list[int]:
    """Rows of a word's n-grams, its ends marked, and of the word itself."""
    shown = f"<{word}>"
    if shown.isascii():
        raw, size = shown.encode(), len(shown)
        grams = [raw[i:i + n] for n in SIZES for i in range(size - n + 1)]
        grams.append(raw)
    else:
        pieces = [shown[i:i + n] for n in SIZES for i in range(len(shown) - n + 1)]
        grams = [g.encode("utf-8", "replace") for g in (*pieces, shown)]
    return [zlib.crc32(g) % BUCKETS for g in grams]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their weights, which add up to one (nothing for a text without words)."""
    words = Counter()
    for chunk, n in Counter(text.split()).items():
        word = word_of(chunk)
        if word:
            words[word] += n
    total = sum(words.values())
    rows, weights = [], []
    for word, n in words.items():
        own = buckets_of(word)
        rows += own
        weights += [n / total / len(own)] * len(own)
    rows, where = np.unique(np.array(rows, np.int64), return_inverse=True)
    return rows.astype(np.int32), np.bincount(where, weights, len(rows)).astype(np.float32)


@dataclass
class Model:
    """One logit per bucket and class, and the biases."""

    logits: np.ndarray
    bias: np.ndarray

    def score(self, logit: np.ndarray) -> float:
        """Probability of class 1 from a text's mean logits."""
        a, b = logit + self.bias
        return float(1 / (1 + np.exp(np.clip(a - b, -60, 60))))


def fit(
    rows: np.ndarray, weights: np.ndarray, counts: np.ndarray, labels: np.ndarray,
    epochs: int = 150, rate: float = 0.1, decay: float = 1e-4, min_texts: int = 5, least_z: float = 5.0, toxic_weight: float = 0.4, seed: int = 3,
) -> Model:
    """Train table, softmax and biases together on texts of `counts` buckets each.

    Only buckets are trained that at least `min_texts` texts have and whose share of texts differs
    between the classes by `least_z` standard errors; the others' vectors stay zero. The toxic texts together weigh
    `toxic_weight`. With one class or no rows, the score is that class's share everywhere.
    """
    share = labels.mean() if len(labels) else 0.5
    if share in (0, 1) or not len(labels):
        return Model(np.zeros((BUCKETS, 2), np.float32), np.array([0.0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    toxic = np.repeat(labels == 1, counts)
    high, low = (np.bincount(rows[toxic == c], minlength=BUCKETS) for c in (True, False))
    n_high, n_low = (labels == 1).sum(), (labels == 0).sum()
    pooled = (high + low + 1) / (n_high + n_low + 2)
    z = (high / n_high - low / n_low) / np.sqrt(pooled * (1 - pooled) * (1 / n_high + 1 / n_low))
    used = np.flatnonzero((high + low >= min_texts) & (np.abs(z) >= least_z))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    common = place[rows] >= 0
    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[common], minlength=len(counts))
    rows, weights = place[rows[common]], weights[common]
    ends = np.cumsum(counts)
    blocks = [(i, min(i + 256, len(counts))) for i in range(0, len(counts), 256)]
    blocks = [(i, j, slice(int(ends[i] - counts[i]), int(ends[j - 1]))) for i, j in blocks]

    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, toxic_weight / share, (1 - toxic_weight) / (1 - share)) / len(labels)
    target = np.stack([1 - labels, labels], axis=1).astype(np.float64)
    way = rng.normal(0, DIM**-0.5, DIM)
    # a table that starts near zero leaves n-grams without evidence without a say
    values = {"table": rng.normal(0, 1e-4, (len(used), DIM)), "softmax": np.stack([-way, way]), "bias": np.zeros(2)}
    first = {k: np.zeros_like(v) for k, v in values.items()}
    second = {k: np.zeros_like(v) for k, v in values.items()}
    spread = 50.0  # marked words are a few in a hundred: a mean needs this scale to reach sure scores
    for step in range(1, epochs + 1):
        table, softmax = values["table"], values["softmax"]
        per_row, back, bias = table @ softmax.T * spread, np.zeros((len(used), 2)), np.zeros(2)
        for i, j, span in blocks:  # a block bounds the temporary arrays; the step is over all rows
            of, own, mass = np.repeat(np.arange(j - i), counts[i:j]), rows[span], weights[span].astype(np.float64)
            logits = np.stack([np.bincount(of, mass * per_row[own, c], j - i) for c in (0, 1)], axis=1) + values["bias"]
            shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (shifted / shifted.sum(axis=1, keepdims=True) - target[i:j]) * weight[i:j, None]
            bias += error.sum(axis=0)
            # the classes' errors are each other's opposite
            part = np.bincount(own, mass * error[of, 1], len(used))
            back += np.stack([-part, part], axis=1)
        back *= spread
        gradient = {"table": back @ softmax + decay * table, "softmax": back.T @ table, "bias": bias}
        for k, g in gradient.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            mean, square = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
            values[k] = values[k] - rate * mean / (np.sqrt(square) + 1e-8)
    logits = np.zeros((BUCKETS, 2), np.float32)
    logits[used] = values["table"] @ values["softmax"].T * spread
    return Model(logits, values["bias"])


def held_out(id_):
    return F.crc32(id_.cast("string").cast("binary")) % 3 == HELD_OUT


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker()
    for batch in batches:
        made = [bag(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([r.tobytes() for r, _ in made], pa.binary()), pa.array([w.tobytes() for _, w in made], pa.binary()),
        ], ["id", "y", "rows", "weights"])


def train(
    df: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "toxic",
    fit_toxic: int = 2000, fit_clean: int = 4000,
) -> Model:
    """Fit on at most `fit_toxic` and `fit_clean` labelled rows, the first of each by a hash of the id.

    Rows whose crc32 of the id leaves 1 modulo 3 are never used, nor rows without an id, text or
    0/1 label. Of an id labelled twice the larger label counts. Whole texts are read. The fit is one
    task; its size is bounded by the two parameters.
    """
    chosen = labels.select(F.col(id_).alias("_id"), F.col(label).cast("int").alias("_y")).filter(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))
    ).groupBy("_id").agg(F.max("_y").alias("_y"))
    parts = [
        chosen.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((0, fit_clean), (1, fit_toxic))
    ]
    sample = parts[0].unionByName(parts[1])  # bounded: fit_toxic + fit_clean ids and labels

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        rows, weights, counts, y = [np.empty(0, np.int32)], [np.empty(0, np.float32)], [], []
        for batch in batches:
            y += batch.column(1).to_pylist()
            for r, w in zip(batch.column(2), batch.column(3), strict=True):
                rows.append(np.frombuffer(r.as_py(), np.int32))
                weights.append(np.frombuffer(w.as_py(), np.float32))
                counts.append(len(rows[-1]))
        sizes, rows, weights = np.array(counts, np.int64), np.concatenate(rows), np.concatenate(weights)
        model = fit(rows, weights, sizes, np.array(y, np.int64))
        yield pa.RecordBatch.from_arrays([
            pa.array([model.logits.tobytes()], pa.binary()), pa.array([model.bias.tobytes()], pa.binary()),
        ], ["logits", "bias"])

    texts = df.select(F.col(id_).alias("_id"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    taken = texts.join(F.broadcast(sample), "_id").select(F.col("_id").cast("string"), "_y", "_text")
    bagged = taken.mapInArrow(_bags, "id string, y int, rows binary, weights binary")
    model = bagged.repartition(1).sortWithinPartitions("id", "y").mapInArrow(fitted, "logits binary, bias binary").first()
    if model is None:  # no labelled row: no task has run
        return fit(np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int64), np.empty(0, np.int64))
    return Model(np.frombuffer(model["logits"], np.float32).reshape(BUCKETS, 2), np.frombuffer(model["bias"], np.float64))


def score_texts(df: DataFrame, model: Model, id_: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of `df` plus `out`, the probability that the text is toxic.

    Only the text is read. Null, empty and wordless texts get the score of the bias alone. A column
    named `out` is replaced. An empty table gives no rows.
    """
    at = np.flatnonzero(model.logits.any(axis=1))
    trained = dict(zip(at.tolist(), map(tuple, model.logits[at].astype(float).tolist()), strict=True))
    bias, version = model.bias, zlib.crc32(model.logits.tobytes())
    kept = [c for c in df.columns if c != out]
    # the text travels once: inside the row, or beside it where `out` replaces it
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    place = kept.index(text) if text in kept else None
    rows = df.select(row) if place is not None else df.select(row, F.col(text).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weigh(word: str):
            rows = buckets_of(word)
            hits = [trained[r] for r in rows if r in trained]
            return (sum(a for a, _ in hits) / len(rows), sum(b for _, b in hits) / len(rows)) if hits else PLAIN

        def look_up(chunk: str):
            word = word_of(chunk)
            return words[word] if word else NO_WORD

        # chunks of all tasks of a worker; another model starts anew
        held = worker_value("toxicity", dict)
        if held.get("version") != version:
            held |= {"version": version, "chunks": Memory(KNOWN), "words": Memory(KNOWN)}
        words, chunks, scorer = held["words"], held["chunks"], Model(np.empty(0), bias)
        words.make, chunks.make = weigh, look_up
        for batch in batches:
            values = []
            for text_ in batch.column(1) if place is None else batch.column(0).field(place):
                found = list(map(chunks.__getitem__, (text_.as_py() or "").split()))
                marked = [f for f in found if f]
                n = max(1, len(found) - found.count(NO_WORD))
                sums = np.array([sum(f[0] for f in marked), sum(f[1] for f in marked)])
                values.append(scorer.score(sums / n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["row", "score"])

    found = rows.mapInArrow(scored, StructType().add("row", rows.schema["row"].dataType).add("score", "double"))
    return found.select(*[F.col("row")[c].alias(c) for c in kept], F.col("score").alias(out))
