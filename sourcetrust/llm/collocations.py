"""Phrase collocations by SON partitioning, level by level of phrase length.

A shard is a bounded piece of one language's texts, kept as word numbers. For every length:

1. Each shard is mined completely: all its phrases of that length whose two shorter ends are
   frequent, counted in numpy. It reports those that reach its local support, which is the global one
   in proportion to its words. A phrase that is frequent at all reaches it in some shard.
2. The reported phrases of all shards are united. A shard whose local support is one reports all it
   has; others hand on the rest of their counts unreported, so that the union's counts are exact.
3. Phrases that no shard reports, or below the global support, go. The others are numbered, and every
   shard learns the numbers of its own ones for the next length.

Phrases are pairs (number of the frequent phrase without the last word, number of the last word), so
no two can be taken for each other. They travel packed: per shard one sorted list for each slice of
their hash. A slice's lists are merged by one task, which sends back to each shard the numbers of the
phrases that stay, by their places in the list. No phrase has more entries than there are shards, and
the number of slices follows the number of words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sourcetrust.llm.tables import Workspace, numbered, whole_groups

# fixed values: signs that end a piece, blanks between words, the name of no language
BREAKS, BLANKS, NO_LANG = b".,;:!?\n\x0b\x0c\r", b" \t", "und"

_plain = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")
_kind = np.zeros(256, np.int8)  # of a byte of such a text: 0 word, 1 blank, 2 break
_kind[ord(" ")], _kind[ord("\n")] = 1, 2

SLICE_WORDS = 1 << 20  # words of the corpus for each slice that phrases are merged in

SHARDS = "shard bigint, lang string, n bigint, words array<struct<word: string, n: bigint>>, ids binary, joined binary"


def cut_long(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of a text of about `size` bytes, cut at piece ends; a longer piece stays whole."""
    at = 0
    while len(text) - at > size:
        end = text.find(b"\n", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def read_words(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words, and of each whether the next one follows it in the same piece."""
    words = text.split()
    kinds = _kind[np.frombuffer(text, np.uint8)]
    starts = np.flatnonzero((kinds == 0) & (np.r_[np.int8(1), kinds[:-1]] != 0))
    piece = np.cumsum(kinds == 2, dtype=np.int32)[starts]
    return words, np.r_[piece[1:] == piece[:-1], np.zeros(min(1, len(words)), bool)]


def _sharded(size: int):
    def row(shard: int, lang: str, parts: list[bytes]) -> dict:
        words, joined = read_words(b"\n".join(parts))
        number: dict = defaultdict()
        number.default_factory = number.__len__
        ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        counts = np.bincount(ids, minlength=len(number)).tolist()
        pack = zstandard.ZstdCompressor(level=1).compress
        return {
            "shard": shard, "lang": lang, "n": len(words), "ids": pack(ids.tobytes()), "joined": pack(np.packbits(joined).tobytes()),
            "words": [{"word": w.decode(), "n": c} for w, c in zip(number, counts, strict=True)],
        }

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, sizes = TaskContext.get().partitionId() << 32, defaultdict(list), defaultdict(int)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in cut_long(text.as_py().encode().lower().translate(_plain), size):
                    held[lang].append(part)
                    sizes[lang] += len(part)
                    if sizes[lang] >= size:
                        yield pa.RecordBatch.from_pylist([row(shard, lang, held.pop(lang))], SHARDS_ARROW)
                        shard, sizes[lang] = shard + 1, 0
            # what is open is bounded for all languages together
            while sum(sizes.values()) > 4 * size:
                lang = max(sizes, key=sizes.get)
                yield pa.RecordBatch.from_pylist([row(shard, lang, held.pop(lang))], SHARDS_ARROW)
                shard, sizes[lang] = shard + 1, 0
        for lang in list(held):
            yield pa.RecordBatch.from_pylist([row(shard, lang, held.pop(lang))], SHARDS_ARROW)
            shard += 1

    return sharded


SHARDS_ARROW = pa.schema([
    ("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()),
    ("words", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))), ("ids", pa.binary()), ("joined", pa.binary()),
])


# the phrases of one shard


def _longer(prefix: np.ndarray, ids: np.ndarray, joined: np.ndarray, length: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of phrases of `length` words whose shorter ends are frequent (`prefix` >= 0 there), and their keys."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # both ends lie in one piece and overlap, or are single words that must follow each other
    fits = (prefix[:n] >= 0) & (prefix[1:n + 1] >= 0)
    if length == 2:
        fits &= joined[:n]
    at = np.flatnonzero(fits)
    return at, prefix[at] * words + ids[at + length - 1]


def shard_phrases(
    ids: np.ndarray, joined: np.ndarray, words: int, known: list[tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the phrases one word longer than the known levels: local key, prefix and word number, count.

    `known` has for every shorter length the sorted local keys of the shard's frequent phrases, and
    their numbers. A local key is (place of the prefix in its level) * words + local word.
    """
    prefix = np.full(len(ids), -1, np.int64)
    for length, (keys, _) in enumerate(known, 1):
        if length == 1:
            at, found = np.arange(len(ids)), ids.astype(np.int64)
        else:
            at, found = _longer(prefix, ids, joined, length, words)
        place = np.searchsorted(keys, found)
        hit = place < len(keys)
        hit[hit] = keys[place[hit]] == found[hit]
        prefix = np.full(len(ids), -1, np.int64)
        prefix[at[hit]] = place[hit]
    _, found = _longer(prefix, ids, joined, len(known) + 1, words)
    keys, counts = np.unique(found, return_counts=True)
    single, numbers = known[0]
    return keys, known[-1][1][keys // words], numbers[np.searchsorted(single, keys % words)], counts


def in_slices(p: np.ndarray, w: np.ndarray, slices: int) -> Iterator[tuple[int, np.ndarray]]:
    """The slices that phrases fall into, and which fall there, in the order they travel in."""
    mixed = (p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    of = ((mixed >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
    order = np.lexsort((w, p, of))
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
        yield int(of[part[0]]), part


def _packed(p: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs and their counts; the first numbers as steps, as they repeat or grow."""
    return zstandard.ZstdCompressor(level=1).compress(np.stack([np.diff(p, prepend=0), w, n]).astype(np.int64).tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    p, w, n = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64).reshape(3, -1)
    return np.stack([np.cumsum(p), w, n])


def _level(row: dict, level: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's phrases of `level` words: prefix and word number, count."""
    unpack = zstandard.ZstdDecompressor().decompress
    ids = np.frombuffer(unpack(row["ids"].as_py()), np.int32)
    joined = np.unpackbits(np.frombuffer(unpack(row["joined"].as_py()), np.uint8), count=len(ids)).astype(bool)
    words, known = int(ids.max()) + 1, []
    for k in range(1, level):
        learned = row[f"known{k}"].values
        if k == 1:
            at, numbers = (np.asarray(learned.field(j), np.int64) for j in (0, 1))
            order = np.argsort(at)
            known.append((at[order], numbers[order]))
            continue
        keys, p, w, _ = shard_phrases(ids, joined, words, known)
        sent = {s: np.frombuffer(f, np.int32).reshape(2, -1) for s, f in zip(learned.field(0).to_pylist(), learned.field(1).to_pylist(), strict=True)}
        numbers = np.full(len(keys), -1, np.int64)
        for part, members in in_slices(p, w, slices):
            if part in sent:
                place, rank = sent[part]
                numbers[members[place]] = (part << 32) | rank.astype(np.int64)
        stay = numbers >= 0
        known.append((keys[stay], numbers[stay]))
    return shard_phrases(ids, joined, words, known)[1:]


MINED = "slice bigint, shard bigint, own bigint, total bigint, packed binary"


def _mined(shards: DataFrame, level: int, slices: int) -> DataFrame:
    """Each shard's phrases of `level` words, one packed list per slice."""

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                p, w, n = _level(row, level, slices)
                own = {"shard": row["shard"].as_py(), "own": row["n"].as_py(), "total": row["total"].as_py()}
                out = [own | {"slice": part, "packed": _packed(p[at], w[at], n[at])} for part, at in in_slices(p, w, slices)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, MINED_ARROW)

    wanted = ["shard", "n", "total", "ids", "joined", *[f"known{k}" for k in range(1, level)]]
    return shards.select(*wanted).mapInArrow(mined, MINED)


MINED_ARROW = pa.schema([(c, pa.int64()) for c in ("slice", "shard", "own", "total")] + [("packed", pa.binary())])
MERGED = "slice bigint, shard bigint, p array<bigint>, w array<bigint>, f array<bigint>, found binary"
MERGED_ARROW = pa.schema([
    ("slice", pa.int64()), ("shard", pa.int64()), *[(c, pa.list_(pa.int64())) for c in "pwf"], ("found", pa.binary())
])


def merged_slice(lists: list[np.ndarray], owns: list[int], totals: list[int], support: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The frequent phrases of a slice (p, w, f), and per list which of its entries they are and which phrase each is.

    A phrase is a candidate if one of the lists reports it: its count there, in proportion to the
    shard's words, reaches the support. Candidates have the counts of all lists.
    """
    p, w, n = np.concatenate(lists, axis=1)
    sizes = [one.shape[1] for one in lists]
    own, total = np.repeat(owns, sizes), np.repeat(totals, sizes)
    order = np.lexsort((w, p))
    new = np.r_[True, (np.diff(p[order]) != 0) | (np.diff(w[order]) != 0)]
    starts = np.flatnonzero(new)
    f = np.add.reduceat(n[order], starts)
    reported = np.logical_or.reduceat((n * total >= support * own)[order], starts)
    stays = reported & (f >= support)
    rank = np.where(stays, np.cumsum(stays) - 1, -1)
    entry = np.empty(len(p), np.int64)
    entry[order] = rank[np.cumsum(new) - 1]
    heads = order[starts[stays]]
    found = []
    for one in np.split(entry, np.cumsum(sizes)[:-1]):
        place = np.flatnonzero(one >= 0)
        found.append(np.stack([place, one[place]]).astype(np.int32))
    return np.stack([p[heads], w[heads], f[stays]]), found


def _merged(mined: DataFrame, support: int) -> DataFrame:
    """Per slice one row of frequent phrases (no shard), and what each shard learns of them (found)."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "slice", 1 << 20, "packed"):
            names = table.column("slice").to_numpy()
            for cut in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
                rows = table.slice(int(cut[0]), len(cut)).to_pydict()
                phrases, found = merged_slice([_unpacked(x) for x in rows["packed"]], rows["own"], rows["total"], support)
                if not phrases.shape[1]:
                    continue
                part = rows["slice"][0]
                out = [{"slice": part} | dict(zip("pwf", phrases, strict=True))]
                out += [{"slice": part, "shard": s, "found": f.tobytes()} for s, f in zip(rows["shard"], found, strict=True) if f.size]
                yield pa.RecordBatch.from_pylist(out, MERGED_ARROW)

    return mined.repartition("slice").sortWithinPartitions("slice").mapInArrow(merged, MERGED)


def exact_counts(mined: DataFrame, key: list[str], support: int) -> DataFrame:
    """key, f of the phrases that a shard reports and that reach the support, from all shards' counts."""
    counted = mined.groupBy(*key).agg(F.sum("n").alias("f"), F.max("reported").alias("reported"))
    return counted.filter(F.col("reported") & (F.col("f") >= support)).drop("reported")


def frequent_phrases(
    df: DataFrame, space: Workspace, lang: str, text: str, support: int, max_words: int, shard_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """lang, words, phrase, f of all phrases that reach the support; lang, n (all words)."""
    rows = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    shards = space.keep(rows.mapInArrow(_sharded(shard_bytes), SHARDS), "shards")
    totals = space.keep(shards.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    slices = max(1, -(-(totals.agg(F.sum("total")).first()[0] or 0) // SLICE_WORDS))
    known = shards.filter("n > 0").select("shard", "lang", "n", "ids", "joined").join(totals, "lang")

    single = shards.select("shard", "lang", F.col("n").alias("own"), F.posexplode("words").alias("at", "w")).select(
        "shard", "lang", "own", F.col("at").cast("long").alias("at"), F.col("w.word").alias("word"), F.col("w.n").alias("n")
    )
    local = single.join(totals, "lang").withColumn("reported", F.col("n") * F.col("total") >= F.col("own") * support)
    counts = exact_counts(local, ["lang", "word"], support)
    words = numbered(counts, [F.col("lang"), F.col("word")], space, "words").withColumnRenamed("_pos", "id")
    words = space.keep(words, "level-1")
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), "f")]
    # a shard learns at most as many numbers as it has words
    learned = single.join(words, ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("known1"))
    for level in range(2, max_words + 1):
        known = known.join(learned, "shard")
        met = space.keep(_merged(_mined(known, level, slices), support), f"merged-{level}")
        one = met.filter("shard IS NULL").select("slice", F.posexplode(F.arrays_zip("p", "w", "f")).alias("rank", "e"))
        counts = one.select((F.shiftleft("slice", 32) + F.col("rank")).alias("id"), "e.p", "e.w", "e.f")
        before = levels[-1].select(F.col("id").alias("p"), "lang", F.col("phrase").alias("prefix"))
        last = words.select(F.col("id").alias("w"), "word")
        named = counts.join(before, "p").join(last, "w").select("id", "lang", F.concat_ws(" ", "prefix", "word").alias("phrase"), "f")
        levels.append(space.keep(named, f"level-{level}"))
        learned = met.filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("slice", "found")).alias(f"known{level}"))
    found = [t.select("lang", F.lit(k).alias("words"), "phrase", "f") for k, t in enumerate(levels, 1)]
    return reduce(DataFrame.unionByName, found), totals.select("lang", F.col("total").alias("n"))


def _part(phrase: Column, first: Column, words: Column) -> Column:
    """Of a phrase's words those from `first` (from 1) on."""
    return F.array_join(F.slice(F.split(phrase, " "), first, words), " ")


def _best(rows: DataFrame, by: str, order: list[Column], top: int) -> DataFrame:
    """Rows with `rank` up to `top` per group: first within slices of a group, then among those left."""
    sliced = W.partitionBy(by, F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(sliced)).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine_collocations(
    df: DataFrame, lang: str = "lang", text: str = "text", support: int = 10, max_words: int = 3, top: int = 2000,
    covered: int = 50, shard_bytes: int = 8 << 20,
) -> DataFrame:
    """Per language the `top` phrases of 2 to `max_words` words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut to pieces at `.,;:!?` and line ends, and to words at blanks. n
    counts the language's words, a the phrase, l and r its parts at the cut with the lowest score
    floor(1000000 a a / (l r)), the first on ties. Phrases below `support` are none; nor are those
    inside a longer one that has at least `covered` of 100 of their occurrences. Order: score, a, both
    falling, then the phrase's bytes. Null text counts as empty, null lang as `und`; repeated rows
    count each, other columns are not read. A text longer than a shard is cut at piece ends; a single
    piece is held whole. A language without such phrases, or an empty table, gives no rows.
    """
    space = Workspace(df.sparkSession, "collocations")
    counts, totals = frequent_phrases(df, space, lang, text, support, max_words, shard_bytes)
    phrases = counts.filter("words > 1")

    inner = phrases.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    longest = inner.select("lang", _part(F.col("phrase"), F.col("first"), F.col("size")).alias("phrase"), "f")
    longest = longest.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    open_ = phrases.join(longest, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f"))
    )

    cut = open_.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cut.select("lang", "phrase", "a", "k", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), _part(F.col("phrase"), F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("part")),
    )))
    known = counts.select("lang", F.col("phrase").alias("part"), "f")
    both = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = both.withColumns({"_up": wide("a") * wide("a") * F.lit(1000000), "_down": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("_up div _down"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    flat = lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    ranked = _best(flat, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
