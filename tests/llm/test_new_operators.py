"""Collocations, fill-in-middle and fingerprints against brute force and hand cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sourcetrust.llm import collocations, fill_middle, fingerprints
from sourcetrust.llm.tables import Workspace

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = "doc_id long, text string, lang string"


# collocations


def plain_collocations(rows, support=10, longest=3, top=2000, covered=50):
    counts, out = defaultdict(Counter), []
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                counts[lang or "und"].update(" ".join(words[i:i + size]) for i in range(len(words) - size + 1))
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if " " not in p)
        frequent = {p: c for p, c in f.items() if " " in p and c >= support}
        hidden = set()
        for p, c in frequent.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    part = " ".join(w[i:i + size])
                    if 100 * c >= covered * f[part]:
                        hidden.add(part)
        scored = []
        for p in frequent.keys() - hidden:
            w = p.split(" ")
            cuts = [(f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, k = min((1000000 * f[p] ** 2 // (left * right), k) for k, (left, right) in enumerate(cuts))
            scored.append((-score, -f[p], p.encode(), *cuts[k]))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(scored[:top])]
    return sorted(out)


def corpus(rnd, n, common=40):
    vocabulary = ["".join(rnd.choice("abéz") for _ in range(rnd.randint(1, 3))) for _ in range(common)]
    phrases = [" ".join(rnd.choices(vocabulary, k=rnd.randint(2, 5))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(phrases) if rnd.random() < 0.4 else rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        text = "".join(p + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! ", " \x0b"]) for p in parts)
        rows.append((i, text.upper() if rnd.random() < 0.2 else text, rnd.choice(["en", "en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("size,parts", [(8 << 20, 1), (2000, 3), (300, 5), (40, 2)])
def test_collocations_against_counting(spark, size, parts):
    """From a few shards, which hold much back, to many small ones, which report everything."""
    rows = corpus(random.Random(size), 400)
    table = spark.createDataFrame(rows, TEXTS).repartition(parts)
    found = collocations.mine_collocations(table, shard_bytes=size)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain_collocations(rows)
    assert len(expected) > 100 and sorted(map(tuple, found.collect())) == expected


def test_collocations_of_four_words_and_few_ranks(spark):
    rows = corpus(random.Random(7), 300, common=12)
    table = spark.createDataFrame(rows, TEXTS).repartition(3)
    found = collocations.mine_collocations(table, support=6, max_words=4, top=15, covered=80, shard_bytes=1500)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, 6, 4, 15, 80)


def test_collocations_hold_back_and_count_exactly(spark):
    """Counts below a shard's local support are added to those that other shards report."""
    rows = [("a", 8, True), ("b", 9, True), ("a", 1, False), ("a", 1, False), ("c", 6, False), ("c", 6, False)]
    mined = spark.createDataFrame(rows, "key string, n long, reported boolean")
    assert [tuple(r) for r in collocations.exact_counts(mined, ["key"], 10).collect()] == [("a", 10)]


def test_collocations_odd_inputs(spark):
    made = collocations.mine_collocations
    assert made(spark.createDataFrame([], TEXTS)).count() == 0
    assert made(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " \t.,", "en")], TEXTS)).count() == 0
    long_ = "so it is. " * 5000 + "x" * 100_000
    rows = [(1, long_, "en"), (1, long_, "en"), (None, "und so", "und"), (2, "und so " * 10, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], TEXTS + ", shard string, total int")
    found = made(table, shard_bytes=1000)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows)
    assert made(table.withColumn("at", F.lit(1)), shard_bytes=1 << 20).count() == found.count()


def test_long_texts_are_cut_at_piece_ends():
    text = b"a b\nc d\n" * 50 + b"e" * 100 + b"\nf"
    parts = list(collocations.cut_long(text, 32))
    assert b"".join(parts) == text and len(parts) > 10
    assert all(p.startswith(b"\n") for p in parts[1:])
    assert list(collocations.cut_long(b"", 32)) == [b""]


# fill-in-middle


def plain_fill(id_, text, seed=42):
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    if h4 % 100 < 80:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def odd_texts(rnd):
    signs = ["a", "é", "漢", "😀", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\xa0", " ", "\x00", "<", "P", ">", "\x08", "\x0e", "!"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 60))) for _ in range(600)]
    return [*texts, None, "", " ", "\n\n", "a", " a", "a ", "a<P>b", "<<S>", "<P", "x" * 16, "x" * 8 + " " + "y" * 7, " " * 64]


@pytest.mark.parametrize("block,size", [(1 << 17, 4 << 20), (1, 1), (3, 200)])
def test_fill_middle_against_regex(spark, monkeypatch, block, size):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    texts = odd_texts(random.Random(block))
    ids = list(range(len(texts)))
    ids[3] = -5
    for at in range(0, len(texts), max(1, size >> 4)):
        some, of = [t or "" for t in texts[at:at + max(1, size >> 4)]], ids[at:at + max(1, size >> 4)]
        assert fill_middle.transform(some, of, 50, 80, 42) == [plain_fill(i, t) for i, t in zip(of, some)]


def test_fill_middle_round_trip(spark):
    texts = odd_texts(random.Random(1))
    long_ = "wörd \n" * 300_000
    rows = [*enumerate(texts), (1, texts[2]), (None, "a b c"), *((10_000 + i, long_) for i in range(4))]
    table = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, fim int, `row` string").repartition(3)
    made = fill_middle.fill_in_middle(table)
    assert made.columns == ["doc_id", "text", "row", "fim"]
    got = made.select("doc_id", "text", "fim.*", fill_middle.restored(F.col("fim.output"), F.col("fim.form")).alias("again")).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain_fill(r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert fill_middle.fill_in_middle(table.limit(0)).count() == 0


def test_select_in_words():
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"ab  \n", np.uint8), 8 * 500)
    ends = fill_middle.unit_ends(data, np.array([len(data) - 1]))
    upto = np.cumsum(np.bitwise_count(ends), dtype=np.int64)
    blank = np.isin(data, np.frombuffer(b" \n", np.uint8))
    expected = np.flatnonzero(np.r_[~blank[:-1] & blank[1:], True]) + 1
    assert fill_middle.select(ends, upto, np.arange(1, len(expected) + 1)).tolist() == expected.tolist()


# fingerprints


def paragraphs(text):
    return {line.strip(" ") for line in re.split("[\n\r]+", text or "")} - {""}


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_sets(spark):
    rnd = random.Random(9)
    line = lambda: "".join(rnd.choice("abcé \r") for _ in range(rnd.randint(0, 12)))
    rows = [(i, "\n".join(line() for _ in range(rnd.choice([0, 1, 3, 10, 60])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, rows[5][1]), (104, "\n".join(map(str, range(3000))))]
    rows += [(105, "\n".join(map(str, range(1500, 4500)))), (106, "one line without an end " * 2000)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, own int").repartition(4)
    got = {r.id: r for r in fingerprints.fingerprint_edits(table).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (id_, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[id_]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == jaccard(text, edited) and r.near_next == jaccard(text, after)
        assert len(r.gone) == len(paragraphs(text) - paragraphs(edited)) and len(r.added) == len(paragraphs(edited) - paragraphs(text))
        assert r.gone == sorted(r.gone, key=r.gone.index) and not set(r.gone) & set(r.added)
    assert got[102].fingerprint == got[103].fingerprint == got[5].fingerprint and got[100].fingerprint == got[101].fingerprint
    assert got[103].near_next == 1.0 and got[104].fingerprint != got[105].fingerprint


def test_fingerprints_of_repeated_rows(spark):
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a\nba\n").hexdigest()
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, None)]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_subtracts_and_peels(spark):
    rnd = random.Random(4)
    a = [rnd.getrandbits(60) for _ in range(500)]
    b = a[6:] + [rnd.getrandbits(60) for _ in range(5)]
    pairs = spark.createDataFrame([(1, a, b), (2, a, a), (3, a, []), (4, [], None)], "k int, a array<bigint>, b array<bigint>")
    space = Workspace(spark, "sets")
    got = {r.k: r for r in fingerprints.compare_sets(pairs, space, ["k"], "a", ["b"]).collect()}
    assert set(got[1].b_diff.gone) == set(a[:6]) and set(got[1].b_diff.added) == set(b[-5:])
    assert got[2].a_sketch == got[2].b_sketch and not got[2].b_diff.gone and not got[4].b_diff.added
    assert sorted(got[3].b_diff.gone) == sorted(a) and got[3].b_sketch == " " * 47
    assert (got[1].a_size, got[1].b_size) == (500, 499)
    # the two sketches differ by what the differing digests alone would make
    cells = pairs.filter("k = 1").select(fingerprints.subtracted(
        fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("c")).first().c
    assert sum(c.n for c in cells[:fingerprints.WIDTH]) == 1
