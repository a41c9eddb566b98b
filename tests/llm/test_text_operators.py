"""Exact, SimHash, suffix-array and chat operators against brute force and hand cases."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from sourcetrust.llm import chat, exact_dedup, simhash_dedup, suffix_dedup
from sourcetrust.llm.components import components
from sourcetrust.llm.tables import Workspace, numbered

DOC = "doc_id long, text string"


def words(rnd, n, letters="abcdeé"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(n))


def test_exact_cases(spark):
    rows = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \t"), (6, "ab"), (None, "ab"), (7, "c"), (7, "c"), (8, "a  b")]
    got = exact_dedup.mark_duplicates(spark.createDataFrame(rows, DOC)).select("doc_id", "text", "dedup.*").collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == len(rows)
    assert by[1, "a b"].keep_id == 8 and by[8, "a  b"].kept and by[None, "ab"].group_size == 5
    assert not by[None, "ab"].kept and by[3, None].keep_id == 5 and by[5, " \t"].group_size == 3
    assert by[7, "c"].kept and by[7, "c"].group_size == 2


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_compares_content_when_digests_collide(spark, bits):
    rows = [(i, f"t{i % 40}") for i in range(200)]
    got = exact_dedup.mark_duplicates(spark.createDataFrame(rows, DOC), digest_bits=bits, salts=3).select("doc_id", "dedup.*")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got.collect()} == {i: (i % 40, 5) for i in range(200)}


def test_exact_keeps_columns_that_clash(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, dedup int, keep_id string")
    left = exact_dedup.drop_duplicates(rows)
    assert left.columns == rows.columns and [tuple(r) for r in left.collect()] == [(1, "a", 5, "x")]
    assert exact_dedup.drop_duplicates(rows.limit(0)).count() == 0


def plain_fingerprint(text, n=4):
    w = text.encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum((counts[b] * 2 > len(grams)) << b for b in range(64))


def smallest(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprint_in_blocks():
    text = words(random.Random(1), 500) + " ÄÖ\tMiXeD"
    for shown in (text, "", " \n", "one two", "a b c d", "A\x0bB"):
        assert simhash_dedup.text_fingerprint(shown) == plain_fingerprint(shown)
        assert simhash_dedup.text_fingerprint(shown, block=7) == plain_fingerprint(shown)


def test_simhash_links_against_all_pairs(spark):
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    values = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 7))) for c in centres for _ in range(25)})
    fp = np.array(values, np.uint64)
    nodes = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    space = Workspace(spark, "test")
    links = simhash_dedup.fingerprint_links(nodes, space).collect()
    index = {int(v): i for i, v in enumerate(fp.view(np.int64))}
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp) <= 4, 1))
    found = smallest(len(fp), [(index[r.a], index[r.b]) for r in links])
    assert found == smallest(len(fp), zip(i.tolist(), j.tolist(), strict=True))


def test_simhash_cases(spark):
    rnd = random.Random(2)
    text = words(rnd, 300)
    rows = [(9, text), (4, text + " tail"), (7, None), (8, ""), (None, text), (5, words(rnd, 300)), (4, text + " tail")]
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, DOC))
    by = {(r.id, r.fp == 0): r.component for r in got.collect()}
    assert got.count() == 7 and by[7, True] == by[8, True] == 7 and by[9, False] == by[4, False] == by[None, False] == 4
    left = simhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, DOC))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["4", "4", "5", "7", "None"]
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (259, 400), (None, 2)]
    found = components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "test")).collect()
    by = {r.node: r.component for r in found}
    assert len(by) == len(found) == 61 + 62
    assert {by[i] for i in range(100, 161)} == {100} and by[400] == by[230] == 7


def test_numbered_counts_through_partitions(spark):
    rows = spark.range(1000).selectExpr("id % 37 AS k", "id")
    got = numbered(rows.repartition(7), [rows["k"], rows["id"]], Workspace(spark, "test"), "n").collect()
    assert [r.id for r in sorted(got, key=lambda r: r._pos)] == [i for k in range(37) for i in range(k, 1000, 37)]


def corpus():
    rnd = random.Random(3)
    passages = [words(rnd, 60) for _ in range(5)]
    texts = []
    for _ in range(50):
        kind, text = rnd.random(), words(rnd, rnd.randint(0, 200))
        if kind < 0.5:
            text += " " + rnd.choice(passages) + " " + words(rnd, rnd.randint(0, 50))
        if kind < 0.2:
            text += rnd.choice(passages)[:rnd.randint(150, 300)]
        if 0.6 < kind < 0.66:
            text = "shti " * rnd.randint(10, 300)
        if 0.66 < kind < 0.72:
            text = "a" * rnd.randint(100, 900)
        texts.append(text)
    return [*texts, None, "", passages[0], passages[0]]


def covered(texts, length=200):
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("shard_segments", [4096, 3])
def test_repeated_spans_against_all_substrings(spark, shard_segments):
    texts = corpus()
    rows = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], DOC).repartition(5)
    got = {r.id: r for r in suffix_dedup.repeated_spans(rows, shard_segments=shard_segments).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(raw, covered(raw), strict=True)):
        r = got[i if i != 5 else None]
        assert r.n_bytes == len(t) and bytes(r.kept) == np.frombuffer(t, np.uint8)[~gone].tobytes()
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int))).tolist()
        assert [(s.start, s.end) for s in r.spans] == list(zip(edges[::2], edges[1::2], strict=True))


def test_drop_repeats_keeps_columns_and_letters(spark):
    body = "é" * 300
    rows = [(1, "x" + body, "p"), (2, "y" + body + "z", "q"), (3, None, None), (4, "short", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, packed string")
    got = {r.doc_id: (r.text, r.packed) for r in suffix_dedup.drop_repeats(df).collect()}
    assert got == {1: ("x", "p"), 2: ("yz", "q"), 3: ("", None), 4: ("short", "r")}
    assert suffix_dedup.drop_repeats(df.limit(0)).columns == df.columns and suffix_dedup.repeated_spans(df.limit(0)).count() == 0


def test_suffix_pieces_of_long_texts(monkeypatch):
    """Texts longer than a piece give the same windows."""
    text = words(random.Random(8), 3000).encode()
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 12)
    (_, _, first, last, _), = suffix_dedup.segments([text], 200)
    covered_starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert (np.sort(covered_starts) == np.arange(len(text) - 199)).all()


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(4)
    data = bytes(rnd.choice(b"ab") for _ in range(700)) + b"abc" * 100
    order, _ = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_quotes_link_to_first_message(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nI am fine,\nreally."),
        (1, 1, "assistant", "> Hello there.\n> How are you?\nGood!"),
        (1, 2, "user", ">> Hello there.\n>> how   are you?\n> Good!\n>\nNice.\r\n> unknown line\nbye"),
        (1, 4, "user", "> I am fine, really.\nok"), (1, 3, None, None),
        (None, 0, "user", "x"), (None, 1, "a", "> x\n"),
        (2, None, "user", ""), (2, 5, "user", "> \n>> \n"), (2, 7, "u", "> y"), (2, 7, "u", "> y"), (2, 6, "user", " > y > z\n y"),
    ]
    got = chat.link_quotes(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    by = {(r.conv_id, r.position): (r.reply_to, r.n_quotes, r.n_linked, r.body) for r in got}
    assert by[1, 0] == (None, 0, 0, rows[0][3]) and by[1, 1] == (0, 1, 1, "Good!")
    assert by[1, 2] == (1, 3, 2, "Nice.\nbye") and by[1, 3] == (2, 0, 0, "") and by[1, 4] == (0, 1, 1, "ok")
    assert by[None, 1] == (0, 1, 1, "") and by[2, 1][:3] == (0, 2, 0) and by[2, 2] == (1, 1, 0, "y")
    assert by[2, 3] == by[2, 4] == (2, 1, 1, "") and len(got) == len(rows)
    assert {r.chat for r in got if r.conv_id == 1 and r.position == 1} == {"<|im_start|>assistant\nGood!<|im_end|>\n"}
    assert chat.link_quotes(spark.createDataFrame([], CONVERSATIONS)).count() == 0
