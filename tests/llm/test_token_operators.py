"""Token counts, token files, pair merging and packing against the library and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from sourcetrust.llm import bpe, encoding, packing, token_counts, token_files
from sourcetrust.llm.queries import vocabulary
from sourcetrust.llm.tables import Memory, Workspace
from tokenizers import Tokenizer

DOC = "doc_id long, text string"
WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
ALPHABET = [*"abcdefgh'  .,!?0123ΣσςéİßÀ́ \x1c\x85\n\t　日本語🙂ǅ", "<|endoftext|>", "<|startoftext|>", "<|endof", "'ll", "'S"]


def odd_texts(n=600):
    rnd = random.Random(1)
    mixed = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [*mixed, "", "a" * 3000, "ab" * 2000, "!" * 999, "two  spaces", " lead", "trail ", "a \n b", "\n\n"]


def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pair_merging_and_decoding_equal_the_library(path):
    theirs, ours = library(path), bpe.PairEncoder(path)
    for text, ids in zip(odd_texts(), ours.encode(odd_texts()), strict=True):
        expected = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, ours.dtype).tolist() == expected
        assert ours.decode(expected).decode() == theirs.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize(("path", "kind"), [(WORDS, "words"), (BYTES, "spaced")])
def test_cut_texts_have_the_ids_of_whole_texts(path, kind):
    theirs, ours = library(path), encoding.KINDS[kind](path)
    for text in odd_texts():
        assert np.frombuffer(ours(text), ours.dtype).tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "kind"), [(WORDS, "words"), (BYTES, "spaced")])
@pytest.mark.parametrize("together", [4096, 3])
def test_new_words_encoded_together_have_their_own_ids(monkeypatch, path, kind, together):
    monkeypatch.setattr(encoding, "TOGETHER", together)
    monkeypatch.setattr(encoding, "BATCH_CHARS", 500)
    rnd = random.Random(4)
    plain = [" ".join(rnd.choices(["der", "Größe,", "naïve.", "x", "don't", "1,5", "É!", "s\u0327", "日本語", "<unk>", "-"], k=30)) for _ in range(50)]
    theirs, ours, texts = library(path), encoding.KINDS[kind](path), [*odd_texts(), *plain]
    for text, ids in zip(texts, encoding.encoded_texts(ours, [*texts[:-1], texts[-1]]), strict=True):
        assert np.frombuffer(ids, ours.dtype).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert list(encoding.encoded_texts(ours, [None, "", None])) == [b""] * 3


def test_memory_is_bounded_and_keeps_what_is_in_use():
    memory, rnd = Memory(40), random.Random(0)
    for _ in range(2000):
        keys = {str(rnd.randint(0, 60)) for _ in range(rnd.randint(0, 30))}
        memory.forget_long(memory.learn(keys, lambda some: [int(k) * 2 for k in some]))
        assert all(memory[k] == int(k) * 2 for k in keys) and len(memory) <= 60


def test_automaton_counts_longest_matches():
    pieces = token_counts.vocabulary_pieces(BYTES)
    automaton, known, most = token_counts.MatchAutomaton(pieces), set(pieces), max(map(len, pieces))

    def greedy(word):
        n = at = 0
        while at < len(word):
            end = min(len(word), at + most)
            while word[at:end] not in known:
                end -= 1
            at, n = end, n + 1
        return n

    for text, got in zip(odd_texts(), automaton.count_texts(odd_texts()), strict=True):
        split = text.encode().split()
        assert got == (len(split), sum(greedy(b" " + w) for w in split))


def test_automaton_needs_all_bytes():
    with pytest.raises(ValueError, match="single byte"):
        token_counts.MatchAutomaton([b"a"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.integers(0, 6), st.integers(0, 6))
def test_file_round_trip(ids, first, last):
    array = np.array(ids, np.uint32)
    file = token_files.pack(array)
    assert token_files.unpack(file).tolist() == ids
    assert token_files.unpack(file, first, max(first, last)).tolist() == ids[first * 128:max(first, last) * 128]


def test_token_files_of_odd_rows(spark):
    rows = [(3, "the cat"), (None, "a dog"), (1, None), (2, ""), (7, "x " * 4000), (3, "the cat"), (5, "<|endoftext|>")]
    folder = f"{Workspace(spark, 'test').folder}/files"
    token_files.write_token_files(spark.createDataFrame(rows, DOC).repartition(3), folder, WORDS, 2, kind="words", chunk_ids=5)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    at, theirs = 0, library(WORDS)
    for r, (doc, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (doc, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = f"{Workspace(spark, 'test').folder}/files"
    token_files.write_token_files(spark.createDataFrame([], DOC), empty, WORDS, 2, kind="words")
    assert token_files.read_token_files(spark, empty).count() == 0


def packed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lane string").repartition(3)
    return packing.pack_sequences(df, BYTES, kind="spaced", **options).collect()


def check_pieces(rows, got, sequence):
    theirs, of, at = library(BYTES), defaultdict(list), defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and 0 < r.length <= sequence
    for doc, text, *_ in rows:
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(of[doc], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    assert sorted(at) == list(range(len(at)))
    for k, spans in at.items():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == sequence or k == len(at) - 1


def test_packing_of_odd_rows(spark):
    rnd = random.Random(6)
    rows = [(i, "the cat sat " * rnd.randint(0, 90), rnd.choice(["a", "a", "a", "b", None, f"rare{i}"]), "x") for i in range(80)]
    rows += [(100, None, "a", "x"), (101, "", None, None)]
    got = packed(spark, rows, sequence=64, window_sequences=4)
    check_pieces(rows, got, 64)
    assert packed(spark, rows[:1], sequence=8)[0].doc_id == 0 and packed(spark, [r for r in rows if r[0] < 0] or rows[:0]) == []


def test_packing_keeps_targets_until_a_source_is_empty(spark):
    rows = [(i, "w " * 200, "a" if i % 4 else "b", "x") for i in range(200)]
    got = packed(spark, rows, sequence=128, window_sequences=8, targets={"a": 1.0, "b": 1.0})
    check_pieces(rows, got, 128)
    mix = defaultdict(lambda: defaultdict(int))
    for r in got:
        mix[r.sequence_id // 8][r.source] += r.length
    empty = next(k for k in sorted(mix) if mix[k]["b"] < 500)
    assert empty > 5 and all(abs(mix[k]["b"] - 512) <= 1 for k in range(empty))


def test_deficits_are_carried():
    lanes = packing.Lanes([1000, 333, 7, 60], [1000, 333, 7, 60], 100)
    served = lanes.served(np.arange(15))
    assert (served.sum(axis=1) == np.minimum(np.arange(15) * 100, 1400)).all() and (np.diff(served, axis=0) >= 0).all()
    assert served[-1].tolist() == [1000, 333, 7, 60]
    exact = lanes.ideal(np.minimum(np.arange(15) * 100, 1400))
    assert np.abs(served - exact).max() < 1


def test_counting_and_encoding_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (None, "a b"), (1, "a b"), (1, "a b"), (2, "")], DOC)
    assert sorted(map(str, token_counts.count_tokens(rows, BYTES).select("n_words", "n_bytes").collect())) == sorted(
        ["Row(n_words=0, n_bytes=0)"] * 2 + ["Row(n_words=2, n_bytes=3)"] * 3)
    got = bpe.encode_texts(rows, WORDS).collect()
    assert sorted(r.decoded for r in got) == ["", "", *["a</w> b</w>"] * 3]
    assert bpe.encode_texts(rows.limit(0), WORDS).count() == token_counts.count_tokens(rows.limit(0), BYTES).count() == 0


@pytest.mark.parametrize(("path", "kind"), [(WORDS, "words"), (BYTES, "spaced")])
def test_new_words_need_few_calls_of_the_library(path, kind):
    """A library call for every new word took most of the time."""
    theirs, ours = library(path), encoding.KINDS[kind](path)
    made = [f"{a}{b}rn{c}" for a in "abdeéß" for b in "aeiouü" for c in "klmnopr"]
    text = " ".join(w + ("", ",", "***", "\n" + w)[i % 4] for i, w in enumerate(made))
    calls, whole = [], ours.whole
    ours.whole = lambda some: calls.append(some) or whole(some)
    assert np.frombuffer(ours(text), ours.dtype).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert len(calls) < 10


@pytest.mark.parametrize(("path", "kind"), [(WORDS, "words"), (BYTES, "spaced")])
def test_marks_and_rare_white_space_between_words(path, kind):
    texts = [
        "a | b |c| ||| d|e f|", "a\x1cb \x1c c\x1d", "a b   c\u0085 d", "x\t y\r\nz \x0b w", "one\ntwo \nthree\n four\n\nfive,,, six",
        "<|endoftext|> a<|endoftext|>b <|startoftext|>", "it's 's don't** we'll!!", "é. é́,, ́x", " ", "\n", "\na\n", "a \x00 b",
    ]
    theirs, ours = library(path), encoding.KINDS[kind](path)
    for _ in range(2):
        for text, ids in zip(texts, ours.many(texts), strict=True):
            assert np.frombuffer(ids, ours.dtype).tolist() == theirs.encode(text, add_special_tokens=False).ids, text
