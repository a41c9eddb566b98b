"""Toxicity on held-out rows, embedding links against all pairs, and the pipeline end to end."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from sourcetrust.llm import embedding_dedup, packing, tables, toxicity
from sourcetrust.llm.queries import vocabulary
from tokenizers import Tokenizer

VECTORS = "vec_id long, embedding array<float>, label int"


def texts(n, seed=0):
    rnd = random.Random(seed)
    stems, ends = ["idio", "moro", "clow"], ["t", "n", "ts", "nic", "tish"]
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9)))
    rows = []
    for i in range(n):
        toxic = rnd.random() < 0.2
        words = [word() for _ in range(rnd.randint(20, 200))]
        if toxic:
            for _ in range(max(1, len(words) // 30)):
                words[rnd.randrange(len(words))] = rnd.choice(stems) + rnd.choice(ends)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = texts(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.train(docs, labels)


def test_held_out_rows_are_told_apart(labelled):
    rows, docs, _, model = labelled
    score = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    held = [(y, score[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == bool(y) for y, s in held) / len(held) > 0.95


def test_score_is_the_mean_of_all_words(labelled):
    rows, docs, _, model = labelled
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs.filter("doc_id < 30"), model).collect()}
    for i, text, _ in rows[:30]:
        buckets, weights = toxicity.bag(text)
        expected = model.score((model.logits[buckets] * weights[:, None]).sum(axis=0))
        assert abs(got[i] - expected) < 1e-6


def test_odd_texts_are_scored(spark, labelled):
    _, docs, labels, model = labelled
    rows = [(1, None, 0.5), (None, "", 0.1), (2, " ?! ", None), (3, "x" * 50_000, 0.0), (3, "ÄÖ ß 日本", 0.0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity.score_texts(odd, model).collect()
    base = model.score(np.zeros(2))
    assert len(got) == 5 and {r.score for r in got if not (r.text or "").strip(" ?!")} == {base}
    assert toxicity.score_texts(odd.limit(0), model).columns == ["doc_id", "text", "score"]
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity.score_texts(odd, toxicity.train(docs, some)).count() == 5


def test_held_out_labels_are_never_read(spark, labelled):
    _, docs, labels, model = labelled
    flipped = labels.withColumn("toxic", (toxicity.held_out(labels["doc_id"]).cast("int") + labels["toxic"]) % 2)
    assert (toxicity.train(docs, flipped).logits == model.logits).all()


def pairs(vectors, labels, threshold=0.98):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    return near


def smallest(near):
    label = np.arange(len(near))
    while True:
        low = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(near))])
        if (low == label).all():
            return label
        label = low


def test_embedding_links_against_all_pairs(spark):
    """Separate pairs, and one group far denser than a window."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((300, 32))
    vectors = np.concatenate([
        centres, centres[:150] + rng.standard_normal((150, 32)) * 0.12, centres[0] + rng.standard_normal((400, 32)) * 0.13,
    ]).astype(np.float32).astype(np.float64)
    labels = np.concatenate([np.arange(300) % 3, np.arange(150) % 3, np.zeros(400, int)])
    order = rng.permutation(len(vectors))
    rows = [(int(i), vectors[i].tolist(), int(labels[i])) for i in order]
    got = {r.id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(4), window=16).collect()}
    near = pairs(vectors, labels)
    expected, root = near.sum(axis=1), smallest(near)
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= expected).all() and found.sum() >= 0.98 * expected.sum() and expected.max() > 100
    same = np.array([got[i].component for i in range(len(vectors))]) == root
    assert same.mean() > 0.98 and all(got[i].kept == (got[i].component == i) for i in got)


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    vectors = base + rng.standard_normal((90, 8)) * 0.05
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(vectors)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=8).collect()
    near = pairs(vectors, np.ones(90))
    assert {r.id: r.n_links for r in got if r.component == 0} == {i: int(near[i].sum()) for i in range(90) if smallest(near)[i] == 0}


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0),
        (7, [float("nan"), 1.0], 0), (8, [None, 1.0], 0), (9, [], 0), (None, [1.0, 0.0], 0), (2, [2.0, 0.0], 0),
        (10, [1e300, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [float("inf"), 0.0], 0),
    ]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    by = {r.id: (r.n_links, r.component, r.kept) for r in got}
    assert len(got) == len(rows) and by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[10] == (2, 1, False)
    assert by[None] == (0, None, True) and all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12))
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_pipeline_end_to_end(spark, tmp_path):
    """Planted toxic texts, copies, near copies and a shared passage; clean texts stay whole."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(3, 9)))
    passage = " ".join(word() for _ in range(80))
    rows = texts(600, seed=5)
    docs = {i: t for i, t, _ in rows}
    clean = {i: " ".join(word() for _ in range(150)) for i in range(1000, 1020)}
    docs |= clean
    docs[2000] = " " + clean[1000].replace(" ", "\n") + " "
    docs[2001] = clean[1001] + " " + word()
    long_ = " ".join(word() for _ in range(900))
    docs |= {2002: long_, 2003: long_ + " tail"}
    docs |= {3000 + i: " ".join([*(word() for _ in range(90)), passage, *(word() for _ in range(90))]) for i in range(3)}
    docs |= {4000: None, 4001: ""}
    table = spark.createDataFrame(
        [(i, t, "en", "src", len(t or "")) for i, t in docs.items()],
        "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage, kept = table, {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, stage, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert stage.columns == table.columns
            kept[name] = {r.doc_id: r.text for r in stage.collect()}
    toxic = {i for i, _, y in rows if y}
    gone = set(docs) - set(kept["toxicity"])
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) < 0.02 * len(docs)
    assert set(kept["toxicity"]) - set(kept["exact_dedup"]) == {1000, 4001}  # the longer copy, the smaller id
    near = set(kept["exact_dedup"]) - set(kept["simhash_dedup"])
    assert 2003 in near and near <= {2001, 2003} | toxic
    left = kept["suffix_dedup"]
    assert set(left) == set(kept["simhash_dedup"])
    assert all(passage not in left[i] and len(left[i]) > 500 for i in (3000, 3001, 3002))
    assert all(left[i] == clean[i] for i in range(1002, 1020)) and left[4000] == ""
    theirs, pieces = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), defaultdict(int)
    for r in stage.collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(theirs.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}


def test_what_another_operator_remembered_goes_before_texts_are_read():
    """The pipeline's toxicity stage ran beside the words that the packing stage had remembered."""
    tables.worker_value("encoder of an earlier stage", lambda: [1])
    assert list(toxicity._bags(iter([]))) == []
    assert sys.modules["_sourcetrust_worker"].value is None
