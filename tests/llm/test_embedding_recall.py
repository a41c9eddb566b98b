"""Recall of vector links by size and density of labels, and among copies."""

import numpy as np
import pytest
from sourcetrust.llm import embedding_dedup

VECTORS = "vec_id long, embedding array<double>, label int"


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def test_isolated_pairs_of_a_leaning_label(spark):
    """12,000 vectors at a mean cosine of 0.9, of which 1,000 pairs are linked."""
    rng = np.random.default_rng(5)
    lean = np.zeros(64)
    lean[0] = 3.0
    rows = unit(lean + unit(rng.standard_normal((11000, 64))))
    rows = np.concatenate([rows, unit(rows[:1000] + 0.18 * unit(rng.standard_normal((1000, 64))))])
    near = rows @ rows[11000:].T >= 0.98
    assert near.sum() < 2600
    expected = near[:11000].any(axis=0)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], VECTORS).repartition(4)
    got = {r.id: r for r in embedding_dedup.near_vectors(table).collect()}
    found = np.array([got[11000 + i].n_links > 0 for i in range(1000)])
    assert len(got) == 12000 and (found & expected).sum() >= 0.98 * expected.sum()


@pytest.mark.parametrize("rows,lean", [(40, 0.0), (600, 0.0), (600, 3.0), (5000, 0.0), (5000, 3.0)])
def test_recall_by_size_and_density(spark, rows, lean):
    """Four labels of one size; a tenth of the vectors have a near one. At least 0.9 of the links are found."""
    rng = np.random.default_rng(rows)
    shift = np.zeros(64)
    shift[0] = lean
    vectors = unit(shift + unit(rng.standard_normal((4 * rows, 64)))).astype(np.float32)
    some = rng.permutation(4 * rows)[:4 * rows // 10]
    vectors = np.concatenate([vectors, unit(vectors[some] + 0.15 * unit(rng.standard_normal((len(some), 64)))).astype(np.float32)])
    labels = np.concatenate([np.arange(4 * rows) % 4, some % 4])
    table = spark.createDataFrame(
        [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.id: r.n_links for r in embedding_dedup.near_vectors(table).collect()}
    found = expected = 0
    for label in range(4):
        at = np.flatnonzero(labels == label)
        own = unit(vectors[at].astype(np.float64))
        counts = (own @ own.T >= 0.98).sum(axis=1) - 1
        mine = np.array([got[i] for i in at])
        assert (mine <= counts).all()
        found, expected = found + mine.sum(), expected + counts.sum()
    assert expected > 0 and found >= 0.97 * expected


def test_copies_do_not_fill_windows(spark):
    """Two groups of 300 copies each that are near each other, and a group that is not."""
    rng = np.random.default_rng(6)
    bases = rng.standard_normal((20, 32))
    near = bases + rng.standard_normal((20, 32)) * 0.1
    far = rng.standard_normal(32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([np.repeat(np.concatenate([bases, near]), 300, axis=0), [far] * 5]))]
    table = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = {r.id: (r.n_links, r.component, r.kept) for r in embedding_dedup.near_vectors(table, window=16).collect()}
    expected = {i: (599, i % 6000 // 300 * 300, i % 300 == 0 and i < 6000) for i in range(12000)}
    assert got == expected | {12000 + i: (4, 12000, i == 0) for i in range(5)}
