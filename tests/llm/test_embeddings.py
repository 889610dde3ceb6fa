"""Links of embeddings against brute force, at cosines close to the bound."""

import numpy as np
import pytest

from lexlake.llm import itq_links


def brute(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= itq_links.COSINE
    np.fill_diagonal(near, False)
    return near


def cloud(seed, n, dim=32):
    """Random vectors, and partners at cosines from 0.86 to 1."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((n, dim))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.86, 1, (n, 1))
    return np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * other])


@pytest.mark.parametrize("block", [2048, 4])
def test_recall_and_precision(spark, block):
    vectors = cloud(1, 400)
    near = brute(vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in itq_links.linked_vectors(df, block=block).collect()}
    found = sum(r.n_links for r in rows.values())
    assert found >= 0.95 * near.sum()
    assert all(rows[i].n_links <= near[i].sum() for i in rows)
    assert all(r.component_id <= r.vec_id and r.kept == (r.vec_id == r.component_id) for r in rows.values())


def test_a_group_of_near_copies_in_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal(16) + 0.02 * rng.standard_normal((150, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    for block in (2048, 16):
        rows = itq_links.linked_vectors(df, block=block).collect()
        assert {(r.n_links, r.component_id) for r in rows} == {(149, 0)}


def test_awkward_rows(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, one, "a"),
        (2, [2.0, 0.0, 0.0], "a"),
        (3, one, "a"),
        (3, one, "a"),
        (4, None, "a"),
        (5, [0.0, 0.0, 0.0], "a"),
        (6, [0.0, -0.0, 0.0], None),
        (7, [1.0, None, 0.0], "a"),
        (8, [float("nan"), 1.0, 0.0], "a"),
        (9, [float("inf"), 1.0, 0.0], "a"),
        (10, [], "a"),
        (None, one, "a"),
        (11, [0.0, 1.0, 0.0], "a"),
        (12, [1.0, 0.0], "a"),
        (13, [1e300, 1e290, 0.0], "a"),
        (14, [1.0, -0.0, 0.0], "a"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    found = {}
    for r in itq_links.linked_vectors(df).collect():
        found.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    # 1, 2, 3 twice, 13 and 14 point the same way
    assert found[1] == [(5, 1, True)]
    assert found[3] == [(5, 1, False)] * 2
    assert found[2] == found[13] == found[14] == [(5, 1, False)]
    for alone in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert found[alone] == [(0, alone, True)]
    assert found[None] == [(0, None, True)]
    assert itq_links.linked_vectors(df.limit(0)).collect() == []


def test_codes_are_balanced():
    vectors = np.random.default_rng(5).standard_normal((2000, 24)) + 0.5
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    bits = itq_links.learn_rotations(unit, 24, 60).bits(unit)
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.01


def about_a_mean(seed, n, share, dim=32):
    """Unit vectors with ``share`` of their squared length in common, and partners alike at a cosine of 0.9 to 0.91."""
    rng = np.random.default_rng(seed)
    common = np.zeros(dim)
    common[0] = np.sqrt(share)
    own, other = rng.standard_normal((2, n, dim - 1))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    other -= (other * own).sum(axis=1, keepdims=True) * own
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = (rng.uniform(0.9001, 0.91, (n, 1)) - share) / (1 - share)
    partner = cosine * own + np.sqrt(1 - cosine**2) * other
    return [common + np.sqrt(1 - share) * np.hstack([np.zeros((n, 1)), v]) for v in (own, partner)]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.7])
def test_recall_about_a_strong_mean(spark, share):
    vectors = np.concatenate(about_a_mean(3, 600, share))
    near = brute(vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in itq_links.linked_vectors(df).collect())
    assert near.sum() >= 1200 and 0.97 * near.sum() <= found <= near.sum()


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.7])
def test_planned_recall_at_many_vectors(share):
    first, second = about_a_mean(4, 3000, share, 64)
    measured = itq_links.agreement(first)
    width, tables = itq_links.table_plan(100_000, measured=measured)
    model = itq_links.learn_rotations(first, 64, width * tables)
    same = (model.bits(first) == model.bits(second))[:, : width * tables]
    met = same.reshape(len(same), tables, width).all(axis=2).any(axis=1)
    sketch = (~same[:, : itq_links.SKETCH_BITS]).sum(axis=1) <= itq_links.sketch_limit(measured=measured)
    assert (met & sketch).mean() >= 0.98
