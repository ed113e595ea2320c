"""Embeddings in a narrow cone, and tables of few vectors."""

import numpy as np
import pytest

from gleaner.llm import embeddings


def links(spark, x):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    return np.array([r.n_links for r in sorted(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect(), key=lambda r: r.vec_id)])


def test_two_vectors(spark):
    assert links(spark, np.array([[1.0, 0.0], [0.99, 0.141]])).tolist() == [1, 1]


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_cone(spark, cosine):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    axis, side = np.eye(64)[0], unit(np.concatenate([np.zeros((200, 1)), rng.normal(size=(200, 63))], axis=1))
    base = np.sqrt(cosine) * axis + np.sqrt(1 - cosine) * side
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.002])
    u = unit(x)
    want = (u @ u.T >= 0.98).sum(1) - 1
    got = links(spark, x)
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() > 0


def test_few_crowds(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(np.eye(64)[:3], 80, axis=0) + rng.normal(size=(240, 64)) * 0.0125
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    assert want.sum() > 0 and links(spark, x).tolist() == want.tolist()
