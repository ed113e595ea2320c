"""Centroid clustering: against SQL, against plain arithmetic on numbers of any size, and on odd input."""

import hashlib
import math

import numpy as np

from gleaner.llm import centroids

from .test_sql import same

KIND = "vec_id long, embedding array<double>, cluster int"


def plain(rows, number=16, rounds=3):
    kept = [(i, [centroids.whole(x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in starts[:number]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), k) for k, w in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), j in zip(kept, of) if j == k] for k in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g)] if g else w for g, w in zip(groups, c)]
    out = [(i, *near(v)[::-1]) for i, v in kept] if c else []
    total = lambda k: min(sum(d for _, j, d in out if k in (None, j)), centroids.LONGEST)
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(map(str, ((i, k, min(d, centroids.LONGEST), total(k), total(None), sha[k]) for i, k, d in out)))


def got(spark, rows):
    return sorted(str(tuple(r)) for r in centroids.cluster(spark.createDataFrame(rows, KIND)).collect())


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    spots = rng.normal(size=(20, 64)) * rng.uniform(0, 3, 64)
    return [(i, (spots[i % 20] + 0.2 * rng.normal(size=64)).tolist(), 0) for i in range(n)]


def test_odd_vectors(spark):
    rows = vectors(300)
    odd = [(1, None), (2, [1.0] * 63), (3, [1.0] * 65), (4, [None] + [1.0] * 63), (5, [math.nan] * 64), (6, [math.inf] + [0.0] * 63), (7, [])]
    rows += [(i, v, 1) for i, v in odd] + [(None, rows[0][1], 1), rows[5], (5, rows[6][1], 0), (900, [0.0] * 64, 2), (901, [-0.0] * 64, 2)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:7]) == plain(rows[:7])
    assert got(spark, [(None, [1.0] * 64, 0)]) == got(spark, []) == []


def test_ties_and_copies(spark):
    rows = [(i, [float(i % 2)] * 64, 0) for i in range(200)]
    assert got(spark, rows) == plain(rows)


def test_numbers_beyond_64_bits(spark):
    rows = vectors(60, 2)
    big = [[1e30] * 64, [1e300] + [-1e15] * 63, [3e7] + [0.0] * 63, [-1e8] * 64, [1e30] * 63 + [-1e30]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(big * 4)]
    assert got(spark, rows) == plain(rows)


def test_search_equals_all_distances():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-40, 40, (3000, 64)), rng.integers(-40, 40, (16, 64))
    c[9] = c[4]
    x[:20] = c[9]
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    k, far = centroids.nearest(x, c, rng.permutation(64))
    assert (k == whole.argmin(1)).all() and (far == whole.min(1)).all()


def test_sql_of_a_fixture(spark, tmp_path):
    rows = vectors(150, 4) + [(7, None, 0), (8, [1.0], 0)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(same(spark, "op13_centroids", tmp_path)) == 150
