"""Pairs within a Hamming distance: against all pairs, with cells that hold most of the rows, and for every radius."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import hamming, perceptual
from gleaner.plans import catalogue
from gleaner.sources.scratch import written


def patterns(rng, n, near, most):
    """Random patterns and copies of some of them with up to ``most`` bits changed."""
    base = rng.integers(-(1 << 63), 1 << 63, n, np.int64)
    out = [int(x) for x in base]
    for x in rng.choice(base, near).tolist():
        for b in rng.choice(64, int(rng.integers(0, most + 1)), replace=False).tolist():
            x ^= 1 << b if b < 63 else -(1 << 63)
        out.append(x)
    return sorted(set(out))


def bits(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def all_links(marks, total, frame):
    out = set()
    for i, a in enumerate(marks):
        for j in range(i + 1, len(marks)):
            b = marks[j]
            each = [bits(x, y) for x, y in zip(a[1], b[1])]
            if a[2] == b[2] and len(a[1]) == len(b[1]) and sum(each) <= total and max(each, default=0) <= frame:
                out.add((min(a[0], b[0]), max(a[0], b[0]), sum(each)))
    return out


def found(spark, marks, total, frame, **options):
    rows = written(spark.createDataFrame(marks, "rep string, hashes array<long>, key int"), "marks")
    got = [tuple(r) for r in hamming.links(rows, total, frame, ["key"], **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("radius", [1, 3, 8, 20])
def test_every_pair_within_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    marks = [(f"/{i:04}", [h], i % 2) for i, h in enumerate(patterns(rng, 150, 150, radius + 2))]
    want = all_links(marks, radius, radius)
    assert want and found(spark, marks, radius, radius) == want


@pytest.mark.parametrize("limit, few", [(4, 100_000), (4, 3), (1, 100_000)])
def test_full_cells_are_split_and_lose_nothing(spark, limit, few):
    rng = np.random.default_rng(limit)
    dark = patterns(rng, 1, 120, 5) + [int(x) for x in rng.integers(0, 64, 40)]  # one pattern's copies, and patterns that are mostly zero
    marks = [(f"/{i:04}", [h], 0) for i, h in enumerate(sorted({*dark, *patterns(rng, 40, 0, 0)}))]
    want = all_links(marks, 8, 8)
    assert len(want) > 500 and found(spark, marks, 8, 8, limit=limit, few=few) == want


def test_groups_hold_two_chunks_at_most(spark, monkeypatch):
    """The join's groups, as the index deals them out, with a cell that nearly all rows share."""
    rng = np.random.default_rng(9)
    marks = [(f"/{i:04}", [int(h)], 0) for i, h in enumerate(np.unique(rng.integers(0, 1 << 12, 900)))]
    rows = written(spark.createDataFrame(marks, "rep string, hashes array<long>, key int"), "marks")
    dealt = []
    join = type(rows).join

    def seen(self, other, on=None, how=None):
        if "pc" in self.columns and "hc" in self.columns and how is None and "a.rep" in str(on):
            dealt.extend([self, other])
        return join(self, other, on, how)

    monkeypatch.setattr(type(rows), "join", seen)
    hamming.links(rows, 8, 8, ["key"], limit=64)
    assert len(dealt) == 2
    for side in dealt:
        assert side.groupBy("key", "band", "value", "hc", "pc").count().agg(F.max("count")).first()[0] <= 2 * 64  # chunks are cut by hash: about 64


def test_videos_and_odd_marks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 4, np.int64)]
        rows.append((f"/{i:03}a", base, 0))
        flip = [int(sum(1 << int(b) for b in rng.choice(60, n, replace=False))) for n in rng.integers(0, 13, 4)]
        rows.append((f"/{i:03}b", [x ^ y for x, y in zip(base, flip)], 0))
    rows += [("/short", rows[0][1][:2], 0), ("/shorter", [rows[0][1][0] ^ 1, rows[0][1][1]], 0), ("/none", [], 0), ("/null", None, 0), ("/part", [None, 1], 0)]
    good = [r for r in rows if r[1] and None not in r[1]]
    want = all_links(good, 32, 12)
    assert 10 < len(want) < 61 and found(spark, rows, 32, 12) == want
    assert found(spark, [], 8, 8) == set() and found(spark, rows[:4], 0, 12) == set()


def test_bands_cover_every_pattern_and_follow_the_count():
    for radius in (1, 2, 8, 12, 40):
        for count in (10, 10**6, 10**9):
            plan = hamming.bands(radius, count)
            assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for *_, r in plan) == radius + 1 and all(r >= 0 for *_, r in plan)
            assert [s for s, *_ in plan] == [sum(w for _, w, _ in plan[:i]) for i in range(len(plan))]
    assert len(hamming.bands(8, 10**9)) < len(hamming.bands(8, 1000))
    with pytest.raises(ValueError):
        hamming.bands(0, 5)


def test_blocks_and_none(spark):
    rows = [("/a", 0, 640, 480), ("/b", 1 << 60, 1280, 480), ("/c", 1, 640, 480), ("/d", 0, 640, 480), ("/e", None, 1, 1)]
    df = spark.createDataFrame(rows, "path string, h long, width int, height int")
    told = lambda blocking: {(r.a, r.b, r.score, r.pairs) for r in perceptual.image_links(df, blocking=blocking)[1].collect()}
    assert told("exact") == {("/a", "/c", 1, 2)}
    assert told("none") == {("/a", "/b", 1, 2), ("/a", "/c", 1, 2), ("/b", "/c", 2, 1)}
    classes, _, members = perceptual.image_links(df, blocking="none")
    assert sorted(map(tuple, perceptual.named_members(classes, members).collect())) == [("/a", "/a"), ("/b", "/b"), ("/c", "/c"), ("/d", "/a")]
    with pytest.raises(ValueError):
        perceptual.image_links(df, blocking="some")


def test_members_are_told_without_comparing_classes(spark, monkeypatch):
    monkeypatch.setattr(perceptual, "links", lambda *_, **__: pytest.fail("no pair is asked for"))
    assert catalogue.QUERIES["image_members"](spark, "/root/testdata/sf0.001").count() == 193


@pytest.mark.parametrize("radius", [1, 2, 3, 8, 12, 20, 63])
def test_masks_meet_every_pattern(radius):
    rng = np.random.default_rng(radius)
    for count in (10, 10**5, 10**7, 10**10):
        plan = hamming.masks(radius, count)
        assert len(set(plan)) == len(plan)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not flips & m for m in plan)
    assert max(m.bit_count() for m in hamming.masks(8, 10**7)) > max(m.bit_count() for m in hamming.masks(8, 10**5))
    with pytest.raises(ValueError):
        hamming.masks(0, 5)


@pytest.mark.parametrize("radius, chunk", [(1, 5), (3, 1000), (8, 5), (8, 40), (20, 5)])
def test_batches_find_every_pair_once(spark, radius, chunk):
    """All in one cell, in chunks of it, or by masks: the same pairs as all pairs say."""
    rng = np.random.default_rng(radius)
    marks = [(f"/{i:04}", [h], i % 3 // 2) for i, h in enumerate(patterns(rng, 150, 150, radius + 2))]
    want = all_links(marks, radius, radius)
    assert want and found(spark, marks, radius, radius, joined=0, chunk=chunk) == want


def test_batches_split_hot_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    dark = patterns(rng, 1, 120, 5) + [int(x) for x in rng.integers(0, 64, 40)]
    marks = [(f"/{i:04}", [h], 0) for i, h in enumerate(sorted({*dark, *patterns(rng, 40, 0, 0)}))]
    want = all_links(marks, 8, 8)
    monkeypatch.setattr(hamming, "TILE", 64)
    assert len(want) > 500 and found(spark, marks, 8, 8, joined=0, chunk=4) == found(spark, marks, 8, 8, joined=0, chunk=4, few=3) == want


@pytest.mark.parametrize("chunk", [5, 1000])
def test_batches_compare_videos_and_pass_odd_marks_over(spark, chunk):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 4, np.int64)]
        flip = [int(sum(1 << int(b) for b in rng.choice(60, n, replace=False))) for n in rng.integers(0, 13, 4)]
        rows += [(f"/{i:03}a", base, 0), (f"/{i:03}b", [x ^ y for x, y in zip(base, flip)], 0)]
    rows += [("/short", rows[0][1][:2], 0), ("/shorter", [rows[0][1][0] ^ 1, rows[0][1][1]], 0), ("/none", [], 0), ("/null", None, 0), ("/part", [None, 1], 0)]
    want = all_links([r for r in rows if r[1] and None not in r[1]], 32, 12)
    assert 10 < len(want) < 61 and found(spark, rows, 32, 12, joined=0, chunk=chunk) == want


def test_large_blocks_are_not_dealt_out_by_near_values(spark, monkeypatch):
    """A row of the index went to a cell for each value near its own, 57 times and more; now it goes to one for each mask at most."""
    rng = np.random.default_rng(6)
    marks = [(f"/{i:04}", [int(h)], 0) for i, h in enumerate(rng.integers(-(1 << 63), 1 << 63, 600, np.int64))]
    rows, dealt, sort = written(spark.createDataFrame(marks, "rep string, hashes array<long>, key int"), "marks"), [], type(spark.range(1)).sortWithinPartitions
    monkeypatch.setattr(type(rows), "sortWithinPartitions", lambda self, *c, **k: dealt.append(self) or sort(self, *c, **k))
    hamming.links(rows, 8, 8, ["key"], joined=0, chunk=100).count()
    assert [d.count() for d in dealt] == [600 * len(hamming.masks(8, 600))]
    hamming.links(rows, 8, 8, ["key"], joined=0, chunk=600).count()
    assert dealt[1].count() == 600


def test_links_are_not_joined_with_their_classes(spark, monkeypatch):
    rows = spark.createDataFrame([("/a", 0, 640, 480), ("/b", 0, 640, 480), ("/c", 1, 640, 480)], "path string, h long, width int, height int")
    find, join, late = perceptual.links, type(rows).join, []

    def links(*args, **options):
        out = find(*args, **options)
        monkeypatch.setattr(type(rows), "join", lambda self, *a, **k: late.append(a) or join(self, *a, **k))
        return out

    monkeypatch.setattr(perceptual, "links", links)
    assert [tuple(r) for r in perceptual.image_links(rows)[1].collect()] == [("/a", "/c", 2, 1)] and not late
