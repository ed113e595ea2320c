"""The law of equal bytes where rows can't be told apart."""

from collections import Counter, defaultdict

import pytest

from gleaner.llm import sharding


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i], ids=["null", "one", "own"])
def test_equal_rows(spark, ids):
    rows = [(ids(i), "the same text!") for i in range(3000)] + [(i, f"other text {i:03d}") for i in range(3000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = Counter()
    slots = defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 24
    assert len(got) == 6000 and len(size) == 24
    assert max(size.values()) <= 1.05 * mean and min(size.values()) >= 0.95 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.text_crc32) for r in got).most_common(1)[0][1] == (1 if ids(1) == 1 else 3000)


def test_odd_rows_keep_the_law(spark):
    rows = [(None, None)] * 2000 + [(1, "")] * 2000 + [(2, "x" * 92)] * 500 + [(i, None) for i in range(500)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(got) == 5000 and max(size.values()) <= 1.1 * sum(size.values()) / 24
