"""Numbers and running sums of a whole table."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators.numbering import numbered


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_numbers_and_sums_run_over_all_ranges(spark, n):
    rows = [(f"k{i % 97:02}", f"/{i:05}", i % 3 or None) for i in range(n)]
    df = spark.createDataFrame(random.Random(1).sample(rows, n), "k string, path string, v int").repartition(7)
    got = numbered(df, ["k", "path"], "n", {"moved": F.when(F.col("v") == 2, 1), "sum": F.col("v")})
    assert got.columns == ["k", "path", "v", "n", "moved", "sum"]
    want, moved, total = [], 0, 0
    for i, r in enumerate(sorted(rows, key=lambda r: r[:2]), 1):
        moved, total = moved + (r[2] == 2), total + (r[2] or 0)
        want.append((*r, i, moved, total))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == want


def test_no_window_over_all_rows(spark):
    plan = numbered(spark.range(50), ["id"], "n", {"s": F.col("id")})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("many", [1, 5, 10_000])
def test_versions_over_ranges_are_those_of_one_group(spark, many):
    from gleaner.operators import organizer

    rnd = random.Random(many)
    rows = [(f"/s{i:03}", f"k{rnd.randrange(9)}", f"/t/{rnd.choice('XXXXYZ')}.mkv") for i in range(120)]
    taken = {f"/t/{b}{n}.mkv" for b in "XY" for n in ["", *[f" ({k})" for k in rnd.sample(range(2, 150), 60)]]} | {"/t/Z (4).mkv", "/t/Q (2).mkv"}
    want, used = {}, set(taken)
    for source, _, base in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        n, name = 1, base
        while name in used:
            n += 1
            name = base.replace(".mkv", f" ({n}).mkv")
        used.add(name)
        want[source] = name
    df = spark.createDataFrame(rows, "source string, dedupe_key string, base string")
    got = organizer.versioned(df, spark.createDataFrame([(t,) for t in taken], "path string"), many)
    assert {r.source: r.destination for r in got.collect()} == want
