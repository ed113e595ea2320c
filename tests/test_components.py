"""Components of graphs with hubs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gleaner.operators import components, perceptual
from gleaner.sources.scratch import written


def plain(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up}


@pytest.mark.parametrize("heavy", [0, 1 << 40])
@pytest.mark.parametrize("kind", ["low star", "high star", "chain", "random", "names", "none"])
def test_hubs_change_nothing(spark, monkeypatch, heavy, kind):
    monkeypatch.setattr(components, "HEAVY", heavy)
    rnd = random.Random(3)
    edges = {
        "low star": [(0, i) for i in range(1, 300)] + [(i, 1000 + i) for i in range(1, 50)],
        "high star": [(999, i) for i in range(300)] + [(2000, 2001)],
        "chain": [(i, i + 1) for i in rnd.sample(range(120), 110)],
        "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(160)] + [(7, 7), (None, 3), (5, None), (9, 10), (10, 9)],
        "names": [(f"/{rnd.randrange(40)}", f"/{rnd.randrange(40)}") for _ in range(30)],
        "none": [],
    }[kind]
    df = spark.createDataFrame(edges, "a string, b string" if kind == "names" else "a long, b long")
    assert {r.node: r.component for r in components.connected_components(df).collect()} == plain(edges)


def test_a_hub_is_never_shuffled(spark):
    rows = written(spark.range(20_000).select(F.col("id").alias("u"), F.when(F.col("id") % 10 < 9, -1).otherwise(F.col("id") - 1).alias("v")).repartition(8), "star")
    hub = components.hubs(rows, "v", rows.count(), 8)
    assert [r.v for r in hub.collect()] == [-1]
    table = rows.select("v").distinct().withColumn("m", F.col("v") - 5)
    got = components.met(rows, table, "v", "left", hub)
    assert got.count() == 20_000 and got.where("m = v - 5").count() == 20_000
    tasks = [r["count"] for r in got.where("v = -1").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 4 and max(tasks) <= 2 * 18_000 / len(tasks)


def test_crowds_of_similar_frames_are_thinned_before_their_components(spark, monkeypatch):
    """60 frames with all their 1,770 links: the components need 59 of them, the sums all."""
    marks = [sum(1 << b for b in c) for n in range(3) for c in combinations(range(12), n)][:60]
    rows = spark.createDataFrame([(f"/{i:02}", h, 640, 480) for i, h in enumerate(marks)], "path string, h long, width int, height int")
    find, seen = perceptual.connected_components, []
    monkeypatch.setattr(perceptual, "connected_components", lambda edges: seen.append(edges.count()) or find(edges))
    told = perceptual.image_clusters(rows)[0].collect()
    assert [(r.first_path, r.n_paths, r.pairs, r.min_score, r.max_score) for r in told] == [("/00", 60, 1770, 1, 4)]
    assert seen == [59]
