"""The store as a log: folded like merges one after the other, opened no wider than needed, safe from other writers and broken writes."""

import threading

import pytest
from pyspark.sql import functions as F

from gleaner.operators import store
from gleaner.sources.log import Conflict, Log, any_within, filter_of


def row(path, mtime, quick=None, full=None, run="r"):
    return (path, 1, mtime, 1, 1, quick, full, None, None, run)


def table(spark, rows):
    return spark.createDataFrame(rows, store.SCHEMA)


def told(df):
    return sorted(tuple(r) for r in df.collect())


RUNS = [
    [row("/a/1", 1, "q1", "f1"), row("/a/2", 1, "q2"), row("/b/1", 1, "q3"), row("/c", 1, "x")],
    [row("/a/1", 2, None, "f2"), row("/a/2", 1, None, "f4"), row("/b/2", 1, "q5")],
    [row("/a/1", 1, None, None), row("/b/1", 1, None, "f6"), row("/a/2", 1, "q7")],
]


@pytest.mark.parametrize("prune", [(None, None, None), (None, ["/a"], None), (None, "all", None), (["/b/"], None, ["/a", "/c"])])
def test_fold_is_the_merge_of_all_runs(spark, tmp_path, prune):
    log, want = store.opened(spark, str(tmp_path / "log"), buckets=4), table(spark, [])
    for i, (rows, roots) in enumerate(zip(RUNS, prune)):
        fresh = table(spark, [(*r[:-1], f"run{i}") for r in rows])
        folders = None if roots == "all" else roots
        log.append(fresh, prune=roots is not None, roots=folders)
        merged = store.merge(want, fresh.drop("last_seen_run"), f"run{i}")
        want = table(spark, told(store.prune(merged, f"run{i}", folders) if roots is not None else merged))
        assert told(log.read()) == told(want)
    asked = spark.createDataFrame([("/a/1",), ("/b/1",), ("/none",), (None,), ("/a/1",)], "path string")
    assert told(log.lookup(asked)) == told(want.where("path in ('/a/1', '/b/1')"))
    log.compact()
    assert told(log.read()) == told(want) and len(log.deltas()) == 1 and log.deltas()[0].base
    assert len(list((tmp_path / "log/parts").iterdir())) == len(list((p for p in (tmp_path / "log/commits").iterdir() if p.name.isdigit()))) == 1


def test_lookups_open_only_what_can_hold_their_keys(spark, tmp_path):
    log = store.opened(spark, str(tmp_path), buckets=32)
    for n in range(3):
        log.append(table(spark, [row(f"/{n}/{i}", 1, "q") for i in range(2000)]))
    every = len(log.read().inputFiles())
    some = log.lookup(spark.createDataFrame([("/1/7",), ("/1/8",), ("/2/9",), ("/none",)], "path string"))
    opened = lambda df: [f for f in df.inputFiles() if "/rows/" in f]
    assert every == 96 and 1 <= len(opened(some)) <= 4
    assert {r.path for r in some.collect()} == {"/1/7", "/1/8", "/2/9"}
    assert log.lookup(spark.createDataFrame([], "path string")).count() == 0 == len(opened(log.lookup(spark.createDataFrame([("/no",)], "path string"))))


def test_many_deltas_become_a_base(spark, tmp_path):
    log = Log(spark, str(tmp_path), "k string, v long", "k", buckets=2, most=3)
    for n in range(6):
        log.append(spark.createDataFrame([("a", n), (f"k{n}", n)], "k string, v long"))
    assert len(log.deltas()) <= 3
    assert told(log.read()) == [("a", 5)] + [(f"k{n}", n) for n in range(6)]


def test_two_writers(spark, tmp_path):
    logs = [Log(spark, str(tmp_path), "k string, v long", "k", buckets=2) for _ in range(4)]
    work = [threading.Thread(target=lg.append, args=(spark.createDataFrame([(f"k{i}", i)], "k string, v long"),)) for i, lg in enumerate(logs)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert told(logs[0].read()) == [(f"k{i}", i) for i in range(4)] and [d.number for d in logs[0].deltas()] == [1, 2, 3, 4]

    class Late(Log):
        def _put(self, rows):
            folder = super()._put(rows)
            logs[0].append(spark.createDataFrame([("late", 9)], "k string, v long"))
            return folder

    with pytest.raises(Conflict):
        Late(spark, str(tmp_path), "k string, v long", "k", buckets=2).compact()
    assert ("late", 9) in told(logs[0].read()) and len(told(logs[0].read())) == 5 and len(list((tmp_path / "parts").iterdir())) == 5


def test_broken_writes_and_empty_logs(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), "k string, v long", "k")
    assert log.read().count() == log.lookup(spark.createDataFrame([("a",)], "k string")).count() == 0 == len(log.deltas())
    log.compact()
    log.append(spark.createDataFrame([("a", 1), (None, 2)], "k string, v long"))
    (tmp_path / "log/commits/000000000002").write_text('{"folder": "/now')  # cut off
    (tmp_path / "log/parts/nobody").mkdir()
    log.append(spark.createDataFrame([("a", 3)], "k string, v long"))
    log.append(spark.createDataFrame([], "k string, v long"))
    assert [d.number for d in log.deltas()] == [1, 3, 4] and told(log.read()) == [("a", 3)] == told(log.lookup(spark.createDataFrame([("a",)], "k string")))


def test_filters_hold_every_key_and_few_others(spark):
    h = spark.range(20_000).select(F.xxhash64("id")).toArrow().column(0).to_numpy()
    bits = filter_of(h[:10_000])
    assert all(any_within(h[i : i + 1], bits) for i in range(0, 10_000, 37))
    assert sum(any_within(h[i : i + 1], bits) for i in range(10_000, 20_000)) < 50
