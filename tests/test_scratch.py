"""Tables in the shared folder: each call deletes its own, whatever else runs."""

import threading

import pytest

from gleaner.plans import catalogue
from gleaner.sources import scratch
from gleaner.streaming import arrivals

DATA = "/root/testdata/sf0.001"


def test_settled_leaves_other_threads_tables(spark):
    inside, go = threading.Event(), threading.Event()

    def make():
        own = scratch.written(spark.range(3), "own")
        inside.set()
        assert go.wait(60)
        return own.where("id > 0")

    out, kept = {}, {}
    work = threading.Thread(target=lambda: out.update(t=scratch.settled(make, "thread")))
    work.start()
    assert inside.wait(60)
    kept["before"] = scratch.written(spark.range(5), "main")
    go.set()
    work.join()
    assert kept["before"].count() == 5 and out["t"].count() == 2


def test_settled_within_settled(spark):
    seen = []

    def inner():
        seen.append(scratch.written(spark.range(2), "inner"))
        return seen[-1]

    def outer():
        seen.append(scratch.written(spark.range(4), "outer"))
        seen.append(scratch.settled(inner, "middle"))
        assert seen[0].count() == 4
        return seen[2].union(seen[0])

    out = scratch.settled(outer, "all")
    assert out.count() == 6
    left = [scratch._PATH[x] in scratch._LEFT for x in (*seen, out)]
    assert left == [False, False, False, True]
    scratch.forget(out, spark.range(1))
    assert scratch._PATH[out] not in scratch._LEFT


def test_a_failed_call_leaves_nothing(spark):
    made = []

    def make():
        made.append(scratch._PATH[scratch.written(spark.range(2), "failed")])
        raise ValueError

    with pytest.raises(ValueError):
        scratch.settled(make, "none")
    assert made[0] not in scratch._LEFT


def test_two_queries_and_a_stream_at_once(spark, tmp_path):
    spark.createDataFrame([(f"/{i}", 1, i, bytearray(b"x" if i % 2 else b"y")) for i in range(40)], arrivals.FILES).repartition(4).write.parquet(f"{tmp_path}/in")
    want = {n: catalogue.QUERIES[n](spark, DATA).count() for n in ("exact_duplicates", "clusters")}
    got, failed = {}, []

    def run(name):
        try:
            got[name] = catalogue.QUERIES[name](spark, DATA).count()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    work = [threading.Thread(target=run, args=(n,)) for n in want]
    stream = arrivals.watch(spark.readStream.schema(arrivals.FILES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/found", f"{tmp_path}/check")
    for t in work:
        t.start()
    for t in work:
        t.join()
    stream.awaitTermination()
    assert not failed and got == want
    assert 30 <= spark.read.parquet(f"{tmp_path}/found").count() <= 38
