"""The stream with its memory in state finds what the stream with a log of signatures finds."""

import random

from pyspark.sql import functions as F

from gleaner.streaming import arrivals, holders


def test_same_duplicates_as_by_the_log_after_restarts(spark, tmp_path):
    rnd = random.Random(4)
    put = lambda rows: spark.createDataFrame([(p, len(c), t, bytearray(c)) for p, t, c in rows], arrivals.FILES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batches = [
        [("/a", 5, b"x"), ("/b", 4, b"x"), ("/c", 1, b"y")],
        [("/d", 9, b"y"), ("/e", 1, b"new"), ("/c", 7, b"z")],  # /c has changed: it no longer holds y
        [("/f", 2, b"new"), ("/b", 9, b"x"), ("/g", 6, b"x")],  # /b holds the same, but is newer now
        [("/a", 5, b"gone"), ("/h", 8, b"x"), ("/h", 7, b"other")],  # the first holder of x goes; the later of two counts
        *[[(f"/{rnd.randrange(12)}", rnd.randrange(20), bytes([65 + rnd.randrange(3)])) for _ in range(6)] for _ in range(3)],
    ]
    for rows in batches:
        put(rows)
        stream = lambda: spark.readStream.schema(arrivals.FILES).parquet(f"{tmp_path}/in")
        before = spark.conf.get(holders.PROVIDER, None)
        holders.watch(stream(), f"{tmp_path}/found", f"{tmp_path}/check").awaitTermination()
        assert spark.conf.get(holders.PROVIDER, None) == before
        arrivals.watch(stream(), f"{tmp_path}/store", f"{tmp_path}/by_log", f"{tmp_path}/check_log").awaitTermination()
        columns = ["source", "kept", "destination"]
        got, want = (sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{f}").select(*columns).collect())) for f in ("found", "by_log"))
        assert got == want
    assert ("/a", "/b", "/dups/a") in got and ("/f", "/e", "/dups/f") in got and all(r[0] != "/d" for r in got)


def test_an_unreadable_store_is_no_empty_one(spark, tmp_path):
    import pytest

    (tmp_path / "store/batch=0").mkdir(parents=True)
    (tmp_path / "store/batch=0/part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="parquet|Parquet|PARQUET"):
        arrivals.signatures(spark, str(tmp_path / "store")).where(F.col("path") != "").collect()
    assert arrivals.signatures(spark, str(tmp_path / "none")).count() == 0
