"""Files that arrive in batches."""

from gleaner.streaming import arrivals


def test_batches_are_held_against_all_earlier_ones(spark, tmp_path):
    put = lambda rows: spark.createDataFrame([(p, len(c), t, bytearray(c)) for p, t, c in rows], arrivals.FILES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(arrivals.FILES).parquet(f"{tmp_path}/in")
        arrivals.watch(stream, f"{tmp_path}/store", f"{tmp_path}/found", f"{tmp_path}/check").awaitTermination()
        return {(r.source, r.kept, r.destination) for r in spark.read.parquet(f"{tmp_path}/found").collect()}

    put([("/a", 5, b"x"), ("/b", 4, b"x"), ("/c", 1, b"y")])
    assert run() == {("/a", "/b", "/dups/a")}
    put([("/d", 9, b"y"), ("/e", 1, b"new"), ("/c", 7, b"z")])  # /c has changed: it no longer holds y
    put([("/f", 2, b"new")])
    assert run() == {("/a", "/b", "/dups/a"), ("/f", "/e", "/dups/f")}
    assert run() == {("/a", "/b", "/dups/a"), ("/f", "/e", "/dups/f")}
    got = {r.path: (r.size, r.mtime_ns) for r in arrivals.signatures(spark, f"{tmp_path}/store").collect()}
    assert got == {"/a": (1, 5), "/b": (1, 4), "/c": (1, 7), "/d": (1, 9), "/e": (3, 1), "/f": (3, 2)}
    # A batch that runs again sees what it saw: not its own signatures.
    assert "/f" not in {r.path for r in arrivals.signatures(spark, f"{tmp_path}/store", 1).collect()}


def test_no_files(spark):
    none = spark.createDataFrame([], arrivals.FILES)
    signed, found = arrivals.arrived(none, spark.createDataFrame([], arrivals.SIGNATURES), "/dups")
    assert signed.count() == found.count() == 0
