"""Real files: the inventory source, digests, and names."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gleaner.functions.digest import full_blake2b, quick_blake2b, quick_of_file
from gleaner.functions.text import safe_title, split_extension, suffix
from gleaner.operators import exact, organizer, perceptual, store
from gleaner.sources.inventory import scan


def test_scan_lists_each_regular_file_once(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.JPG").write_bytes(b"1")
    (tmp_path / "a/empty").write_bytes(b"")
    (tmp_path / "dups").mkdir()
    (tmp_path / "dups/y").write_bytes(b"2")
    os.symlink(tmp_path / "a/empty", tmp_path / "a/link")
    got = {(os.path.relpath(r.path, tmp_path), r.size, r.kind) for r in scan(spark, [str(tmp_path), str(tmp_path / "a"), "/nowhere"], exclude=str(tmp_path / "dups")).collect()}
    assert got == {("a/b/x.JPG", 1, "image"), ("a/empty", 0, "other")}


def test_blake2b_of_samples_and_of_all(spark):
    data = bytes(range(256)) * 2
    df = spark.createDataFrame([(bytearray(data), len(data)), (bytearray(b"abc"), 3)], "content binary, size long")
    got = df.select(quick_blake2b(F.col("content"), F.col("size"), 64).alias("q"), full_blake2b(F.col("content")).alias("f")).collect()
    assert got[0].q == hashlib.blake2b(data[:64] + data[256:320] + data[-64:], digest_size=16).hexdigest()
    assert got[1].q == hashlib.blake2b(b"abc", digest_size=16).hexdigest()
    assert got[0].f == hashlib.blake2b(data, digest_size=32).hexdigest()


def test_extensions_and_titles(spark):
    df = spark.createDataFrame([("/a/foo.",), ("/a/.mp4",), ("/a/..mp4",), ("/a/x.mkv.",), ("/a/X.MKV",)], "p string")
    got = {r.p: (r.a, r.b) for r in df.select("p", split_extension(F.col("p")).alias("a"), suffix(F.col("p")).alias("b")).collect()}
    assert got["/a/foo."] == (".", "") and got["/a/.mp4"] == ("", "") and got["/a/X.MKV"] == (".mkv", ".mkv") and got["/a/..mp4"] == ("", ".mp4")
    titles = spark.createDataFrame([("What?",), (" a  b ",), ("?",)], "t string").select(safe_title(F.col("t"))).collect()
    assert [t[0] for t in titles] == ["What", "a b", "Unknown"]


def test_oldest_then_first_path_is_kept(spark):
    files = spark.createDataFrame([("/b", 1, 5, bytearray(b"x")), ("/a", 1, 5, bytearray(b"x")), ("/c", 1, 9, bytearray(b"x")), ("/d", 1, 1, bytearray(b"y"))], "path string, size long, mtime_ns long, content binary")
    got = {(r.source, r.kept, r.destination) for r in exact.duplicates(exact.signatures(files)).collect()}
    assert got == {("/b", "/a", "/dups/b"), ("/c", "/a", "/dups/c")}


def test_pairs_need_one_prefix_and_clusters_are_transitive(spark):
    h = 0x0F0F << 40
    rows = [("/1", h, 640, 480), ("/2", h ^ 0x0F, 640, 480), ("/3", h ^ 0xFF, 640, 480), ("/4", h ^ -(1 << 63), 640, 480)]
    df = spark.createDataFrame(rows, "path string, h long, width int, height int")
    found = perceptual.image_links(df, 4)[1]
    assert {(r.a, r.b, r.score) for r in found.collect()} == {("/1", "/2", 4), ("/2", "/3", 4)}
    found, members = perceptual.image_clusters(df, 4)
    assert [(x.first_path, x.n_paths, x.pairs, x.min_score, x.max_score) for x in found.collect()] == [("/1", 3, 2, 4, 4)]
    assert sorted(map(tuple, members.collect())) == [("/1", "/1"), ("/1", "/2"), ("/1", "/3")]


def test_merge_replaces_signatures_of_changed_files(spark):
    old = spark.createDataFrame([("/a", 1, 1, 1, 1, "q", "f", None, None, "r1"), ("/b", 1, 1, 1, 1, "q", "f", None, None, "r1")], store.SCHEMA)
    fresh = old.drop("last_seen_run").withColumn("quick_hash", F.lit(None).cast("string")).withColumn("mtime_ns", F.when(F.col("path") == "/a", 2).otherwise(1).cast("long"))
    got = {r.path: (r.quick_hash, r.full_hash, r.last_seen_run) for r in store.merge(old, fresh, "r2").collect()}
    assert got == {"/a": (None, "f", "r2"), "/b": ("q", "f", "r2")}


def test_show_and_movie_names(spark):
    names = spark.createDataFrame([("/x/My.Show.S01E02.1080p.mkv", 5), ("/x/Movie.Title.(2021).720p.mkv", 4), ("/x/Movie.Title.(2021).2160p.mkv", 3), ("/x/n.txt", 1)], "source string, size long")
    planned = {r.source: (r.destination, r.status) for r in organizer.plan(organizer.parse(names), "/lib").collect()}
    assert planned["/x/My.Show.S01E02.1080p.mkv"] == ("/lib/TV/My Show/Season 01/My Show - S01E02.mkv", "organized")
    assert planned["/x/Movie.Title.(2021).2160p.mkv"] == ("/lib/Movies/Movie Title (2021)/Movie Title (2021).mkv", "organized")
    assert planned["/x/Movie.Title.(2021).720p.mkv"][1] == "duplicate" and len(planned) == 3


def test_names_that_only_look_like_shows_and_movies(spark):
    names = ["Show.S1E2.mkv", "(2021).mkv", " S01E02.mkv", "  S01E02.mkv", "A\tS01E02.mkv", "_._ S01E02.mkv", "Unknown - S01E02.mkv", "A S012E03.mkv"]
    df = spark.createDataFrame([(f"/x/{n}", 1) for n in names], "source string, size long")
    got = {r.source[3:]: (r.title, r.season, r.year, r.dedupe_key) for r in organizer.parse(df).collect()}
    assert got["Show.S1E2.mkv"] == ("Show S1E2", None, None, "unknown:show s1e2") and got["(2021).mkv"] == ("(2021)", None, None, "unknown:(2021)")
    assert got[" S01E02.mkv"][1] is None and got["A\tS01E02.mkv"][1] is None and got["A S012E03.mkv"][1] is None
    assert got["  S01E02.mkv"] == got["_._ S01E02.mkv"] == ("", 1, None, "show:|s01e02") and got["Unknown - S01E02.mkv"][3] == "show:unknown|s01e02"
    places = {r.source[3:]: r.destination for r in organizer.plan(organizer.parse(df), "/lib").collect()}
    # Two keys, one name: "show:unknown" comes before "show:|".
    assert places["Unknown - S01E02.mkv"] == "/lib/TV/Unknown/Season 01/Unknown - S01E02.mkv"
    assert places["  S01E02.mkv"] == "/lib/TV/Unknown/Season 01/Unknown - S01E02 (2).mkv" and places["_._ S01E02.mkv"].startswith("/lib/Duplicates/")


def test_collided_digests_move_nothing(spark):
    rows = [("/a", 1, 1, "q", "f", "x"), ("/b", 1, 2, "q", "f", "y"), ("/c", 1, 3, "q", "f", "x")]
    signed = spark.createDataFrame(rows, "path string, size long, mtime_ns long, quick string, full string, check string")
    assert [(r.source, r.kept) for r in exact.duplicates(signed).collect()] == [("/c", "/a")]


def test_stages_give_the_same_beyond_their_broadcasts(spark):
    texts = ["a" * 300, "a" * 300, "b" * 299 + "c", "c" * 300, "d" * 100 + "e" + "d" * 199, "d" * 100 + "f" + "d" * 199, "lone"]
    files = spark.createDataFrame([(f"/{i}", len(t), i, bytearray(t.encode())) for i, t in enumerate(texts)], "path string, size long, mtime_ns long, content binary")
    for few in (200_000, 0):
        quick = exact.quick_signatures(files, 16, few)
        assert {r.path for r in quick.collect()} == {f"/{i}" for i in range(6)}
        full = exact.full_signatures(files, quick, few)
        assert {r.path for r in full.collect()} == {"/0", "/1", "/4", "/5"}
        assert [(r.source, r.kept) for r in exact.duplicates(full).collect()] == [("/1", "/0")]
    told = exact.statistics(files, quick, full, 16).first().asDict()
    assert told == {"files_scanned": 7, "size_candidates": 6, "quick_candidates": 4, "full_candidates": 2, "moved": 1, "bytes_read_exact": 6 * 48 + 4 * 300, "bytes_read_verify": 600}


def test_helpers_of_the_package(spark, tmp_path):
    import gleaner

    data = bytes(range(256)) * 3
    (tmp_path / "f").write_bytes(data)
    assert gleaner.get_hash_key(data) == gleaner.process_file(str(tmp_path / "f"), 768) == hashlib.blake2b(data, digest_size=16).hexdigest()
    assert gleaner.process_file(str(tmp_path / "f"), 64) == gleaner.get_hash_key(data[:64] + data[384:448] + data[-64:])
    row = spark.createDataFrame([(str(tmp_path / "f"), len(data))], "p string, n long").select(quick_of_file(F.col("p"), F.col("n"), 64)).first()
    assert row[0] == gleaner.process_file(str(tmp_path / "f"), 64)
    for bad, error in ((lambda: gleaner.get_hash_key("text"), TypeError), (lambda: gleaner.process_file(str(tmp_path / "f"), 0), ValueError)):
        with pytest.raises(error):
            bad()
    assert gleaner.Duplicates.__name__ == "Duplicates" and set(gleaner.__all__) >= {"Duplicates", "Organizer"}


def test_deep_folders_are_many_partitions(spark, tmp_path, caplog):
    from gleaner.sources.inventory import InventoryReader

    for i in range(20):
        (tmp_path / f"a/b/{i:02}/c").mkdir(parents=True)
        (tmp_path / f"a/b/{i:02}/c/f").write_bytes(b"x" * i)
    reader = InventoryReader({"roots": f"{tmp_path}\x00/nowhere"})
    parts = reader.partitions()
    assert len(parts) == 1 + 1 + 1 + 20 + 20 and len({p.path for p in parts}) == len(parts)
    assert sorted(r[1] for p in parts for r in reader.read(p)) == list(range(20))
    assert scan(spark, [str(tmp_path)]).count() == 20


def test_prune_by_roots(spark):
    row = lambda path, run: (path, 1, 1, 1, 1, "q", None, None, None, run)
    df = spark.createDataFrame([row("/a/x", "r1"), ("/a/y", 1, 1, 1, 1, "q", None, None, None, "r2"), row("/ab/x", "r1"), row("/b", "r1")], store.SCHEMA)
    assert {r.path for r in store.prune(df, "r2").collect()} == {"/a/y"}
    assert {r.path for r in store.prune(df, "r2", ["/a/", "/b"]).collect()} == {"/a/y", "/ab/x"}


def test_one_name_of_hard_links(spark):
    df = spark.createDataFrame([("/b", 1, 7), ("/a", 1, 7), ("/c", 1, 8)], "path string, dev long, ino long")
    assert {r.path for r in exact.one_name(df).collect()} == {"/a", "/c"}


def test_frames_of_other_shapes(spark):
    data = bytes([5, 3, 9, 9, 1, 2])
    df = spark.createDataFrame([(bytearray(b"zz" + data),)], "c binary")
    assert df.select(perceptual.dhash(F.col("c"), 2, 3, 2)).first()[0] == 0b1010
    with pytest.raises(Exception, match="not enough pixels"):
        df.select(perceptual.dhash(F.col("c"), 3, 3, 2)).collect()
    with pytest.raises(ValueError):
        perceptual.dhash(F.col("c"), 0, 10, 8)


def test_pairs_of_a_common_frame_are_counted_not_written(spark):
    rows = [(f"/{i:03}", 7 if i else 6, 640, 480) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, h long, width int, height int")
    classes, links, members = perceptual.image_links(df)
    assert sorted((r.rep, r.n) for r in classes.collect()) == [("/000", 1), ("/001", 199)] and members.count() == 200
    assert [(r.pairs, r.score) for r in links.collect()] == [(199, 1)]
    told = perceptual.image_clusters(df)[0].first()
    assert (told.n_paths, told.pairs, told.min_score, told.max_score) == (200, 200 * 199 // 2, 0, 1)
