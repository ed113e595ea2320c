"""Whole runs over real files: duplicates with a store, similar media with stand-in programs, the organizer with its state."""

import json
import os

import pytest

from gleaner import cli
from gleaner.operators import organizer
from gleaner.plans.duplicates import Duplicates
from gleaner.plans.library import Organizer, Progress
from gleaner.sources.options import DuplicateOptions, OrganizerOptions


def put(root, **files):
    for i, (name, data) in enumerate(files.items()):
        path = root / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        os.utime(path, (1000 + i, 1000 + i))


def test_duplicates_are_moved_and_the_second_run_reads_the_store(spark, tmp_path):
    big = b"a" * 70_000
    put(tmp_path, in__one_bin=big, in__two_bin=big, in__sub__three_bin=big[:-1] + b"b", in__four_bin=b"x", in__five_bin=b"", in__six_bin=b"")
    o = DuplicateOptions(dup_dir=str(tmp_path / "dups"), mode="exact", cache_db=str(tmp_path / "store"))
    d = Duplicates(spark, o)
    kept = d.walk_many([str(tmp_path / "in"), str(tmp_path / "in"), str(tmp_path / "none")])
    base = str(tmp_path / "in")
    assert [(r["source"], r["kept"]) for r in d.duplicates_moved] == [(f"{base}/six.bin", f"{base}/five.bin"), (f"{base}/two.bin", f"{base}/one.bin")]
    assert d.dup_count == 2 and os.path.exists(f"{tmp_path}/dups{base}/two.bin") and not os.path.exists(f"{base}/two.bin")
    assert kept == {"70000": [f"{base}/one.bin", f"{base}/sub/three.bin"], "0": [f"{base}/five.bin"], "1": [f"{base}/four.bin"]}
    s = d.stats
    assert s.files_scanned == 6 and s.bytes_read_exact == 3 * 2 * 65536 + 2 * 70_000 and s.bytes_read_verify == 140_000
    assert s.cache_hits == 0 and s.cache_misses == 9 and set(s.timings_by_stage) == {"scan", "cache_open", "exact", "media", "cache_finalize"}
    again = Duplicates(spark, o)
    again.run([base])
    assert again.stats.cache_hits == 2 and again.stats.cache_misses == 0 and again.stats.cache_hit_ratio == 1.0 and again.dup_count == 0
    empty = Duplicates(spark, o, no_cache=True)
    assert empty.run([str(tmp_path / "none")]).files_scanned == 0 and empty.data == {} and empty.results["duplicates_moved"] == []
    with pytest.raises(TypeError):
        d.walk_many("in")


@pytest.fixture
def programs(tmp_path):
    """A probe that tells one size, and a frame that follows from the file's first byte."""
    scripts = {
        "probe": 'echo \'{"streams":[{"width":640,"height":480}],"format":{"duration":"10"}}\'',
        "mpeg": 'while [ "$1" != "-i" ]; do shift; done\necho run >> "$(dirname "$0")/calls"\nhead -c 1 "$2" | od -An -tu1 | awk \'{for (i = 0; i < 72; i++) printf "%c", (i == $1 - 60) ? 99 : 50}\'',
    }
    for name, body in scripts.items():
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(0o755)
    return str(tmp_path / "probe"), str(tmp_path / "mpeg")


def test_similar_media_in_the_report(spark, tmp_path, programs):
    put(tmp_path, in__a_jpg=b"c1", in__b_png=b"d22", in__c_mp4=b"e333", in__d_mkv=b"f4444", in__e_jpg=b"c55555")
    report = tmp_path / "out/similar.json"
    args = ["-a", str(tmp_path / "dups"), "--cache", str(tmp_path / "store"), "--ffprobe", programs[0], "--ffmpeg", programs[1], "--report-similar", str(report), str(tmp_path / "in")]
    for _ in range(2):
        assert cli.main(args) == 0
        found = json.loads(report.read_text())
        base = str(tmp_path / "in")
        assert [c["paths"] for c in found] == [[f"{base}/{n}" for n in ("a.jpg", "b.png", "e.jpg")], [f"{base}/c.mp4", f"{base}/d.mkv"]]
        first = found[0]["score_summary"]
        assert first["kind"] == "image" and first["pairs"] == 3 and first["min"] == 0 and 0 < first["max"] <= 8 and found[0]["cluster_id"] == "media-1"
        assert len((tmp_path / "calls").read_text().split()) == 3 + 2 * 4  # the second run probes nothing
    assert cli.main([*args[:4], "--ffprobe", "/nowhere/x", "--ffmpeg", programs[1], "--no-cache", str(tmp_path / "in")]) == 0


def test_organizer_moves_once_and_knows_its_work(spark, tmp_path):
    put(tmp_path, in__My_Show_S01E02_1080p_mkv=b"1", in__sub__My_Show_s01e02_480p_mkv=b"22", in__What_mkv=b"333", in__sub__What_mkv=b"4444", in__note_txt=b"5")
    target, state = tmp_path / "in/organized", str(tmp_path / "state")
    make = lambda dry: Organizer(spark, [str(tmp_path / "in")], str(target), OrganizerOptions(), state, dry_run=dry)
    dry = make(True).run()
    assert dry["total"] == dry["processed"] == 4 and dry["moved"] == 0 and not target.exists() and not os.path.exists(state)
    told = []
    report = make(False).run(told.append)
    assert report["operations"] == dry["operations"] and report["moved"] == 4 and [t["processed"] for t in told] == [1, 2, 3, 4]
    names = sorted(os.path.relpath(os.path.join(r, f), target) for r, _, fs in os.walk(target) for f in fs)
    assert names == ["Duplicates/My.Show.s01e02.480p.mkv", "Duplicates/What.mkv", "TV/My Show/Season 01/My Show - S01E02.mkv", "Unsorted/What.mkv"]
    assert make(False).run()["total"] == 0
    put(tmp_path, in__What_mkv=b"new")
    assert [o["destination"] for o in make(False).run()["operations"]] == [str(target / "Unsorted/What (2).mkv")]
    # A file that comes back as it was, its copy in place: nothing to do.
    put(tmp_path, in__What_mkv=b"new")
    back = make(False).run(told.append)
    assert back["operations"] == [] and back["processed"] == 1 and told[-1]["status"] == "already-current"
    stopped = make(False)
    (tmp_path / "in/Other.mkv").write_bytes(b"o")
    stopped.pause()
    stopped.stop()
    assert stopped.run()["stopped"] and (tmp_path / "in/Other.mkv").exists()
    told = Progress(7, iter([0.0, 1.0, 2.0]).__next__)
    assert told.told("/s", "/d", "planned")["eta_seconds"] == 7.0
    told.processed = 4
    assert told.told("/s", "/d", "planned") == {"processed": 4, "total": 7, "moved": 0, "status": "planned", "source": "/s", "destination": "/d", "throughput": 2.0, "eta_seconds": 1.5}


def test_versions_skip_taken_names(spark):
    rows = [("/s1", "k1", "/t/X.mkv"), ("/s2", "k2", "/t/X.mkv"), ("/s3", "k3", "/t/X (2).mkv"), ("/s4", "k4", "/t/Y.MKV")]
    df = spark.createDataFrame(rows, "source string, dedupe_key string, base string")
    taken = spark.createDataFrame([("/t/X.mkv",), ("/t/X (4).mkv",), ("/t/Y.MKV",), ("/t/Y (2).MKV",)], "path string")
    got = {r.source: r.destination for r in organizer.versioned(df, taken).collect()}
    assert got == {"/s1": "/t/X (5).mkv", "/s2": "/t/X (3).mkv", "/s3": "/t/X (2).mkv", "/s4": "/t/Y (3).MKV"}


def test_command_line_errors(tmp_path):
    for bad in ([], ["/no/such/folder"], ["--config", "/no/such/file", str(tmp_path)], ["--hash-workers", "0", str(tmp_path)], ["--mode", "other", str(tmp_path)]):
        with pytest.raises(SystemExit):
            cli.main(bad)
