"""Moves, reports, options and media probing on real files; the probing programs are small scripts."""

import json
import os

import pytest

from gleaner.operators.moves import apply_moves, move, write_report
from gleaner.sources import media, options


def test_moves_never_overwrite_and_hold_contents_against_the_kept_file(spark, tmp_path):
    for name, data in (("a", "x"), ("b", "x"), ("c", "changed"), ("d", "x")):
        (tmp_path / name).write_text(data)
    (tmp_path / "taken").write_text("own")
    p = lambda n: str(tmp_path / n)
    rows = [(p("b"), p("dups/b"), p("a")), (p("c"), p("dups/c"), p("a")), (p("d"), p("taken"), p("a")), (p("e"), p("dups/e"), p("a"))]
    plan = spark.createDataFrame(rows, "source string, destination string, kept string")
    assert {r["status"] for r in apply_moves(plan, dry_run=True)} == {"planned"} and os.path.exists(p("b"))
    assert list(apply_moves(plan, proceed=lambda: False)) == []
    assert [r["status"] for r in apply_moves(plan)] == ["moved", "differs", "conflict", "missing"]
    assert not os.path.exists(p("b")) and (tmp_path / "dups/b").read_text() == "x" and (tmp_path / "taken").read_text() == "own"


def test_move_by_copy_where_links_fail(tmp_path, monkeypatch):
    (tmp_path / "a").write_text("x")

    def refuse(*_, **__):
        raise OSError("another filesystem")

    monkeypatch.setattr(os, "link", refuse)
    move(str(tmp_path / "a"), str(tmp_path / "to/a"))
    assert (tmp_path / "to/a").read_text() == "x" and os.listdir(tmp_path) == ["to"] and os.listdir(tmp_path / "to") == ["a"]
    (tmp_path / "b").write_text("y")
    with pytest.raises(FileExistsError):
        move(str(tmp_path / "b"), str(tmp_path / "to/a"))
    assert (tmp_path / "b").exists() and os.listdir(tmp_path / "to") == ["a"]


def test_report(tmp_path):
    write_report([{"b": 1, "a": 2}], str(tmp_path / "deep/r.json"))
    assert (tmp_path / "deep/r.json").read_text() == json.dumps([{"a": 2, "b": 1}], indent=2) + "\n"


def test_options(tmp_path):
    (tmp_path / "c").write_text("[global]\nmode:exact\nhash_workers:8\n[media]\nenabled:no\nimage_hamming_threshold:3\n")
    got = options.duplicate_options(str(tmp_path / "c"))
    assert (got.mode, got.enabled, got.image_hamming_threshold, got.video_hamming_threshold) == ("exact", False, 3, 32)
    (tmp_path / "bad").write_text("[media]\nduration_bucket_seconds:0\n")
    (tmp_path / "word").write_text("[media]\nenabled:perhaps\n")
    for name in ("bad", "word", "none"):
        with pytest.raises(ValueError):
            options.duplicate_options(str(tmp_path / name))
    options.write_organizer_options(str(tmp_path / "o"))
    assert options.organizer_options(str(tmp_path / "o")) == options.organizer_options("/nowhere") == options.OrganizerOptions()
    (tmp_path / "o").write_text("# c\ndry_run: off\nduplicates_dir_name: 'Twice'\n")
    assert options.organizer_options(str(tmp_path / "o")) == options.OrganizerOptions(duplicates_dir_name="Twice", dry_run=False)


def test_probing(spark, tmp_path):
    for name, body in (("probe", 'case "$*" in *bad*) exit 1;; *bare*) echo "{}"; exit;; esac\necho \'{"streams":[{"width":640,"height":480}],"format":{"duration":"10"}}\''), ("mpeg", 'printf "%080d" 7')):
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(0o755)
    files = spark.createDataFrame([("/v", "video"), ("/i", "image"), ("/bad", "image"), ("/bare", "image"), ("/t", "other")], "path string, kind string")
    found = {r.path: r for r in media.probed(files, media.tool("ffprobe", str(tmp_path / "probe")), str(tmp_path / "mpeg")).collect()}
    assert set(found) == {"/v", "/i", "/bare"} and (found["/bare"].width, found["/bare"].duration) == (0, 0.0) and found["/v"].duration == 10.0 and found["/i"].width == 640
    assert [len(f) for f in found["/v"].frames] == [72] * 4 and len(found["/i"].frames) == 1
    assert media.tool("no-such-program") is None and media.tool("ffprobe", "/nowhere/x") is None
