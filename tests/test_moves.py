"""Comparison of large files in parts, and moves by components of shared paths."""

import os
import random
import shutil

import pytest

from gleaner.operators import moves


def plain(a, b, chunk):
    """Two files held side by side, piece by piece, until one differs."""
    x, y, at = open(a, "rb").read(), open(b, "rb").read(), 0
    while True:
        p, q = x[at : at + chunk], y[at : at + chunk]
        if p != q or not p:
            return p == q, min(at + chunk, len(x)) + min(at + chunk, len(y))
        at += chunk


def test_parts_say_what_the_whole_comparison_says(spark, tmp_path):
    part, chunk = 2 << 20, 1 << 20
    base = os.urandom(5 * chunk + 123)
    flip = lambda at: base[:at] + bytes([base[at] ^ 1]) + base[at + 1 :]
    others = {"same": base, "first": flip(0), "middle": flip(2 * chunk + 5), "last": flip(len(base) - 1), "two": flip(chunk)[: 3 * chunk] + flip(4 * chunk)[3 * chunk :], "shorter": base[:-1], "longer": base + b"x",
              "cut": base[: 2 * chunk], "empty": b""}
    (tmp_path / "base").write_bytes(base)
    for name, data in others.items():
        (tmp_path / name).write_bytes(data)
    pairs = [(str(tmp_path / n), str(tmp_path / "base")) for n in others] + [(str(tmp_path / "empty"), str(tmp_path / "empty")), (str(tmp_path / "none"), str(tmp_path / "base"))]
    got = {(r.source, r.kept): (r.equal, r.bytes_read) for r in moves.compared_in_parts(spark.createDataFrame(pairs, "source string, kept string"), part // chunk).collect()}
    assert len(got) == len(pairs) and got[pairs[-1]] == (None, None)
    for a, b in pairs[:-1]:
        assert got[a, b] == moves.compared(a, b) == plain(a, b, chunk)


def test_large_files_are_compared_in_parts_before_they_move(spark, tmp_path):
    for name, data in (("a", b"x" * 3_000_000), ("b", b"x" * 3_000_000), ("c", b"x" * 2_999_999 + b"y"), ("d", b"small"), ("e", b"small")):
        (tmp_path / name).write_bytes(data)
    p = lambda n: str(tmp_path / n)
    rows = [(p("b"), p("to/b"), p("a"), 3_000_000), (p("c"), p("to/c"), p("a"), 3_000_000), (p("e"), p("to/e"), p("d"), 5)]
    done = moves.spread_moves(spark.createDataFrame(rows, "source string, destination string, kept string, size long"), large=1_000_000)
    assert {os.path.basename(r.source): (r.status, r.bytes_read) for r in done.collect()} == {"b": ("moved", 6_000_000), "c": ("differs", 6_000_000), "e": ("moved", 10)}
    assert moves.carried_out(p("c"), p("to/c"), p("a"), (True, 1, "stale")) == ("differs", 6_000_000)


@pytest.mark.parametrize("seed", range(3))
def test_clashing_chains_end_as_in_order(spark, tmp_path, seed):
    rnd = random.Random(seed)
    names = [f"f{i}" for i in range(40)]
    rows = []
    for i in range(60):  # sources that are others' destinations, several to one destination, some to themselves
        source, destination = rnd.choice(names), rnd.choice(names + [f"new{i}"] * 20)
        rows.append((source, destination, rnd.choice("abc")))
    rows = list({r[:2]: r for r in rows}.values())
    for side in ("serial", "spread"):
        (tmp_path / side).mkdir()
        for n in names[:25]:
            (tmp_path / side / n).write_text(n)
    table = lambda side: spark.createDataFrame([(f"{tmp_path}/{side}/{a}", f"{tmp_path}/{side}/{b}", k, None) for a, b, k in rows], "source string, destination string, dedupe_key string, source_hash string")
    serial = {(os.path.basename(r["source"]), os.path.basename(r["destination"])): r["status"] for r in moves.apply_moves(table("serial").select("source", "destination", "dedupe_key"), order=("dedupe_key", "source", "destination"))}
    done = moves.ordered_moves(table("spread"), ("dedupe_key", "source", "destination"))
    assert {(os.path.basename(r.source), os.path.basename(r.destination)): r.status for r in done.collect()} == serial
    held = [{n: (tmp_path / side / n).read_text() for n in os.listdir(tmp_path / side)} for side in ("serial", "spread")]
    assert held[0] == held[1] and len(set(serial.values())) > 1
    shutil.rmtree(tmp_path / "spread")


def test_moves_without_shared_paths_and_second_attempts(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "to").mkdir()
    (tmp_path / "to/b").write_text("y")
    digest = moves.sha256(str(tmp_path / "to/b"))
    rows = [(f"{tmp_path}/a", f"{tmp_path}/to/a", "k", None), (f"{tmp_path}/b", f"{tmp_path}/to/b", "k", digest), (f"{tmp_path}/c", f"{tmp_path}/to/c", "k", digest)]
    plan = spark.createDataFrame(rows, "source string, destination string, dedupe_key string, source_hash string")
    assert {r.status for r in moves.ordered_moves(plan, dry_run=True).collect()} == {"planned"}
    assert [r.status for r in moves.ordered_moves(plan).orderBy("source").collect()] == ["moved", "moved", "missing"]
