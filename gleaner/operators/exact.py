"""Exact duplicates: groups by size, sampled digest and full digest, a canonical copy of each, and a move plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import sample_offsets, samples
from ..functions.text import mirrored
from ..sources.scratch import written
from .joins import lookup

SAMPLE, FEW = 65536, 200_000


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur more than once. Keys are counted before the shuffle, and a common one burdens no task."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return lookup(rows, written(again, "repeated"), list(keys)).select(*rows.columns)


def quick_signatures(files: DataFrame, sample: int = SAMPLE, few: int = FEW) -> DataFrame:
    """``(path, size, mtime_ns, quick)`` of the ``files(path, size, mtime_ns, content)`` whose size occurs more than once.

    Sizes are read alone first. Samples are digested where their row is read: a content never goes through a shuffle,
    so that beyond ``few`` repeated sizes every row is digested and the digests are what is held against the sizes.
    """
    sizes = written(files.groupBy("size").agg(F.count("*").alias("_n")).where("_n > 1").select("size"), "sizes")
    known, short = files.select("path", "size", "mtime_ns", "content"), sizes.count() <= few
    if short:
        known = known.join(F.broadcast(sizes), "size", "left_semi")
    quick = known.select("path", "size", "mtime_ns", F.sha2(samples(F.col("content"), F.col("size"), sample), 256).alias("quick"))
    quick = written(quick, "quick")
    return quick if short else written(lookup(quick, sizes, ["size"]).select(*quick.columns), "quick")


def full_signatures(files: DataFrame, quick: DataFrame, few: int = FEW) -> DataFrame:
    """Rows of ``quick`` whose size and sampled digest occur more than once, with full and check: digests of the whole content.

    ``full`` (SHA-256) groups them and ``check`` (SHA-512) stands for their bytes. Up to ``few`` such rows, only their contents are
    digested; beyond that those of all files, where they are read, and again only digests are joined.
    """
    candidates = written(repeated(quick, "size", "quick"), "candidates")
    known, short = files.select("path", "content"), candidates.count() <= few
    if short:
        known = known.join(F.broadcast(candidates.select("path")), "path", "left_semi")
    made = known.select("path", F.sha2("content", 256).alias("full"), F.sha2("content", 512).alias("check"))
    made = written(made, "digests")
    return written(lookup(made, candidates, ["path"], few).select(*candidates.columns, "full", "check"), "full")


def signatures(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(path, size, mtime_ns, quick, full, check)`` of the files that can have a duplicate, in three stages: sizes, samples, contents."""
    return full_signatures(files, quick_signatures(files, sample))


def one_name(signed: DataFrame) -> DataFrame:
    """Of the names of one file (device and inode) the first path alone; for rows with dev and ino."""
    first = signed.groupBy("dev", "ino").agg(F.min("path").alias("path"))
    return signed.join(first.select("path"), "path", "left_semi")


def duplicates(signed: DataFrame, folder: str = "/dups") -> DataFrame:
    """``(source, kept, destination)``: each copy but the oldest (of equally old ones the first path) of equal contents.

    With a column ``check`` a row is a duplicate only if its check equals that of the kept one: digests that collide move nothing.
    """
    keys = ["size", "quick", "full"]
    checked = "check" in signed.columns
    place = F.struct("mtime_ns", "path", *(["check"] if checked else []))
    first = signed.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    losers = lookup(signed, written(first, "first"), keys).where(F.col("path") != F.col("first.path"))
    if checked:
        losers = losers.where(F.col("check") == F.col("first.check"))
    return losers.select(F.col("path").alias("source"), F.col("first.path").alias("kept"), mirrored(F.col("path"), folder).alias("destination"))


def survivors(files: DataFrame, moved: DataFrame) -> DataFrame:
    """``(size, path)`` of the files that stay."""
    return files.select("size", "path").join(moved.select(F.col("source").alias("path")), "path", "left_anti").select("size", "path")


def statistics(files: DataFrame, quick: DataFrame, full: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row: files, candidates of each stage, moves, and the bytes that a run over files reads.

    bytes_read_exact: the samples of all files whose size repeats, and all of those whose samples repeat; bytes_read_verify:
    both files of each move. Each table is summed once, and the three rows of sums are put side by side.
    """
    scanned = files.agg(F.count("*").alias("files_scanned"))
    sampled = F.size(sample_offsets(F.col("size"), sample)) * F.least(F.col("size"), F.lit(sample))
    stage = quick.agg(F.count("*").alias("size_candidates"), F.coalesce(F.sum(sampled), F.lit(0)).alias("_quick"))
    groups = full.groupBy("size", "quick", "full").agg(F.count("*").alias("n"))
    n, again = F.col("n"), lambda x: F.coalesce(F.sum(F.when(F.col("n") > 1, x)), F.lit(0))
    last = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("quick_candidates"), again(n).alias("full_candidates"), again(n - 1).alias("moved"),
        F.coalesce(F.sum(n * F.col("size")), F.lit(0)).alias("_full"), again((n - 1) * F.col("size") * 2).alias("bytes_read_verify"))
    out = scanned.crossJoin(stage).crossJoin(last)  # one row each
    names = ["files_scanned", "size_candidates", "quick_candidates", "full_candidates", "moved"]
    return out.select(*names, (F.col("_quick") + F.col("_full")).alias("bytes_read_exact"), "bytes_read_verify")
