"""Carries out a move plan and writes reports: the only side effects of the file operators, both started by the driver."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .components import connected_components

CHUNK = 1 << 20


def sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def first_difference(a: str, b: str, low: int = 0, high: int | None = None) -> int | None:
    """The number of the first piece of ``CHUNK`` bytes, from ``low`` to before ``high``, in which two files differ; none if they don't.

    Pieces are read where they lie, so that parts of one pair of files can be looked at in different places. A piece that only
    one of the files has, or has more of, differs.
    """
    x, y = os.open(a, os.O_RDONLY), os.open(b, os.O_RDONLY)
    try:
        last = -(-max(os.fstat(x).st_size, os.fstat(y).st_size) // CHUNK)
        pieces = range(low, last if high is None else min(high, last))
        return next((i for i in pieces if os.pread(x, CHUNK, i * CHUNK) != os.pread(y, CHUNK, i * CHUNK)), None)
    finally:
        os.close(x)
        os.close(y)


def bytes_until(sizes: tuple[int, int], piece: int | None) -> int:
    """The bytes of both files up to and with a piece; all of them where there is none."""
    return sum(size if piece is None else min(size, (piece + 1) * CHUNK) for size in sizes)


def compared(a: str, b: str) -> tuple[bool, int]:
    """Whether two files have equal contents, and the bytes of both that it takes to know."""
    piece = first_difference(a, b)
    return piece is None, bytes_until((os.path.getsize(a), os.path.getsize(b)), piece)


STATED = "source string, kept string, size long, kept_size long, stamp string"
JUDGED = f"{STATED}, piece long, read boolean"


def stamp(*paths: str) -> str:
    """What changes when one of the files does."""
    return " ".join(f"{s.st_ino}:{s.st_size}:{s.st_mtime_ns}:{s.st_ctime_ns}" for s in map(os.stat, paths))


def compared_in_parts(pairs: DataFrame, pieces: int = 64) -> DataFrame:
    """``(source, kept, equal, bytes_read, stamp)`` of pairs of files ``(source, kept)``, however large: each part of a pair is a row of its own.

    A part is ``pieces`` of ``CHUNK`` bytes, and parts are dealt to all tasks; the least piece that differs counts, so that
    equal and bytes_read are what ``compared`` gives for the two. Both are null where a file is missing or can't be read.
    ``stamp`` tells whether the files are still those that were compared.
    """

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, kept in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    rows.append((source, kept, os.path.getsize(source), os.path.getsize(kept), stamp(source, kept)))
                except OSError:
                    rows.append((source, kept, None, None, None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()])], names=[x.split()[0] for x in STATED.split(", ")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for source, kept, known, part in zip(*(b.column(k).to_pylist() for k in (0, 1, 4, 5))):
                try:
                    found.append((first_difference(source, kept, part * pieces, (part + 1) * pieces), True) if known else (None, False))
                except OSError:
                    found.append((None, False))
            extra = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.bool_())]
            yield pa.record_batch([*b.columns[:5], *extra], names=[x.split()[0] for x in JUDGED.split(", ")])

    stated = written(pairs.select("source", "kept").mapInArrow(state, STATED), "stated")
    largest = F.coalesce(F.greatest("size", "kept_size"), F.lit(0))
    parts = stated.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(largest / (CHUNK * pieces)), F.lit(1)) - 1)))
    tasks = pairs.sparkSession.sparkContext.defaultParallelism
    judged = parts.repartition(tasks).mapInArrow(judge, JUDGED).groupBy("source", "kept", "size", "kept_size", "stamp").agg(F.min("piece").alias("piece"), F.min("read").alias("read"))
    end = (F.col("piece") + 1) * CHUNK
    until = F.when(F.col("piece").isNull(), F.col("size") + F.col("kept_size")).otherwise(F.least("size", end) + F.least("kept_size", end))
    return judged.select("source", "kept", F.when(F.col("read"), F.col("piece").isNull()).alias("equal"), F.when(F.col("read"), until).alias("bytes_read"), "stamp")


def move(source: str, destination: str) -> None:
    """Moves one file and never overwrites: FileExistsError if the destination is there.

    On one filesystem the file is linked and then unlinked. From one to another it is copied beside the destination,
    both digests are compared, and only then the source goes.
    """
    os.makedirs(os.path.dirname(destination), exist_ok=True)
    try:
        os.link(source, destination, follow_symlinks=False)
    except FileExistsError:
        raise
    except OSError:  # another filesystem, or one without links
        part = f"{destination}.part"
        try:
            shutil.copy2(source, part)
            if sha256(part) != sha256(source):
                raise OSError(f"the copy of {source} differs") from None
            if os.path.lexists(destination):
                raise FileExistsError(destination) from None
            os.rename(part, destination)
        finally:
            if os.path.lexists(part):
                os.unlink(part)
    os.unlink(source)


def carried_out(source: str, destination: str, kept: str | None = None, known: tuple[bool, int, str] | None = None) -> tuple[str, int]:
    """Status and bytes compared of one move: moved, conflict, differs, missing or failed. Safe to run twice.

    ``known`` is what ``compared_in_parts`` has found (equal, bytes read, stamp): it holds while both files are as they were. A second attempt at a move that an earlier attempt has half or wholly done ends as it would have: a file linked at both
    places is unlinked at its source.
    """
    read = 0
    try:
        if not os.path.isfile(source):
            return "missing", 0
        if os.path.isfile(destination) and os.path.samefile(source, destination) and source != destination:
            os.unlink(source)
            return "moved", 0
        if kept is not None:
            equal, read = known[:2] if known and known[2] == stamp(source, kept) else compared(source, kept)
            if not equal:
                return "differs", read
        move(source, destination)
        return "moved", read
    except FileExistsError:
        return "conflict", read
    except OSError:
        return "failed", read


def apply_moves(plan: DataFrame, dry_run: bool = False, proceed: Callable[[], bool] = lambda: True, order: tuple[str, ...] = ("source",)) -> Iterator[dict]:
    """Carries out ``plan(source, destination[, kept])`` in order, and yields a record for each row.

    status is ``moved``, ``planned`` (dry run), ``conflict`` (the destination exists), ``differs`` (``kept`` no longer has
    the same contents), ``missing`` (the source is gone) or ``failed``. The plan comes partition by partition, never whole.
    ``proceed`` is asked before each move; False ends the run, and a pause is a ``proceed`` that waits.
    """
    checked = "kept" in plan.columns
    for row in plan.orderBy(*order).toLocalIterator():
        if not proceed():
            return
        status = "planned" if dry_run else carried_out(row.source, row.destination, row.kept if checked else None)[0]
        yield {"source": row.source, "destination": row.destination, "status": status}


RECORDS = "source string, destination string, kept string, status string, bytes_read long"


def spread_moves(plan: DataFrame, large: int = 1 << 28) -> DataFrame:
    """``plan(source, destination, kept)`` carried out by the executors, for trees on storage that all of them share.

    Returns source, destination, kept, status and bytes_read, written once. With a column ``size``, files of ``large`` bytes or more are
    compared in parts by all tasks before. A task that runs again finds what its earlier attempt has moved: the source is
    gone and the destination has the kept file's contents, and that counts as moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for source, destination, kept, *known in zip(*(c.to_pylist() for c in b.columns)):
                status, read = carried_out(source, destination, kept, None if known[0] is None else tuple(known))
                if status == "missing" and os.path.isfile(destination):
                    try:
                        same, read = compared(destination, kept)
                        status = "moved" if same else status
                    except OSError:
                        pass
                done.append((status, read))
            yield pa.record_batch([*b.columns[:3], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=[x.split()[0] for x in RECORDS.split(", ")])

    none = [F.lit(None).cast(t).alias(c) for c, t in (("equal", "boolean"), ("bytes_read", "long"), ("stamp", "string"))]
    rows = plan.select("source", "destination", "kept", *none)
    if "size" in plan.columns:
        plan = written(plan.select("source", "destination", "kept", "size"), "plan")
        some = plan.where(F.col("size") >= large).select("source", "destination", "kept")
        verified = written(compared_in_parts(some), "compared")
        rows = plan.where(F.col("size") < large).select("source", "destination", "kept", *none)
        rows = rows.unionByName(some.join(verified, ["source", "kept"]).select(*rows.columns))
    return written(rows.mapInArrow(run, RECORDS), "moves")


def ordered_moves(plan: DataFrame, order: tuple[str, ...] = ("dedupe_key", "source"), dry_run: bool = False) -> DataFrame:
    """``plan(source, destination, dedupe_key, source_hash, ...)`` carried out by the executors with the result of the serial order.

    Moves that share a path, as source or destination, are a component: one's outcome can depend on another's. Each component is one
    task's work, in the order given; all others touch no path of its, and go on at the same time. Only the rows that
    share a path take part in the search for components. Adds the column status (as ``apply_moves``), written once. A task
    that runs again finds a source gone and at its destination a file with ``source_hash``: that was moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status = []
            for source, destination, digest in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("source", "destination", "source_hash"))):
                told = "planned" if dry_run else carried_out(source, destination)[0]
                if told == "missing" and digest is not None and os.path.isfile(destination):
                    try:
                        told = "moved" if sha256(destination) == digest else told
                    except OSError:
                        pass
                status.append(told)
            yield pa.record_batch([*b.columns[:-1], pa.array(status, pa.string())], names=[*b.schema.names[:-1], "status"])

    rows = plan.drop("status").withColumn("_row", F.xxhash64("source", "destination"))
    ends = rows.select(F.explode(F.array("source", "destination")).alias("path"), "_row").distinct()
    shared = written(ends.groupBy("path").agg(F.min("_row").alias("a"), F.max("_row").alias("b"), F.count("*").alias("n")).where("n > 1"), "shared")
    if shared.isEmpty():
        component = F.col("_row")
    else:
        met = written(ends.join(shared.select("path", "a"), "path").select("a", F.col("_row").alias("b")).where("a != b"), "met")
        named = connected_components(met).withColumnRenamed("node", "_row").withColumnRenamed("component", "_part")
        rows, component = rows.join(named, "_row", "left"), F.coalesce("_part", "_row")
    rows = rows.withColumn("_component", component).select(*[c for c in plan.columns if c != "status"], "_component")
    dealt = rows.repartition("_component").sortWithinPartitions("_component", *order)
    kind = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "_component") + ", status string"
    return written(dealt.mapInArrow(run, kind), "steps")


def write_report(report: object, path: str) -> None:
    """JSON with an indent of 2, sorted keys and a newline at the end; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True) + "\n")
