"""The same stream of files with its memory in Spark's state: each content's first file, and each file's content.

A batch reads the states of its own paths and contents alone, where ``arrivals.watch`` reads a log of all earlier batches. State and
progress are in the checkpoint, so that a restart goes on where the query ended.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import mirrored

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "size long, full_hash string, path string, mtime_ns long, held boolean"
FOUND = "source string, kept string"


class Contents(StatefulProcessor):
    """By path: what a file holds now, and what it no longer holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "size long, full_hash string")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        mtime, size, digest = max((r.mtime_ns, r.size, r.full_hash) for r in rows)  # a path that comes twice counts once
        if self.known.exists():
            before = self.known.get()
            if (before[0], before[1]) != (size, digest):
                yield Row(size=before[0], full_hash=before[1], path=key[0], mtime_ns=0, held=False)
        self.known.update((size, digest))
        yield Row(size=size, full_hash=digest, path=key[0], mtime_ns=mtime, held=True)

    def close(self) -> None:
        pass


class Holders(StatefulProcessor):
    """By content: the files that hold it, and the oldest of them (of equally old ones the first path).

    All holders are looked through only where the oldest goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "mtime_ns long, path string")
        self.held = handle.getMapState("held", "path string", "mtime_ns long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        first = tuple(self.first.get()) if self.first.exists() else None
        came, again = [], False
        for r in rows:
            if r.held:
                came.append((r.mtime_ns, r.path))
                self.held.updateValue((r.path,), (r.mtime_ns,))
            else:
                self.held.removeKey((r.path,))
            again |= first is not None and r.path == first[1]
        if again:
            first = min(((m[0], p[0]) for p, m in self.held.iterator()), default=None)
        first = min([*came, *([first] if first else [])], default=None)
        if first is None:
            self.first.clear()
        else:
            self.first.update(first)
            for _, path in came:
                if path != first[1]:
                    yield Row(source=path, kept=first[1])

    def close(self) -> None:
        pass


def duplicates(files: DataFrame, folder: str = "/dups") -> DataFrame:
    """``(source, kept, destination)`` of the stream ``files(path, size, mtime_ns, content)``, as ``arrivals.arrived`` says for each batch.

    Of equal contents the oldest file, from this batch or any before, is kept; the others of a batch are duplicates. A file
    that comes with another content no longer holds its old one. Contents are digested where they are read, and only digests are
    shuffled. The rows of one content are one task's work in a batch: a path and a time each.
    """
    signed = files.select("path", "size", "mtime_ns", F.sha2("content", 256).alias("full_hash"))
    changes = signed.groupBy("path").transformWithState(Contents(), CHANGES, "Append", "None")
    found = changes.groupBy("size", "full_hash").transformWithState(Holders(), FOUND, "Append", "None")
    return found.select("source", "kept", mirrored(F.col("source"), folder).alias("destination"))


def watch(files: DataFrame, found: str, checkpoint: str, folder: str = "/dups", **trigger) -> StreamingQuery:
    """Starts a query that adds the duplicates among the ``files`` to the Parquet folder ``found``, each once.

    The state is in RocksDB, whatever the session's provider is; the session's setting is put back.
    """
    conf = files.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        writer = duplicates(files, folder).writeStream.format("parquet").option("path", found).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
