"""A keyed table kept between runs as a log: each run adds the rows that it has seen, and lookups open only files that can hold their keys."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import delete, written

#: Bits of a filter for each key, and how many of them a key sets: one of a thousand other keys passes.
BITS_EACH, SET_EACH = 16, 6


class Conflict(RuntimeError):
    """Another writer has added to the log in between."""


@dataclass(frozen=True)
class Delta:
    """What one write has added: a folder of rows by bucket and of their filters. A base holds all that came before it.

    ``prune`` says that of the rows before it those that it doesn't have are gone: of all, or of the folders that it lists.
    """

    number: int
    folder: str
    base: bool = False
    prune: dict | None = field(default=None, hash=False)


def bits_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The places that each hash sets in a filter of ``size`` bits, a power of two."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(SET_EACH, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)).astype(np.int64)


def filter_of(hashes: np.ndarray) -> bytes:
    """A Bloom filter of the hashes."""
    has = np.zeros(max(64, 1 << (BITS_EACH * len(hashes) - 1).bit_length()), np.uint8)
    has[bits_of(hashes, len(has)).ravel()] = 1
    return np.packbits(has, bitorder="little").tobytes()


def any_within(hashes: np.ndarray, bits: bytes) -> bool:
    """Whether the filter may hold one of the hashes; never false for one that it was made of."""
    has = np.frombuffer(bits, np.uint8)
    at = bits_of(hashes, 8 * len(has))
    return bool((has[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1).any())


class Log:
    """A table of ``schema`` with one row for each ``key``, in the folder ``path`` that driver and executors share.

    ``append`` adds a delta: rows in ``buckets`` by the hash of their key, and for each bucket a filter of its keys. A delta counts once
    its commit file is there, which is created and never overwritten: of two writers each gets a number of its own, and a
    write that broke off is no delta. ``lookup`` opens the buckets of those deltas alone whose filters let a key pass; ``read`` opens
    all. Rows of one key are folded from the oldest delta to the newest: by ``fold(before, now)`` of two structs, or the newest wins.
    ``compact`` folds all deltas into a base and deletes them.

    A bucket's keys are filtered in one group of 8 bytes a key: choose ``buckets`` so that a delta has some million rows in each.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, fold: Callable[[Column, Column], dict[str, Column]] | None = None, buckets: int = 64, most: int = 8):
        self.spark, self.path, self.schema, self.key, self.fold, self.buckets, self.most = spark, path.rstrip("/"), schema, key, fold, buckets, most
        self.columns = spark.createDataFrame([], schema).columns

    # ---- commits

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _text(self, name: str) -> str:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/commits/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def deltas(self) -> list[Delta]:
        """The newest base and the deltas after it, the oldest first. A commit that was cut off while it was written is none."""
        fs, path = self._fs()
        folder = path(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        out = []
        for name in sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit()):
            try:
                out.append(Delta(int(name), **json.loads(self._text(name))))
            except ValueError:
                continue
        last = max((i for i, d in enumerate(out) if d.base), default=0)
        return out[last:]

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.path}/commits")
        return [int(n) for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit()] if fs.exists(folder) else []

    def _commit(self, number: int, **content) -> bool:
        """Creates commit ``number``; False if there is one."""
        fs, path = self._fs()
        try:
            stream = fs.create(path(f"{self.path}/commits/{number:012}"), False)
        except Exception as e:  # noqa: BLE001  the filesystem's own exception for a file that exists, by py4j
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        return True

    # ---- writing

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame) -> str:
        """Rows and filters in a folder of their own, which no commit names yet."""
        folder = f"{self.path}/parts/{uuid.uuid4().hex}"
        rows = rows.select(*self.columns).where(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket(F.col(self.key)))
        rows.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/rows")

        def made(table: pa.Table) -> pa.Table:
            return pa.table({"bucket": table["bucket"][:1], "bits": pa.array([filter_of(table["h"].to_numpy())], pa.binary())})

        keys = self._rows(folder).select("bucket", F.xxhash64(self.key).alias("h"))
        keys.groupBy("bucket").applyInArrow(made, "bucket int, bits binary").write.option("compression", "zstd").parquet(f"{folder}/filters")
        return folder

    def append(self, rows: DataFrame, prune: bool = False, roots: list[str] | None = None) -> Delta:
        """Adds ``rows``, one for each key, as the newest delta; with ``prune`` the older rows that are not among them are gone.

        With ``roots`` only those whose key lies in one of these folders. A null key is passed over. Where another writer commits at
        the same time, this delta comes after that one.
        """
        folder = self._put(rows)
        told = {"roots": None if roots is None else [r.rstrip("/") for r in roots]} if prune else None
        number = max(self._numbers(), default=0) + 1
        while not self._commit(number, folder=folder, base=False, prune=told):
            number += 1
        if len(self.deltas()) > self.most:
            try:
                self.compact()
            except Conflict:
                pass  # the next writer will
        return Delta(number, folder, False, told)

    def compact(self) -> None:
        """Folds everything into one base; its files and commits replace those before. Conflict, and nothing has changed, if the log has grown meanwhile."""
        before = self.deltas()
        if len(before) < 2:
            return
        folder, number = self._put(self._folded(before, self._table(before))), max(self._numbers()) + 1
        if [d.number for d in self.deltas()] != [d.number for d in before] or not self._commit(number, folder=folder, base=True, prune=None):
            delete(self.spark, folder)
            raise Conflict(f"{self.path} has grown since it was read")
        for d in before:
            delete(self.spark, f"{self.path}/commits/{d.number:012}")
            delete(self.spark, d.folder)

    # ---- reading

    def _rows(self, folder: str, buckets: list[int] | None = None) -> DataFrame:
        reader = self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", f"{folder}/rows")
        return reader.parquet(*([f"{folder}/rows"] if buckets is None else [f"{folder}/rows/bucket={b}" for b in buckets]))

    def _table(self, deltas: list[Delta], buckets: dict[int, list[int]] | None = None) -> DataFrame:
        parts = [(d, None if buckets is None else buckets.get(d.number, [])) for d in deltas]
        tables = [self._rows(d.folder, b).select(*self.columns, F.lit(d.number).cast("long").alias("_delta")) for d, b in parts if b is None or b]
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], f"{self.schema}, _delta long")

    def _gone(self, deltas: list[Delta], seen: Column, until: Column | None = None) -> Column:
        """Whether a row last seen in delta ``seen`` has been pruned since, before delta ``until``."""
        out = F.lit(False)
        for d in deltas:
            if d.prune is None:
                continue
            cut = seen < d.number
            if until is not None:
                cut = cut & (until > d.number)
            if d.prune["roots"] is not None:
                below = [(F.col(self.key) == r) | F.startswith(F.col(self.key), F.lit(r + "/")) for r in d.prune["roots"]]
                cut = cut & (reduce(or_, below) if below else F.lit(False))
            out = out | cut
        return out

    def _folded(self, deltas: list[Delta], table: DataFrame) -> DataFrame:
        """One row for each key; at most as many rows as there are deltas are folded, and none are shuffled where there is one."""
        if len(deltas) < 2:
            return table.select(*self.columns)
        names = ["_delta", *[c for c in self.columns if c != self.key]]
        rows = table.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_all"))

        def step(before: Column, now: Column) -> Column:
            newest = {c: now[c] for c in names}
            joined = newest | (self.fold(before, now) if self.fold else {})
            lost = self._gone(deltas, before["_delta"], now["_delta"])
            return F.when(lost, now).otherwise(F.struct(*[joined[c].alias(c) for c in names]))

        folded = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.col("_all")[0], step)
        rows = rows.select(self.key, folded.alias("_row")).where(~self._gone(deltas, F.col("_row._delta")))
        return rows.select(*[F.col(c) if c == self.key else F.col(f"_row.{c}").alias(c) for c in self.columns])

    def read(self) -> DataFrame:
        """The whole table; without any delta no rows."""
        deltas = self.deltas()
        return self._folded(deltas, self._table(deltas)) if deltas else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the ``keys``, a table with the key's column; other rows of the buckets that were opened are left out.

        Which buckets: the keys' hashes meet the filters by bucket, and the driver gets a row for each bucket of a delta that
        must be opened, at most as many as there are. Keys and rows are then joined.
        """
        deltas = self.deltas()
        if not deltas:
            return self.spark.createDataFrame([], self.schema)
        asked = written(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "asked")
        held = [self.spark.read.schema("bucket int, bits binary").parquet(f"{d.folder}/filters").withColumn("delta", F.lit(d.number).cast("long")) for d in deltas]
        filters = reduce(DataFrame.unionByName, held)

        def opened(hashes: pa.Table, bits: pa.Table) -> pa.Table:
            h = hashes["h"].to_numpy()
            rows = [(b, d) for b, d, x in zip(bits["bucket"].to_pylist(), bits["delta"].to_pylist(), bits["bits"].to_pylist()) if len(h) and any_within(h, x)]
            return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "delta": pa.array([r[1] for r in rows], pa.int64())})

        hashes = asked.select(self._bucket(F.col(self.key)).alias("bucket"), F.xxhash64(self.key).alias("h"))
        found = hashes.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(opened, "bucket int, delta long").collect()
        buckets: dict[int, list[int]] = {}
        for r in found:
            buckets.setdefault(r.delta, []).append(r.bucket)
        return self._folded(deltas, self._table(deltas, buckets).join(asked, self.key, "left_semi"))
