"""File inventories with exact stat values: a table source with pushed filters, a stream of changed files, and scans of large trees by the executors."""

from __future__ import annotations

import logging
import os
import stat
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..functions.text import kind, split_extension
from .scratch import written

LOGGER = logging.getLogger(__name__)
SCHEMA = "path string, size long, mtime_ns long, dev long, ino long, extension string"
STREAM = "path string, size long, mtime_ns long, dev long, ino long, extension string, ctime_ns long"
#: The setting by which Spark offers filters to sources written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Folders that the driver lists before it deals out trees; those that a task goes through, and files that it asks for, before it hands back the rest.
SPREAD, TASK = 256, 2000


def extension(path: str) -> str:
    """What ``split_extension`` gives: from the last dot that follows something other than a dot, in lower case."""
    return os.path.splitext(path)[1].lower()


@dataclass(frozen=True)
class Rules:
    """Which files are listed. ``prefixes`` and ``excluded`` are beginnings of paths: trees that none of the former can be in, or that are wholly in one of
    the latter, are not opened. ``extensions`` and the sizes are those of files."""

    prefixes: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    extensions: frozenset[str] | None = None
    least: int = 0
    most: int | None = None
    follow: bool = False

    def opens(self, folder: str) -> bool:
        below = folder.rstrip("/") + "/"
        if any(below.startswith(x) or folder == x for x in self.excluded):
            return False
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def names(self, path: str) -> bool:
        """Whether a path will do, before the file is asked for."""
        if self.extensions is not None and extension(path) not in self.extensions:
            return False
        return all(path.startswith(p) for p in self.prefixes) and not any(path.startswith(x) for x in self.excluded)

    def takes(self, s: os.stat_result) -> bool:
        return stat.S_ISREG(s.st_mode) and s.st_size >= self.least and (self.most is None or s.st_size <= self.most)

    def narrowed(self, f: ds.Filter) -> Rules | None:
        """With one more filter of the source's columns; None for one that it doesn't know."""
        inner = f.child if isinstance(f, ds.Not) else f
        if getattr(inner, "attribute", None) == ("path",) and isinstance(inner, ds.StringStartsWith):
            return replace(self, excluded=(*self.excluded, inner.value)) if f is not inner else replace(self, prefixes=(*self.prefixes, inner.value))
        if f is not inner:
            return None
        if getattr(f, "attribute", None) == ("extension",) and isinstance(f, (ds.In, ds.EqualTo)):
            some = frozenset(f.value) if isinstance(f, ds.In) else frozenset([f.value])
            return replace(self, extensions=some if self.extensions is None else some & self.extensions)
        if getattr(f, "attribute", None) == ("size",):
            bounds = {ds.GreaterThan: (1, True), ds.GreaterThanOrEqual: (0, True), ds.LessThan: (-1, False), ds.LessThanOrEqual: (0, False)}
            if type(f) in bounds:
                more, low = bounds[type(f)]
                if low:
                    return replace(self, least=max(self.least, f.value + more))
                return replace(self, most=f.value + more if self.most is None else min(self.most, f.value + more))
            if isinstance(f, ds.EqualTo):
                return replace(self, least=max(self.least, f.value), most=f.value if self.most is None else min(self.most, f.value))
        if isinstance(f, ds.IsNotNull):
            return self  # no column is null
        return None


def _opened(path: str) -> int:
    """A descriptor of a folder, also where its path is longer than the system takes at once."""
    flags = os.O_RDONLY | os.O_DIRECTORY
    if len(os.fsencode(path)) < 4000:
        return os.open(path, flags)
    parts, here = path.split("/"), os.open("/" if path.startswith("/") else ".", flags)
    low = 0
    while low < len(parts):
        high, size = low, 0
        while high < len(parts) and size < 3000:
            size += len(os.fsencode(parts[high])) + 1
            high += 1
        piece, low = "/".join(parts[low:high]).lstrip("/") or ".", high
        try:
            following = os.open(piece, flags, dir_fd=here)
        finally:
            os.close(here)
        here = following
    return here


def listed(folder: str, rules: Rules) -> tuple[list[str], list[str]]:
    """Folders and other names in a folder, sorted. One that can't be read is logged and holds nothing; links to folders are passed over."""
    try:
        here = _opened(folder)
    except OSError as e:
        LOGGER.error("folder passed over: %s", e)
        return [], []
    folders, names = [], []
    try:
        with os.scandir(here) as found:
            for e in found:
                try:
                    is_folder = e.is_dir(follow_symlinks=False)
                except OSError as error:
                    LOGGER.error("file passed over: %s", error)
                    continue
                path = os.path.join(folder, e.name)
                if is_folder:
                    if rules.opens(path):
                        folders.append(path)
                elif rules.names(path):
                    names.append(e.name)
    except OSError as e:
        LOGGER.error("folder passed over: %s", e)
    finally:
        os.close(here)
    return sorted(folders), sorted(names)


def asked(folder: str, names: Iterable[str], rules: Rules) -> Iterator[tuple]:
    """``(path, stat)`` of the regular files among the names in a folder that the rules take."""
    try:
        here = _opened(folder)
    except OSError as e:
        LOGGER.error("folder passed over: %s", e)
        return
    try:
        for name in names:
            try:
                s = os.stat(name, dir_fd=here, follow_symlinks=rules.follow)
            except OSError as e:
                LOGGER.error("file passed over: %s", e)
                continue
            if rules.takes(s):
                yield os.path.join(folder, name), s
    finally:
        os.close(here)


def row(path: str, s: os.stat_result) -> tuple:
    return path, s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino, extension(path)


@dataclass
class Folder(ds.InputPartition):
    path: str
    deep: bool
    after: int = 0
    until: int = field(default=0)

    def __post_init__(self) -> None:
        self.value = self.path


def dealt(roots: list[str], rules: Rules) -> list[Folder]:
    """A partition for each folder of the first levels, with its own files, and one for each whole tree below them.

    Levels are listed until there are ``SPREAD`` folders, so that one deep folder is no single task. Roots that are missing are passed over.
    """
    out, level = [], [r for r in roots if os.path.isdir(r) and rules.opens(r)]
    while level and len(out) + len(level) < SPREAD:
        out += [Folder(f, False) for f in level]
        level = [x for f in level for x in listed(f, rules)[0]]
    return out + [Folder(f, True) for f in level] or [Folder("", False)]


def walked(part: Folder, rules: Rules) -> Iterator[tuple]:
    stack = [part.path] if part.path else []
    while stack:
        folder = stack.pop()
        folders, names = listed(folder, rules)
        yield from asked(folder, names, rules)
        if part.deep:
            stack += folders


def _roots(options: dict) -> list[str]:
    return [r for r in options["roots"].split("\x00") if r]


class InventoryReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.rules = _roots(options), Rules(follow=options.get("followfilesymlinks", "false") == "true")

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            narrowed = self.rules.narrowed(f)
            if narrowed is None:
                yield f
            else:
                self.rules = narrowed

    def partitions(self) -> list[Folder]:
        return dealt(self.roots, self.rules)

    def read(self, partition: Folder) -> Iterator[tuple]:
        return (row(*found) for found in walked(partition, self.rules))


class ChangesReader(ds.DataSourceStreamReader):
    """Files whose status changed (they were written, moved here or renamed) in a span of time, in spans without gaps.

    An offset is a time in nanoseconds; a batch lists the trees and takes the files between two of them, so that each change
    comes in one batch, after a restart too. Files younger than ``settle`` seconds wait for the next batch: it is to
    cover how long a file takes to be seen, and clocks that differ.
    """

    def __init__(self, options: dict):
        self.roots, self.rules = _roots(options), Rules(follow=options.get("followfilesymlinks", "false") == "true")
        self.settle = int(float(options.get("settle", "1")) * 1e9)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f.path, f.deep, start["until"], end["until"]) for f in dealt(self.roots, self.rules)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for path, s in walked(partition, self.rules):
            if partition.after < s.st_ctime_ns <= partition.until:
                yield *row(path, s), s.st_ctime_ns

    def commit(self, end: dict) -> None:
        pass


class InventorySource(ds.DataSource):
    """``inventory``: the regular files below the option ``roots`` (parted by NUL), as a table; ``changes`` is the same as a stream."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        return InventoryReader(self.options)


class ChangesSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return STREAM

    def streamReader(self, schema) -> ChangesReader:
        return ChangesReader(self.options)


def _options(roots: list[str], follow: bool) -> dict[str, str]:
    return {"roots": "\x00".join(os.path.abspath(r) for r in roots), "followfilesymlinks": str(follow).lower()}


def described(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` with extension and kind."""
    files = files if "extension" in files.columns else files.withColumn("extension", split_extension(F.col("path")))
    return files.withColumn("kind", kind(F.col("extension")))


def table(spark: SparkSession, roots: list[str], follow_file_symlinks: bool = False) -> DataFrame:
    """The files below the roots by the source ``inventory``, for filters of path, extension and size: they reach the listing.

    Overlapping roots list a file more than once. The session's setting ``PUSHDOWN`` is turned on where it says nothing.
    """
    spark.dataSource.register(InventorySource)
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    files = spark.read.format("inventory").options(**_options(roots, follow_file_symlinks)).load()
    # Spark plans a scan anew where there are filters to push, and else takes the last plan of the same table, with that one's filters: so there is always one.
    return files.where(F.col("path").isNotNull())


def changes(spark: SparkSession, roots: list[str], follow_file_symlinks: bool = False, settle: float = 1.0) -> DataFrame:
    """A stream of the files below the roots as they come and change, each change once."""
    spark.dataSource.register(ChangesSource)
    return spark.readStream.format("changes").options(**_options(roots, follow_file_symlinks), settle=str(settle)).load()


UNITS = "folder string, names array<string>, path string, size long, mtime_ns long, dev long, ino long, extension string"


def frontier(spark: SparkSession, roots: list[str], rules: Rules, most: int = TASK) -> DataFrame:
    """The files below the roots, listed by the executors in rounds: ``SCHEMA``.

    A round's work is a table of folders to list, and of lists of names to ask for; each task goes on downwards until it has
    gone through ``most`` folders or asked for as many files, and hands back what is left, which is dealt out anew. So neither a deep
    chain nor a folder with very many files is one task's work, but for the listing of its names. The driver knows the roots alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("folder", pa.string()), ("names", pa.list_(pa.string())), *[(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in SCHEMA.split(", ")]])
        done = 0
        for b in batches:
            for folder, names in zip(*(b.column(k).to_pylist() for k in range(2))):
                found, left = [], []
                work = [(folder, names)]
                while work:
                    here, wanted = work.pop()
                    if wanted is None and done < most:
                        folders, wanted = listed(here, rules)
                        work += [(f, None) for f in folders]
                        done += 1
                    if wanted is None or done + len(wanted) > most and len(wanted) > most // 4:
                        # to others: a folder, or names in lists of a quarter of a task
                        left += [(here, None)] if wanted is None else [(here, wanted[i : i + max(most // 4, 1)]) for i in range(0, len(wanted), max(most // 4, 1))]
                        continue
                    found += [row(*x) for x in asked(here, wanted, rules)]
                    done += len(wanted)
                rows = [(*x, *[None] * 6) for x in left] + [(None, None, *x) for x in found]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], schema=kinds)

    tops = [(r, None) for r in roots if rules.opens(r)]
    work = spark.createDataFrame(tops, "folder string, names array<string>")
    work, files = work.repartition(max(1, len(tops))), None
    parts = max(spark.sparkContext.defaultParallelism, 1)
    while True:
        out = written(work.mapInArrow(run, UNITS), "listed")
        found = out.where("folder is null").select(*[c.split()[0] for c in SCHEMA.split(", ")])
        files = found if files is None else files.unionByName(found)
        left = out.where("folder is not null").select("folder", "names")
        if not left.head(1):
            return files
        work = left.repartition(parts)


def scan(spark: SparkSession, roots: list[str], exclude: str | None = None, follow_file_symlinks: bool = False, rules: Rules = Rules()) -> DataFrame:
    """The regular files below the roots, each path once however often roots overlap; ``exclude`` and all below it is left out and never opened.

    Roots are paths on storage that the executors share; those that are missing, or no folders, are logged and passed over.
    """
    tops = sorted({os.path.abspath(r) for r in roots})
    tops = [r for r in tops if not any(r != t and r.startswith(t.rstrip("/") + "/") for t in tops)]  # one within another is listed with it
    if exclude:
        top = os.path.abspath(exclude)
        rules = replace(rules, excluded=(*rules.excluded, top.rstrip("/") + "/"))
    files = frontier(spark, tops, replace(rules, follow=follow_file_symlinks))
    if exclude:
        files = files.where(F.col("path") != top)  # a file of that name
    return described(files)
