"""Reports written by the executors: one JSON list, or a folder of JSON lines, complete or not there at all."""

from __future__ import annotations

import datetime as dt
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


def _plain(value: object) -> object:
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


class ReportWriter(DataSourceWriter):
    """Each task writes a part beside the report, and tells its name; the report takes the parts' place once all are there.

    ``list``: one file with a list of objects, two spaces of indent and sorted keys, as ``moves.write_report`` writes it; the driver only
    joins the parts' bytes. ``lines``: a folder with the parts as they are, and a mark of success. A task or a job that
    fails leaves nothing behind, and what was there before stays as it was.
    """

    def __init__(self, options: dict):
        self.path, self.lines = os.path.abspath(options["path"]), options.get("layout", "list") == "lines"
        self.parts = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, rows: Iterator[Row]) -> Part:
        task = TaskContext.get()
        number, n = task.partitionId(), 0
        os.makedirs(self.parts, exist_ok=True)
        name = f"{self.parts}/part-{number:06}-{task.attemptNumber()}-{task.taskAttemptId()}.json"
        try:
            with open(name, "w") as out:
                for r in rows:
                    text = json.dumps(r.asDict(True), sort_keys=True, default=_plain, indent=None if self.lines else 2)
                    out.write(text + "\n" if self.lines else ",\n" * bool(n) + "\n".join("  " + x for x in text.split("\n")))
                    n += 1
        except BaseException:
            os.unlink(name)
            raise
        return Part(number, name, n)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        os.makedirs(self.parts, exist_ok=True)  # a report without tasks
        if self.lines:
            kept = {m.path for m in parts}
            for name in os.listdir(self.parts):  # of attempts that another one of the same task has replaced
                if f"{self.parts}/{name}" not in kept:
                    os.unlink(f"{self.parts}/{name}")
            open(f"{self.parts}/_SUCCESS", "w").close()
            old = f"{self.parts}.old"
            if os.path.lexists(self.path):
                os.rename(self.path, old)
            os.rename(self.parts, self.path)
            shutil.rmtree(old, ignore_errors=True)
            return
        whole = f"{self.parts}/whole"
        with open(whole, "wb") as out:
            out.write(b"[")
            first = True
            for m in parts:
                if m.rows:
                    out.write(b"\n" if first else b",\n")
                    first = False
                    with open(m.path, "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 20)
            out.write(b"]\n" if first else b"\n]\n")
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options)


def write(rows: DataFrame, path: str, layout: str = "list") -> None:
    """Writes ``rows`` as a report, in the order of their partitions, on storage that driver and executors share."""
    if layout not in ("list", "lines"):
        raise ValueError(f"a report is a list or lines, not {layout!r}")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows.sparkSession.dataSource.register(ReportSink)
    rows.write.format("report").option("path", path).option("layout", layout).mode("append").save()
