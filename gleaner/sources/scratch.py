"""The scratch folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Tables that are still there, and the path of each frame that ``written`` returned.
_LEFT: dict[str, SparkSession] = {}
_PATH: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: What the running ``settled`` has written so far. Each thread has a context of its own, and so do nested calls.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="gleaner-")
        shared = _OWN[app]
    return shared.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder there, which goes when the session ends."""
    path = f"{scratch(spark)}/gleaner/{label}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the scratch folder and read again.

    This cuts the lineage in a way that survives the loss of any executor: the files are on shared storage, and a
    table that is read more than once is computed once.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/gleaner/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _LEFT[path] = spark
    if (made := _MADE.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATH[out] = path
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, written; the tables that this call wrote on the way to it are deleted.

    Only its own: other threads, and calls around this one, keep theirs. Where ``make`` fails they go too.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        out = written(make(), label)
        made.remove(_PATH[out])
    finally:
        _MADE.reset(token)
        for path in made:
            _forget(path)
    if (around := _MADE.get()) is not None:
        around.append(_PATH[out])
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned and that no later step reads; other frames are left alone."""
    for df in tables:
        if path := _PATH.get(df):
            _forget(path)


def _forget(path: str) -> None:
    if spark := _LEFT.pop(path, None):
        delete(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before: nothing is left to ask
            return
