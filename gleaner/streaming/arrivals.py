"""A stream of files held against the signatures of all earlier ones.

Signatures are a log: a folder of Parquet files with one part for each batch. A batch writes its own parts alone and
overwrites them if it runs again, so that a restart from the checkpoint neither loses nor repeats a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import mirrored
from ..operators.joins import lookup
from ..sources.scratch import exists, forget, settled, written

FILES = "path string, size long, mtime_ns long, content binary"
SIGNATURES = "path string, size long, mtime_ns long, full_hash string"


def signatures(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """``(path, size, mtime_ns, full_hash)`` as the newest batch that has seen each path says, of batches below ``before``."""
    if not exists(spark, store):  # nothing has been written yet; a store that can't be read is an error
        return spark.createDataFrame([], SIGNATURES)
    rows = spark.read.schema(f"{SIGNATURES}, batch long").option("basePath", store).parquet(store)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    newest = rows.groupBy("path").agg(F.max_by(F.struct("size", "mtime_ns", "full_hash"), "batch").alias("s"))
    return newest.select("path", "s.*")


def arrived(batch: DataFrame, known: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(signed, duplicates)`` of one batch of files: its signatures, and ``(source, kept, destination)``.

    Of equal contents the oldest file, known or new, is kept (of equally old ones the first path); the others that the batch holds
    are duplicates. A path that comes twice in a batch counts once, with its latest time. Only known files that share size
    and digest with the batch take part.
    """
    signed = batch.select("path", "size", "mtime_ns", F.sha2("content", 256).alias("full_hash"))
    signed = written(signed.groupBy("path").agg(F.max(F.struct("mtime_ns", "size", "full_hash")).alias("s")).select("path", "s.size", "s.mtime_ns", "s.full_hash"), "signed")
    keys = ["size", "full_hash"]
    asked = written(signed.select(*keys).distinct(), "asked")
    older = lookup(known.join(signed.select("path"), "path", "left_anti"), asked, keys)
    both = signed.unionByName(older.select(*signed.columns))
    first = written(both.groupBy(*keys).agg(F.min(F.struct("mtime_ns", "path")).alias("first")), "first")
    found = lookup(signed, first, keys).where(F.col("path") != F.col("first.path"))
    return signed, found.select(F.col("path").alias("source"), F.col("first.path").alias("kept"), mirrored(F.col("path"), folder).alias("destination"))


def watch(files: DataFrame, store: str, found: str, checkpoint: str, folder: str = "/dups", **trigger) -> StreamingQuery:
    """Starts a query over the stream ``files(path, size, mtime_ns, content)``; ``trigger`` is that of the writer.

    Each batch adds its signatures to ``store`` and the duplicates among its files to ``found``, both by ``batch``.
    """
    store, found = store.rstrip("/"), found.rstrip("/")

    def take(batch: DataFrame, number: int) -> None:
        def both() -> DataFrame:
            signed, duplicates = arrived(batch, signatures(batch.sparkSession, store, number), folder)
            duplicates.write.mode("overwrite").parquet(f"{found}/batch={number}")
            return signed

        signed = settled(both, "signed")
        signed.write.mode("overwrite").parquet(f"{store}/batch={number}")
        forget(signed)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
