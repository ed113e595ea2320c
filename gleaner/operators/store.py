"""The signature store: digests by path, looked up by identity, merged and pruned; kept between runs as a log."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import Log

IDENTITY = ["size", "mtime_ns", "dev", "ino"]
SIGNATURES = ["quick_hash", "full_hash", "media_sig", "media_meta"]
SCHEMA = "path string, size long, mtime_ns long, dev long, ino long, quick_hash string, full_hash string, media_sig string, media_meta string, last_seen_run string"


def lookup(files: DataFrame, store: DataFrame) -> DataFrame:
    """``files`` with the stored signatures of the same path and identity, null where there are none."""
    return files.join(store.select("path", *IDENTITY, *SIGNATURES), ["path", *IDENTITY], "left")


def hits(looked_up: DataFrame, signature: str) -> DataFrame:
    """One row: hits, misses and their ratio for one signature."""
    counted = looked_up.agg(F.count(signature).alias("hits"), F.count_if(F.col(signature).isNull()).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return counted.withColumn("hit_ratio", F.when(total > 0, F.col("hits") / total).otherwise(0.0))


def merge(store: DataFrame, fresh: DataFrame, run: str) -> DataFrame:
    """The store after a run that has seen ``fresh``: a changed identity takes the new signatures, nulls too; else new ones win over old."""
    old, new = store.alias("o"), fresh.withColumn("seen", F.lit(True)).alias("n")
    joined = old.join(new, F.col("o.path") == F.col("n.path"), "full_outer")
    seen, known = F.coalesce(F.col("n.seen"), F.lit(False)), F.col("o.path").isNotNull()
    same = known
    for c in IDENTITY:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    pick = lambda c: F.when(seen, F.when(same, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"n.{c}"))).otherwise(F.col(f"o.{c}")).alias(c)
    ident = [F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ["path", *IDENTITY]]
    return joined.select(*ident, *map(pick, SIGNATURES), F.when(seen, F.lit(run)).otherwise(F.col("o.last_seen_run")).alias("last_seen_run"))


def prune(store: DataFrame, run: str, roots: list[str] | None = None) -> DataFrame:
    """The rows that ``run`` has seen; with ``roots`` also those of files that lie in none of these folders."""
    kept = F.col("last_seen_run") == run
    if roots:
        tops = [root.rstrip("/") for root in roots]
        below = [(F.col("path") == top) | F.startswith("path", F.lit(top + "/")) for top in tops]
        kept = kept | ~reduce(or_, below)
    return store.where(kept)


def fold(before: Column, now: Column) -> dict[str, Column]:
    """What ``merge`` says of two rows of one path, as a fold of the log: the same identity keeps what the newer one doesn't know."""
    same = reduce(and_, [before[c].eqNullSafe(now[c]) for c in IDENTITY])
    return {c: F.when(same, F.coalesce(now[c], before[c])).otherwise(now[c]) for c in SIGNATURES}


def opened(spark: SparkSession, path: str, **options) -> Log:
    """The signature store in a folder."""
    return Log(spark, path, SCHEMA, "path", fold, **options)
