"""Helpers that the training-data operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import beside, left_lookup, lookup  # noqa: F401  the operators take these from here
from ..sources.scratch import forget, settled, written  # noqa: F401


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Each text; a null is an empty text."""
    return [x or "" for x in column.to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark's setting of the bytes of an Arrow batch between JVM and Python worker (64 MB by default).
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Rows go to Python in batches of about ``size``, and one row that is longer whole, where the session names no size of its own.

    Buffers on either side grow to a batch and its copies, and an executor keeps them. Results don't depend on it.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, size)


def empty_text() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def chunk_pairs(rows: DataFrame, keys: list[str], ident: str, limit: int, weight: str | None = None, most: int = 1 << 19, few: int = 100_000) -> DataFrame:
    """``rows`` with columns lo, hi, own: groups of ``keys`` with over ``limit`` rows become blocks of two chunks each.

    A group is cut by the hash of ``ident`` into chunks of about ``limit`` rows, and with a column ``weight`` of about ``most`` of
    its sum; each row goes to every block (lo, hi) that holds its chunk ``own``; two rows of chunks c <= d meet in block
    (c, d) alone. So any group is compared whole, and no task gets more than about two chunks of it. Only the groups over
    the limit are listed and joined.
    """
    sizes = [F.count("*").alias("_n"), *([F.sum(weight).alias("_w")] if weight else [])]
    chunks = F.ceil(F.greatest(F.col("_n") / limit, F.col("_w") / most) if weight else F.col("_n") / limit).cast("int")
    large = written(rows.groupBy(*keys).agg(*sizes).where((F.col("_n") > 1) & (chunks > 1)).select(*keys, chunks.alias("_c"), "_n"), "large")
    rows = beside(rows, large, keys, few)
    rows = rows.withColumn("_c", F.coalesce("_c", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(ident), F.col("_c")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return rows.withColumn("lo", F.least("own", "_o")).withColumn("hi", F.greatest("own", "_o")).drop("_c", "_o")


def unlike_blocks(rows: DataFrame, keys: list[str], ident: str, label: str, limit: int, weight: str, most: int = 1 << 19, few: int = 100_000) -> DataFrame:
    """``rows`` with columns kind, lo, hi: blocks in which any two rows of a group of ``keys`` meet whose ``label`` differs.

    Rows of one label are known to belong together. A group of at most ``limit`` rows, and ``most`` of the sum of ``weight``, is one
    block. Of a larger one the rows with its most frequent label meet the others, and these each other, in blocks of two
    chunks, but they don't meet among themselves: the work is the group times its other rows, not its square. A large
    group with one label alone is in no block.
    """
    sums = rows.groupBy(*keys, label).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    most_rows = lambda c: F.max_by(c, F.struct("n", label))
    groups = sums.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("w").alias("_w"), most_rows(label).alias("_top"), most_rows("n").alias("_tn"), most_rows("w").alias("_tw"))
    chunks = lambda n, w: F.ceil(F.greatest(n / limit, w / most)).cast("int")
    sized = [chunks(F.col("_n") - F.col("_tn"), F.col("_w") - F.col("_tw")).alias("_u"), chunks(F.col("_tn"), F.col("_tw")).alias("_s")]
    large = written(groups.where((F.col("_n") > 1) & (chunks(F.col("_n"), F.col("_w")) > 1)).select(*keys, "_n", "_top", *sized), "large")
    block = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), f)).otherwise(F.array().cast("array<struct<kind:int,lo:int,hi:int>>"))
    own = F.pmod(F.xxhash64(ident), F.when(F.col(label) == F.col("_top"), F.col("_s")).otherwise(F.col("_u"))).cast("int")
    top = upto(F.col("_u"), lambda i: block(2, i, F.col("_own")))
    other = F.concat(upto(F.col("_u"), lambda i: block(1, F.least(i, F.col("_own")), F.greatest(i, F.col("_own")))), upto(F.col("_s"), lambda i: block(2, F.col("_own"), i)))
    blocks = F.when(F.col("_s").isNull(), F.array(block(0, F.lit(0), F.lit(0)))).when(F.col(label) == F.col("_top"), top).otherwise(other)
    dealt = beside(rows, large, keys, few).withColumn("_own", own).select(*rows.columns, F.explode(blocks).alias("_b"))
    return dealt.select(*rows.columns, "_b.kind", "_b.lo", "_b.hi")
