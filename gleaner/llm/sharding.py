"""Sharding by sampled splitters, in DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

OVERHEAD = 8


def shards(docs: DataFrame, count: int = 24, ranges_each: int = 64, samples_each: int = 16, whole_group: float = 0.02) -> DataFrame:
    """Documents in ``count`` shards of near equal bytes, equal texts side by side.

    A record's size is the UTF-8 bytes of its text plus 8. Records are ordered by a key: the digest of the text, and for a
    group of equal texts that has more than ``whole_group`` of a shard's bytes also a part number, which subdivides it.
    A size-weighted sample of keys, of about count * ranges_each * samples_each, goes to the driver; its quantiles are the
    splitters of ``count * ranges_each`` ranges. The bytes of every range are then counted; an overfull range (over
    twice the mean) that holds several keys is subdivided by splitters sampled within it. Consecutive ranges
    make up a shard, cut where the prefix sums come nearest to equal shares. What reaches the driver is bounded by
    parameters, not by the input.

    Returns doc_id, size, text_crc32 (unsigned, of the UTF-8 bytes), law ('bytes'), shard, slot (gapless from 0 in each
    shard), grown_shard (null). A text of any length is one record. A null text has no bytes: size 8, and a group of its own beside the empty texts. Ties
    and repeated rows get slots of their own, and a large group of them is cut like any other. A null doc_id is kept. An empty table gives none. Extra columns are ignored.
    """
    text = F.col("text").cast("string")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),  # tells rows apart that are the same; fixed once it is written
    )
    slim = written(slim, "sizes")
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # At most count / whole_group groups can be over the limit.
    limit = max(1, int(total / count * whole_group))
    large = slim.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > limit) & (F.col("n") > 1))
    large = large.select("digest", F.least(F.ceil(F.col("bytes") / limit), F.col("n")).cast("int").alias("parts"))
    keyed = slim.join(F.broadcast(large), "digest", "left")
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("string")
    keyed = written(keyed.select("doc_id", "row", "size", "text_crc32", F.concat("digest", F.lit("-"), F.lpad(part, 6, "0")).alias("key")), "keyed")

    ranges = count * ranges_each
    splitters = _sample(keyed, ranges * samples_each / max(total, 1), ranges)
    while True:
        placed = keyed.withColumn("range", _range(keyed.sparkSession, splitters))
        found = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("range").collect()
        over = [r for r in found if r.bytes > 2 * total / ranges and r.low != r.high]
        more = sorted({*splitters, *_within(placed, over, total / ranges)}) if over else splitters
        if len(more) == len(splitters):
            break
        splitters = more

    shard, slot, bytes_before, at, filled = {}, {}, 0, 0, 0
    for r in found:
        # The shard in which the middle of the range falls: its edges are the range edges nearest to equal shares.
        now = min(count - 1, int((bytes_before + r.bytes / 2) * count / max(total, 1)))
        at, filled = (now, 0) if now != at else (at, filled)
        shard[r.range], slot[r.range] = at, filled
        bytes_before, filled = bytes_before + r.bytes, filled + r.n
    table = keyed.sparkSession.createDataFrame([(k, shard[k], slot[k]) for k in shard], "range int, shard int, first long")
    ordered = Window.partitionBy("range").orderBy("key", "doc_id", "row")
    numbered = placed.withColumn("nth", F.row_number().over(ordered))
    # A row for each range: count * ranges_each, and those that were subdivided.
    out = numbered.join(F.broadcast(table), "range")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _drawn(keyed: DataFrame, rate: float) -> F.Column:
    """True with a chance of size * rate; the same rows each time the table is read."""
    unit = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return unit < F.col("size") * F.lit(rate)


def _sample(keyed: DataFrame, rate: float, ranges: int) -> list[str]:
    """Quantiles of a size-weighted sample of keys; a record larger than a sample step stands for as many steps."""
    drawn = keyed.where(_drawn(keyed, rate)).select("key", F.greatest(F.lit(1.0), F.col("size") * F.lit(rate)).alias("w"))
    rows = drawn.groupBy("key").agg(F.sum("w").alias("w")).orderBy("key").collect()
    weight, out, step, seen = sum(r.w for r in rows), [], 1, 0.0
    for r in rows:
        seen += r.w
        while step < ranges and seen >= step * weight / ranges:
            if not out or out[-1] != r.key:
                out.append(r.key)
            step += 1
    return out


def _within(placed: DataFrame, over: list, aim: float) -> list[str]:
    """Splitters inside overfull ranges, from a denser sample of those ranges alone."""
    inside = placed.where(F.col("range").isin([r.range for r in over]))
    drawn = inside.where(_drawn(inside, 16 / aim)).groupBy("range", "key").agg(F.sum("size").alias("w")).collect()
    out = []
    for r in over:
        keys = sorted(x.key for x in drawn if x.range == r.range) or [r.low]
        pieces = max(2, round(r.bytes / aim))
        out += [keys[min(len(keys) - 1, len(keys) * i // pieces)] for i in range(pieces)] + [r.low]
    return [k for k in out if k < max(r.high for r in over)]


def _range(spark, splitters: list[str]) -> F.Column:
    """The number of splitters below the key: a binary search over one constant array. A splitter ends its range."""
    if not splitters:
        return F.lit(0)
    table = F.array(*map(F.lit, splitters)) if len(splitters) < 2 else F.split(F.lit(",".join(splitters)), ",")
    size, step = len(splitters), 1
    while step * 2 <= size:
        step *= 2
    steps = []
    while step:
        steps.append(step)
        step //= 2
    key = F.col("key")
    search = lambda low, s: F.when((low + s <= size) & (F.element_at(table, F.least(low + s, F.lit(size))) < key), low + s).otherwise(low)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search)


def range_of(splitters: list[str], key: str) -> int:
    """What ``_range`` computes, for one key."""
    return bisect_left(splitters, key)
