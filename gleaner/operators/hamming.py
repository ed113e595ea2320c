"""Pairs of bit patterns within a Hamming distance: a multi-index by bands, whose full cells are split."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .blocks import whole
from .joins import beside

BITS = 64
#: What a row of the index costs, in comparisons of two marks.
ROW = 20


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def reach(width: int, within: int) -> int:
    """How many values lie within so many bits of a value of ``width`` bits, itself included."""
    return sum(comb(width, i) for i in range(within + 1))


def bands(radius: int, count: int) -> list[tuple[int, int, int]]:
    """``(shift, width, within)`` of disjoint bands of 64 bits: two patterns within ``radius`` bits agree in one band within its bits.

    If they differed more in every band, there would be sum(within + 1) = radius + 1 differing bits. With few bands a row goes to
    many cells, with many bands cells hold many rows: the number of bands is the one with the least work at ``count`` patterns.
    """
    if radius < 1:
        raise ValueError("patterns within 0 bits are equal")

    def cut(n: int) -> list[tuple[int, int, int]]:
        out, shift = [], 0
        for i in range(n):
            width = BITS // n + (i < BITS % n)
            out.append((shift, width, (radius + 1) // n + (i < (radius + 1) % n) - 1))
            shift += width
        return out

    def work(plan: list[tuple[int, int, int]]) -> float:
        return sum(count * ROW * (reach(w, r) + 1) + count * count * reach(w, r) / 2.0**w for _, w, r in plan)

    return min((cut(n) for n in range(2, min(radius + 1, BITS) + 1)), key=work)


def flips(width: int, within: int) -> Column:
    """All patterns of up to ``within`` of ``width`` bits, as one constant array."""
    found = [sum(1 << i for i in c) for n in range(within + 1) for c in combinations(range(width), n)]
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")


#: What a row in a cell of ``masks`` costs, in comparisons of two marks; they are made in tiles of TILE.
CELL, TILE = 1000, 1 << 18


def masks(radius: int, count: int) -> list[int]:
    """Masks of 64 bits: two patterns within ``radius`` bits agree under one of them in all of its bits.

    Disjoint bands as in ``bands``; a band within w bits is cut into w + c parts, of which at least c agree, so that it has a mask for each c
    of its parts. Bands and parts are those with the least work at ``count`` patterns.
    """

    def of_band(shift: int, width: int, within: int) -> list[int]:
        if within >= width:
            return [0]

        def cut(parts: int) -> list[int]:
            edges = [shift + width * i // parts for i in range(parts + 1)]
            each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
            return [sum(c) for c in combinations(each, parts - within)]

        return min((cut(n) for n in range(within + 1, min(width, within + 6) + 1)), key=work)

    def work(found: list[int]) -> float:
        return sum(count * CELL + count * count / 2.0 / 2.0 ** m.bit_count() for m in found)

    def cut(n: int) -> list[int]:
        out, shift = [], 0
        for i in range(n):
            width = BITS // n + (i < BITS % n)
            out += of_band(shift, width, (radius + 1) // n + (i < (radius + 1) % n) - 1)
            shift += width
        return out

    if radius < 1:
        raise ValueError("patterns within 0 bits are equal")
    # A band's masks grow with the powers of what it is within: over 5 bits they are too many for any count.
    return min((cut(n) for n in range(max(1, ceil((radius + 1) / 6)), min(radius + 1, BITS) + 1)), key=work)


def similar(total: int, frame: int) -> tuple[Column, Column]:
    """Score of the marks a.hashes and b.hashes, and whether they have as many patterns and stay within both limits."""
    each = F.zip_with("a.hashes", "b.hashes", hamming)
    score = F.aggregate(each, F.lit(0), lambda s, x: s + x)
    return score, (F.size("a.hashes") == F.size("b.hashes")) & (score <= total) & F.forall(each, lambda x: x <= frame)


def links(marks: DataFrame, total: int, frame: int, keys: list[str], limit: int = 1024, few: int = 100_000, joined: int = 4096, chunk: int = 8192) -> DataFrame:
    """``(a, b, score)``: pairs of ``marks(rep, hashes, *keys)`` with equal keys, as many hashes, and distances within both limits.

    rep names a mark; a is the lesser of the two, and score the sum of the distances. Marks are a written table, those with
    equal keys distinct. Of s hashes one differs in at most total / s bits, so that a pair meets in a cell of that hash's index.
    Up to ``joined`` marks are joined by Spark: a cell is equal keys and a value of a band within its bits, and one with over ``limit`` rows on
    either side is split into chunks by the hash of rep, each of which meets every chunk of the other side in a group of its own. More of them are
    compared in Arrow batches (``_compared``), in chunks of about ``chunk``. No task has to take more than a group of two
    chunks, and no pair is left out. Marks without hashes, or with a null one, have no links.
    """
    spark, out = marks.sparkSession, None
    sound = marks.where("size(hashes) > 0 and forall(hashes, h -> h is not null)")
    for s, n in sound.groupBy(F.size("hashes").alias("s")).count().orderBy("s").collect():  # a row for each number of frames
        radius = min(total // s, frame, BITS)
        if radius < 1:
            continue
        rows = sound.where(F.size("hashes") == s)
        found = _of_size(rows, s, bands(radius, n), similar(total, frame), keys, limit, few).distinct() if n <= joined else _compared(rows, s, total, frame, keys, chunk, few)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"a {dict(marks.dtypes)['rep']}, b {dict(marks.dtypes)['rep']}, score int")
    return out


def _compared(marks: DataFrame, s: int, total: int, frame: int, keys: list[str], chunk: int, few: int) -> DataFrame:
    """``links`` of marks of s hashes each, by cells that are compared within Arrow batches, all marks of one with each other.

    A cell is all marks of equal keys, if they are few; of more it is those that agree in a hash under one of ``masks``. A pair that meets in many
    cells counts in the first. A cell with over ``chunk`` marks is cut by the hash of rep, and any two of its chunks meet in a group.
    """
    marks = marks.where(" and ".join(f"{k} is not null" for k in keys))
    blocks = marks.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * chunk)
    large = written(blocks.select(*keys, "_n", F.lit(True).alias("_large")), "large")
    largest = large.agg(F.max("_n")).first()[0]
    plan = [(f, m) for f in range(s) for m in masks(min(total // s, frame, BITS), largest)] if largest else []
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    at = lambda band, value: F.struct(F.lit(band).cast("long").alias("band"), value.cast("long").alias("value"))
    one = F.array(at(0, F.lit(0)))
    places = F.array(*[at(i + 1, F.col("hashes")[f].bitwiseAND(F.lit(signed(m)))) for i, (f, m) in enumerate(plan)]) if plan else one
    rows = beside(marks, large, keys, few).withColumn("_at", F.explode(F.when(F.col("_large"), places).otherwise(one)))
    cell = [*keys, "band", "value"]
    rows = rows.select("rep", "hashes", *keys, "_at.band", "_at.value")
    full = written(rows.groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk).select(*cell, F.ceil(F.col("_n") / chunk).cast("int").alias("_c"), "_n"), "full")
    rows = beside(rows, full, cell, few).withColumn("_c", F.coalesce("_c", F.lit(1)))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("_c"))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    # Keys by 128 bits; the pair of chunks beside the band. Which of the two a row is of comes last.
    pair = F.shiftleft(F.least("_own", "_other").cast("long"), 24).bitwiseOR(F.greatest("_own", "_other").cast("long"))
    group = [F.xxhash64(*keys, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), *keys).alias("k2"), "value", "band", pair.alias("pair")]
    rows = rows.select(*group, (F.col("_own") > F.col("_other")).cast("long").alias("side"), "rep", "hashes")
    tasks = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "k1", "value", "band", "pair").sortWithinPartitions("k1", "k2", "value", "band", "pair", "side")
    kind = dict(marks.dtypes)["rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, found in whole(batches, 5):
            hashes = t["hashes"].combine_chunks()
            h = np.ascontiguousarray(hashes.flatten().to_numpy().view(np.uint64).reshape(-1, s).T)
            band, side, reps = t["band"].to_numpy(), t["side"].to_numpy(), t["rep"].combine_chunks()
            pairs = t["pair"].to_numpy()
            for low, high in found.tolist():
                alone = pairs[low] >> 24 == pairs[low] & 0xFFFFFF
                split = low if alone else low + int(np.searchsorted(side[low:high], 1))
                for a, b, score in _near(h, low, high if alone else split, split, high, int(band[low]), plan, total, frame):
                    yield pa.record_batch([reps.take(pa.array(a)), reps.take(pa.array(b)), pa.array(score)], names=["a", "b", "score"])

    out = dealt.mapInArrow(run, f"a {kind}, b {kind}, score int")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a < b")


def _near(h: np.ndarray, low: int, stop: int, first: int, high: int, band: int, plan: list[tuple[int, int]], total: int, frame: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(a, b, score)`` of the rows low to stop with the rows first to high, each two once, that are similar and have not met under an earlier mask."""
    f = plan[band - 1][0] if band else 0
    wide = max(1, min(high - first, TILE // 64))
    for left in range(first, high, wide):
        right = min(left + wide, high)
        tall = max(1, TILE // (right - left))
        for top in range(low, min(stop, right) if low == first else stop, tall):
            bottom = min(top + tall, stop)
            near = np.flatnonzero(np.bitwise_count(h[f, top:bottom, None] ^ h[f, None, left:right]) <= frame)
            if not len(near):
                continue
            a, b = near // (right - left) + top, near % (right - left) + left
            if low == first:
                a, b = a[a < b], b[a < b]
            score = np.zeros(len(a), np.int32)
            held = np.ones(len(a), bool)
            differs = h[:, a] ^ h[:, b]
            for x in differs:
                n = np.bitwise_count(x)
                held &= n <= frame
                score += n
            held &= score <= total
            a, b, score, differs = a[held], b[held], score[held], differs[:, held]
            for g, m in plan[: max(band - 1, 0)]:
                if not len(a):
                    break
                new = (differs[g] & np.uint64(m)) != 0
                if not new.all():
                    a, b, score, differs = a[new], b[new], score[new], differs[:, new]
            if len(a):
                yield a, b, score


def _of_size(marks: DataFrame, s: int, plan: list[tuple[int, int, int]], test: tuple[Column, Column], keys: list[str], limit: int, few: int) -> DataFrame:
    cell = [*keys, "band", "value"]
    number = lambda f, k: f * len(plan) + k
    value = lambda f, k: F.shiftrightunsigned(F.col("hashes")[f], plan[k][0]).bitwiseAND(F.lit((1 << plan[k][1]) - 1))
    places = [F.struct(F.lit(number(f, k)).alias("band"), value(f, k).alias("value")) for f in range(s) for k in range(len(plan))]
    homes = marks.select("rep", "hashes", *keys, F.explode(F.array(*places)).alias("at")).select("rep", "hashes", *keys, "at.band", "at.value")
    # The flips of a band by its number; all hashes have the same bands.
    by_band = F.array(*[flips(w, r) for _, w, r in plan])
    near = lambda rows: rows.withColumn("value", F.explode(F.transform(F.get(by_band, F.col("band") % len(plan)), lambda x: x.bitwiseXOR(F.col("value")))))

    counts = written(homes.groupBy(cell).agg(F.count("*").alias("h")), "cells")
    most = max(reach(w, r) for _, w, r in plan)
    # Cells with fewer rows than that bring at most half of the limit to any cell near them.
    asked = near(counts.where(F.col("h") >= ceil(limit / (2 * most)))).groupBy(cell).agg(F.sum("h").alias("p")).where(F.col("p") > limit // 2)
    full = asked.join(counts.where(F.col("h") > limit), cell, "full").select(*cell, F.coalesce("h", F.lit(1)).alias("h"), (F.coalesce("p", F.lit(0)) + limit // 2).alias("p"))
    chunks = lambda c: F.ceil(F.col(c) / limit).cast("int")
    full = written(full.select(*cell, chunks("h").alias("hc"), chunks("p").alias("pc"), (F.col("h") + F.col("p")).alias("_n")), "full")

    def split(rows: DataFrame, own: str, other: str, salt: int) -> DataFrame:
        rows = beside(rows, full, cell, few).withColumn("hc", F.coalesce("hc", F.lit(1))).withColumn("pc", F.coalesce("pc", F.lit(1)))
        mine = F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(own)).cast("int")
        return rows.withColumn("_own", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("rep", "hashes", *cell, F.col("_own").alias(own), F.col("_other").alias(other))

    left, right = split(near(homes), "pc", "hc", 1).alias("a"), split(homes, "hc", "pc", 2).alias("b")
    same = (F.col("a.rep") < F.col("b.rep")) & test[1]
    for c in [*cell, "pc", "hc"]:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return left.join(right, same).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), test[0].cast("int").alias("score"))
