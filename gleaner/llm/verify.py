"""Exact Jaccard verification of candidate groups, whole groups at a time."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import Forest

COLUMNS = 4096
#: Groups of so many members are compared pair by pair, and rows that a task looks at together, whole groups at a time.
FEW, TOGETHER = 12, 1024


def distinct_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(g, id)``: groups of ``keys`` with two members or more, and of groups with the same members one."""
    members = rows.select(F.xxhash64(*keys).alias("g"), "id").distinct()
    alike = members.groupBy("g").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(3)).cast("decimal(38,0)")).alias("s"))
    one = alike.where("n > 1").groupBy("n", "x", "s").agg(F.min("g").alias("g"))
    return members.join(one.select("g"), "g", "left_semi")


def similar_edges(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: for each group g of ``groups(g, id)`` a spanning forest of its pairs with Jaccard >= threshold.

    ``sets(id, shingles)`` holds each member's distinct shingle hashes (sorted unsigned 64 bits, as binary). All
    pairs of a group are compared by exact set sizes; groups are bounded by whoever made them. Sets without members are
    equal to each other.
    """
    kind = dict(sets.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, members, bounds in whole_groups(batches):
            a, b = [], []
            for low, high in bounds:
                near = Forest()
                for i, j in similar_pairs(members[low:high], threshold):
                    if near.join(i, j):
                        a.append(ids[low + i])
                        b.append(ids[low + j])
            yield pa.record_batch([pa.array(a, pa.string() if kind == "string" else pa.int64()), pa.array(b, pa.string() if kind == "string" else pa.int64())], names=["a", "b"])

    rows = groups.join(sets, "id").select("g", "id", "shingles")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, f"a {kind}, b {kind}")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], list[tuple[int, int]]]]:
    """Ids, sets and the bounds of the groups among them, of rows ``(g, id, shingles)`` sorted by g; no group is in two yields."""
    last, ids, sets, bounds = None, [], [], []
    for b in batches:
        for g, i, x in zip(*(c.to_pylist() for c in b.columns)):
            if g != last:
                if len(ids) >= TOGETHER:
                    yield ids, sets, list(zip(bounds, [*bounds[1:], len(ids)]))
                    ids, sets, bounds = [], [], []
                bounds.append(len(ids))
                last = g
            ids.append(i)
            sets.append(np.frombuffer(x, "<u8"))
    if ids:
        yield ids, sets, list(zip(bounds, [*bounds[1:], len(ids)]))


def similar_pairs(members: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """All pairs i < j of sets whose Jaccard similarity is at least the threshold."""
    if len(members) <= FEW:
        out, held = [], [frozenset(m.tolist()) for m in members]
        for i, j in itertools.combinations(range(len(members)), 2):
            n, m = len(held[i]), len(held[j])
            if min(n, m) >= threshold * max(n, m):
                both = len(held[i] & held[j])
                if both >= threshold * (n + m - both):
                    out.append((i, j))
        return out
    sizes = np.array([len(m) for m in members], np.int64)
    shingles, at = np.unique(np.concatenate(members), return_inverse=True)
    of = np.repeat(np.arange(len(members)), sizes)
    both = np.zeros((len(members), len(members)), np.float32)
    shared = np.flatnonzero(np.bincount(at, minlength=len(shingles)) > 1)  # the others are in no intersection
    column = np.full(len(shingles), -1)
    column[shared] = np.arange(len(shared))
    column = column[at]
    for low in range(0, len(shared), COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        has = np.zeros((len(members), min(COLUMNS, len(shared) - low)), np.float32)
        has[of[here], column[here] - low] = 1
        both += has @ has.T
    near = both >= threshold * (sizes[:, None] + sizes[None, :] - both)
    i, j = np.nonzero(np.triu(near, 1))
    return list(zip(i.tolist(), j.tolist()))
