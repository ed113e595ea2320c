"""Near-duplicate embeddings by a pivot-permutation index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_pairs, written
from ..operators.components import Forest, connected_components


def _rows(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _apart(chosen: list[list[float]], apart: float, enough: int, most: float) -> np.ndarray:
    """Unit vectors of the chosen ones, without those whose cosine with an earlier one is over ``apart``.

    A crowd of near copies among the pivots would make the order of the nearest a matter of noise. Where fewer than
    ``enough`` are so far apart, as in a narrow cone, the bound goes up by halves as far as ``most``.
    """
    while True:
        points = _far(chosen, apart)
        if len(points) >= enough or apart >= most:
            return points
        apart = most if most - apart < 0.02 else (apart + most) / 2


def _far(chosen: list[list[float]], apart: float) -> np.ndarray:
    points = np.zeros((len(chosen), max(map(len, chosen), default=1)))
    kept = 0
    for p in chosen:
        x = np.zeros(points.shape[1])
        x[: len(p)] = np.array(p) / np.linalg.norm(p)
        if not kept or (points[:kept] @ x).max() <= apart:
            points[kept] = x
            kept += 1
    return points[:kept]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, nearest: int = 8, shared: int = 4, pivots_per_root: float = 4.0, most_pivots: int = 16_384, most_bytes: int = 1 << 26, list_limit: int = 1024, apart: float = 0.8) -> DataFrame:
    """Links between vectors of equal label with a cosine of ``threshold`` or more: ``(vec_id, n_links, component_id, kept)``.

    Equal vectors of a label are one class, represented by its smallest vec_id. Reference points (pivots) are the
    classes whose hash is below a threshold, about ``pivots_per_root`` times the square root of the number of classes, at least 64 and
    at most ``most_pivots`` or ``most_bytes`` of them: a bounded sample, and all that the index is fitted on, of which near copies go; in a
    narrow cone they may be nearer to each other, and with fewer than ``nearest`` of them ``shared`` goes down. Every class is described by its
    ``nearest`` pivots in order of cosine. Two classes are candidates if they share ``shared`` of them; then they share
    one of the first nearest - shared + 1 in the order of pivot numbers, and it is in those inverted lists that they
    meet, are counted once, and are verified in double precision. Lists longer than ``list_limit`` are
    compared in blocks. The index is approximate: a pair that shares fewer pivots is not found (recall is tested).

    n_links counts the other rows linked directly, copies included; component_id is the smallest vec_id reachable; kept
    says whether that is the row's own. A row links with nothing if its vec_id, label or vector is null, or its vector is
    empty, zero or holds null or non-finite components; then n_links is 0 and component_id its vec_id. Vectors of other
    lengths never link. Repeated rows are vectors of their own with one id. An empty table gives none.
    """
    v = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("digest", F.when(F.col("sound"), F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>")).cast("binary"))))
    rows = written(rows, "vectors")
    classes = rows.where("sound").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("v"))
    classes = written(classes.withColumn("key", F.xxhash64("label", F.size("v"))), "classes")

    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    n_pivots = min(most_pivots, most_bytes // (8 * width) + 1, max(64, pivots_per_root * math.sqrt(n)))
    draw = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 40))
    some = classes.where(draw < int((1 << 40) * min(1.0, n_pivots / max(n, 1)))).select("v", draw.alias("draw"), "rep")
    chosen = [r.v for r in sorted(some.collect(), key=lambda r: (r.draw, r.rep))]  # about n_pivots vectors
    points = _apart(chosen, apart, 4 * nearest, 1 - 2 * (1 - threshold))
    nearest = min(nearest, len(points))
    shared = min(shared, (nearest + 1) // 2)  # with so few pivots all classes of a label meet, and are compared exactly
    known = rows.sparkSession.sparkContext.broadcast(points)  # at most most_pivots vectors
    first = nearest - shared + 1

    def describe(batches):
        base = known.value
        step = max(1, (1 << 20) // max(1, len(base)))  # some 8 MB of cosines at once
        for b in batches:  # lists of one length are multiplied together
            top = np.zeros((b.num_rows, nearest), np.int32)
            lengths = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                for low in range(0, len(at), step):
                    some = at[low : low + step]
                    x = _rows(b.column(0).take(pa.array(some)))
                    near = x[:, : base.shape[1]] @ base[:, :n].T
                    top[some] = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
            yield pa.record_batch([b.column(1), b.column(2), b.column(3), b.column(0), pa.array(top.tolist(), pa.list_(pa.int32()))], names=["rep", "n", "key", "v", "order"])

    kind = dict(classes.dtypes)["v"]
    described = written(classes.select("v", "rep", "n", "key").mapInArrow(describe, f"rep long, n long, key long, v {kind}, `order` array<int>"), "described")
    listed = described.withColumn("pivot", F.explode(F.slice(F.array_sort("order"), 1, first)))
    listed = chunk_pairs(listed, ["key", "pivot"], "rep", list_limit)

    def compare(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        rep, n, own = (t[c].to_numpy() for c in ("rep", "n", "own"))
        pivot, x, order = t["pivot"][0].as_py(), _rows(t["v"].combine_chunks()), np.sort(_rows(t["order"].combine_chunks()).astype(np.int64), axis=1)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        used, at = np.unique(order, return_inverse=True)
        has = np.zeros((len(rep), len(used)), np.float32)
        has[np.arange(len(rep))[:, None], at.reshape(order.shape)] = 1
        met = np.zeros_like(has)  # lists of smaller numbers in which a pair has met
        earlier = order[:, :first] < pivot
        met[np.nonzero(earlier)[0], at.reshape(order.shape)[:, :first][earlier]] = 1
        near = (has @ has.T >= shared) & (met @ met.T == 0)
        near &= x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if t["lo"][0].as_py() != t["hi"][0].as_py():
            near &= own[:, None] != own[None, :]
        links = near @ n
        forest, a, b = Forest(), [], []
        for i, j in zip(*(k.tolist() for k in np.nonzero(np.triu(near)))):
            if forest.join(int(rep[i]), int(rep[j])):
                a.append(int(rep[i]))
                b.append(int(rep[j]))
        some = links > 0
        return pa.table({"a": pa.array([*rep[some].tolist(), *a], pa.int64()), "b": pa.array([None] * int(some.sum()) + b, pa.int64()), "links": pa.array([*links[some].tolist(), *[None] * len(a)], pa.int64())})

    found = written(listed.groupBy("key", "pivot", "lo", "hi").applyInArrow(compare, "a long, b long, links long"), "links")
    counted = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = connected_components(found.where("links is null").select("a", "b")).withColumnRenamed("node", "rep")
    final = classes.select("label", "digest", "rep", "n").join(counted, "rep", "left").join(named, "rep", "left")
    final = final.select("label", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "label", "digest").join(final, ["label", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
