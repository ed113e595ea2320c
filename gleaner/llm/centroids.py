"""Centroid clustering of vectors by partial-distance search, in whole numbers throughout."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 64
#: Components up to this size have squared distances of 64 components within 64 bits.
SMALL = 1 << 26
#: A centroid with a component beyond this is farther from any small vector than every small centroid.
FAR = 1 << 32
#: Bits of a limb: sums are added up in limbs, so that numbers of any size are summed exactly.
LIMB = 30
LONGEST = (1 << 63) - 1
#: Vectors compared at a time, and dimensions between two looks at the bound.
ROWS, STEP = 2048, 8


def whole(x: float) -> int:
    """floor(64 * x), exactly, however large x is."""
    return math.floor(x * WIDTH) if abs(x) < 1 << 53 else int(x) * WIDTH


def grid(column: pa.ListArray) -> np.ndarray:
    """The vectors' components floor(64 * x); vectors with a component beyond ``SMALL`` as Python's numbers (dtype object)."""
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    with np.errstate(over="ignore"):
        v = np.floor(x * WIDTH)
    if np.abs(v).max(initial=0) <= SMALL:
        return v.astype(np.int64)
    return np.array([[whole(y) for y in row] for row in x.tolist()], object)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; of equal ones the smaller number.

    Dimensions are taken in ``order``, some at a time. The centroid that is nearest after the first of them gives the bound
    by its whole distance; a centroid is abandoned once its partial distance is strictly above the bound, and those that
    are left have been measured in all dimensions.
    """
    x, c = x[:, order], centroids[:, order]
    part = ((x[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(2)
    bound = ((x - c[part.argmin(1)]) ** 2).sum(1)
    row, k = np.nonzero(part <= bound[:, None])
    far = part[row, k]
    for at in range(STEP, x.shape[1], STEP):
        far = far + ((x[row, at : at + STEP] - c[k, at : at + STEP]) ** 2).sum(1)
        near = far <= bound[row]
        row, k, far = row[near], k[near], far[near]
    least = np.full(len(x), LONGEST, np.int64) if x.dtype != object else bound.copy()
    np.minimum.at(least, row, far)
    at_least = far == least[row]
    number = np.full(len(x), len(c), np.int64)
    np.minimum.at(number, row[at_least], k[at_least])
    return number, least


@dataclass
class Search:
    """Finds nearest centroids; ``centroids`` are lists of Python's numbers of any size."""

    centroids: list[list[int]]
    order: np.ndarray

    def __post_init__(self) -> None:
        largest = [max(map(abs, c)) for c in self.centroids]
        self.every = np.array(self.centroids, object)
        small = [k for k, m in enumerate(largest) if m <= SMALL]
        #: Numbers of the centroids that a small vector is compared with as 64-bit numbers; none where that would not do.
        self.numbers = np.array(small if small and all(m <= SMALL or m > FAR for m in largest) else [], np.int64)
        self.near = np.array([self.centroids[k] for k in self.numbers], np.int64)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if x.dtype != object and len(self.numbers):
            k, far = nearest(x, self.near, self.order)
            return self.numbers[k], far
        if x.dtype != object:
            return nearest(x.astype(object), self.every, self.order)
        small = np.array([max(map(abs, row)) <= SMALL for row in x.tolist()], bool)
        number, far = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        for rows, kind in ((small, np.int64 if len(self.numbers) else object), (~small, object)):
            if rows.any():
                number[rows], far[rows] = self(x[rows].astype(kind)) if kind is np.int64 else nearest(x[rows], self.every, self.order)
        return number, far


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole-number vectors, some thousand rows at a time."""
    for b in batches:
        for low in range(0, b.num_rows, ROWS):
            piece = b.slice(low, ROWS)
            yield piece.column(0), grid(piece.column(1))


def kept(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors with exactly 64 components, none null, NaN or infinite."""
    sound = "size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound)


def spread(table: DataFrame) -> np.ndarray:
    """The dimensions, those of the highest variance first. Only the speed of the search depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * WIDTH + 1)
        for _, x in blocks(batches):
            x = np.clip(x.astype(np.float64), -FAR, FAR)
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        yield pa.record_batch([pa.array([total.tolist()])], names=["s"])

    sums = [F.coalesce(F.sum(F.col("s")[i]), F.lit(0.0)) for i in range(2 * WIDTH + 1)]
    row = np.array(table.mapInArrow(run, "s array<double>").agg(F.array(*sums).alias("s")).first()[0])
    n = max(row[-1], 1)
    return np.argsort(-(row[WIDTH:-1] / n - (row[:WIDTH] / n) ** 2), kind="stable")


def moved(table: DataFrame, search: Search) -> list[list[int]]:
    """The centroids after one round: floor of the mean of the vectors nearest to each; one without vectors stays.

    A task gives a row for each centroid and limb, and these are summed by Spark; the driver gets one row for each of them.
    """
    number = len(search.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((number, WIDTH + 1), object)
        for _, x in blocks(batches):
            k, _ = search(x)
            for c in np.unique(k).tolist():
                mine = x[k == c]
                totals[c] += np.append(mine.sum(0).astype(object), len(mine))
        rows, limb = [], 0
        while totals.any():
            last = all(-(1 << LIMB) < y < 1 << LIMB for y in totals.flat)
            part = totals if last else totals % (1 << LIMB)
            rows += [(c, limb, [int(y) for y in part[c]]) for c in range(number) if part[c].any()]
            if last:
                break
            totals, limb = totals >> LIMB, limb + 1
        cluster, limbs, sums = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch([pa.array(cluster, pa.int32()), pa.array(limbs, pa.int32()), pa.array(sums, pa.list_(pa.int64()))], names=["cluster", "limb", "s"])

    added = table.mapInArrow(run, "cluster int, limb int, s array<bigint>").groupBy("cluster", "limb")
    totals = [[0] * (WIDTH + 1) for _ in range(number)]
    for r in added.agg(F.array(*[F.sum(F.col("s")[i]) for i in range(WIDTH + 1)]).alias("s")).collect():
        totals[r.cluster] = [t + (y << LIMB * r.limb) for t, y in zip(totals[r.cluster], r.s)]
    return [[y // t[-1] for y in t[:-1]] if t[-1] else c for t, c in zip(totals, search.centroids)]


def cluster(vectors: DataFrame, number: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """Clusters of the vectors ``(vec_id, embedding)``: a row for each vector that has 64 finite components.

    Columns: vec_id, cluster, distance (squared, to its centroid, in units of 1/64), cluster_inertia and inertia (distances
    summed over the cluster and over all), centroid_sha256 (of the centroid's components as decimal numbers joined by commas).

    Components become floor(64 * x). Centroids start as the vectors with the smallest hex sha256 of ``seed:vec_id``, and move
    ``rounds`` times to the floor of their vectors' mean; one without vectors stays. Distances and sums are exact for components
    of any size; where a distance or its sum is beyond a long, the column holds the largest long.

    Vectors that are null, of another length, or with null, NaN or infinite components are left out. A null vec_id is kept but
    no centroid starts there. Repeated ids and rows are vectors each; of starts with one hash the smaller components come first.
    With fewer vectors than centroids there are fewer centroids; an empty table, or one without a start, gives no rows. Extra
    columns are ignored. Only the starts and sums of ``number`` centroids reach the driver.
    """
    spark = vectors.sparkSession
    table = written(kept(vectors), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.where("vec_id is not null").select(hashed.alias("h"), F.col("embedding").cast("array<double>").alias("v")).orderBy("h", "v").limit(number).collect()
    made = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], made + ", cluster_inertia long, inertia long, centroid_sha256 string")
    search = Search([[whole(x) for x in r.v] for r in first], spread(table))
    for _ in range(rounds):
        search = Search(moved(table, search), search.order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches):
            k, far = search(x)
            yield pa.record_batch([ids, pa.array(k.astype(np.int32)), pa.array([min(y, LONGEST) for y in far.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    found = written(table.mapInArrow(run, made), "clusters")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in search.centroids]
    rows = [(k, min(s, LONGEST), min(sum(sums.values()), LONGEST), sha[k]) for k, s in sums.items()]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
