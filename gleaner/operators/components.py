"""Distributed connected components over an edge table: rounds of DataFrame operations, and forests to thin edges before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, written


class Forest:
    """Union-find over values; an edge is new only where it joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def thinned(edges: DataFrame, block: int = 1 << 17) -> DataFrame:
    """Edges ``(a, b)`` with the same components and fewer rows: of every block of about ``block`` edges a spanning forest.

    A group whose members met in many places comes with many edges that say the same; they go before anything is shuffled by
    node. ``edges`` is a written table, read here without a shuffle; the pass is repeated while it at least halves the
    rows and more than one block is left. A task holds one block's forest at a time, however large its partition is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Forest()
        for b in batches:
            new = [near.join(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield b.filter(pa.array(new, pa.bool_()))
            if len(near.up) > block:
                near = Forest()

    kind, rows = ", ".join(f"{k} {t}" for k, t in edges.dtypes), edges.count()
    while rows:
        following = written(edges.where("a is not null and b is not null").coalesce(-(-rows // block)).mapInArrow(run, kind), "thinned")
        left = following.count()
        forget(edges)
        edges, before, rows = following, rows, left
        if before <= block or 2 * left > before:
            break
    return edges


#: From so many edges on, nodes with a large part of them are looked up apart. Results are the same.
HEAVY = 100_000


def hubs(rows: DataFrame, key: str, total: int, tasks: int) -> DataFrame:
    """``(key)``: the nodes that more than half of a task's share of ``total`` rows have; fewer than twice as many as there are tasks."""
    return rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * 2 * tasks > total).select(key)


def met(rows: DataFrame, table: DataFrame, key: str, how: str, hub: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key``.

    Rows of a ``hub`` stay in the tasks that they are in and meet a broadcast of its few rows; only the others are shuffled by
    key, so that a node with a million edges is not one task's work.
    """
    if hub is None:
        return rows.join(table, key, how)
    hub = F.broadcast(hub)
    few = F.broadcast(table.join(hub, key, "left_semi"))
    return rows.join(hub, key, "left_anti").join(table, key, how).unionByName(rows.join(hub, key, "left_semi").join(few, key, how))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node that can be reached.

    Alternating large-star and small-star rounds on the edges, each directed from the larger to the smaller node.
    The smallest neighbour of each node is a partial aggregate and the joins are equi-joins against one row for each
    node; of ``HEAVY`` edges or more, those of hubs are joined where they are and never shuffled by their hub. No neighbour
    list is ever built. Every round is written to the shared folder.

    Null ends, self-loops and repeated edges are dropped. No edges: no rows. Any orderable type of node will do.
    """
    e = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct(), "edges"
    )
    state, tasks = _state(e), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        heavy, hub = state[0] >= HEAVY, None
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        if heavy:
            least, hub = written(least, "least"), written(hubs(e, "v", state[0], tasks), "hubs")
        large = met(e, least.select(F.col("u").alias("v"), "m"), "v", "left", hub).select("u", F.coalesce("m", "v").alias("v")).distinct()
        made = [least, hub] if heavy else []
        if heavy:
            large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        if heavy:
            least, hub = written(least, "least"), written(hubs(large, "u", state[0], tasks), "hubs")
            made += [large, least, hub]
        small = met(large, least, "u", "inner", hub).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(following)
        forget(e, *made)
        e, changed, state = following, after != state, after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    """Equal for equal edge tables: rows and a hash that doesn't depend on their order."""
    row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
