"""Numbers and running sums over a whole ordered table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .joins import lookup

#: monotonically_increasing_id: the partition above this bit, the place in it below.
PLACE = 33


def numbered(rows: DataFrame, order: list[str], name: str = "n", totals: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with their number ``name`` (from 1) in the order of the columns ``order``, and running sums up to each row.

    ``totals`` maps the names of sums to long columns; a null counts nothing. Rows are parted into ranges of the order (a sampled
    sort) and written with their places; the ranges' counts and sums are added up, a row for each range; and within a range
    sums run in the order of places. Rows that tie go to one range: where many do, give a further column that parts
    them. Numbers of rows that tie in all are in no particular order.
    """
    totals = totals or {}
    at = F.monotonically_increasing_id()
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(f"_{k}") for k, c in totals.items()]
    placed = rows.select("*", *sums).orderBy(*order).withColumn("_at", at)
    placed = written(placed.withColumn("_part", F.shiftright("_at", PLACE)).withColumn("_place", F.col("_at").bitwiseAND((1 << PLACE) - 1)).drop("_at"), "placed")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(f"_{k}").alias(f"_{k}") for k in totals]).orderBy("_part").collect()  # a row for each range
    before, starts = [0] * (1 + len(totals)), []
    for r in counts:
        starts.append((r["_part"], *before))
        before = [b + r[c] for b, c in zip(before, ["_n", *[f"_{k}" for k in totals]])]
    kind = ", ".join(["_part long", "_first long", *[f"_before_{k} long" for k in totals]])
    starts = placed.sparkSession.createDataFrame(starts, kind)
    out = placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_first") + F.col("_place") + 1)
    for k in totals:
        out = out.withColumn(k, F.col(f"_before_{k}") + F.expr(f"sum(_{k}) over (partition by _part order by _place rows between unbounded preceding and current row)"))
    return out.select(*rows.columns, name, *totals)


def within(rows: DataFrame, group: list[str], order: list[str], name: str = "n", totals: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with their number within their group, in the order of the columns ``order``, and running sums within it of columns that are not negative.

    The numbers over all, less those at which the group begins: a group of any size is many tasks' work.
    """
    totals = totals or {}
    own = rows.select("*", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"_own_{k}") for k, c in totals.items()])
    every = written(numbered(own, [*group, *order], name, {k: F.col(f"_own_{k}") for k in totals}), "numbered")
    starts = every.groupBy(*group).agg((F.min(name) - 1).alias("_first"), *[F.min(F.col(k) - F.col(f"_own_{k}")).alias(f"_start_{k}") for k in totals])
    out = lookup(every, written(starts, "starts"), group)
    less = [(F.col(k) - F.col(f"_start_{k}")).alias(k) for k in totals]
    return out.select(*rows.columns, (F.col(name) - F.col("_first")).alias(name), *less)
