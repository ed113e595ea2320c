"""Joins that no single key burdens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], few: int = 200_000) -> DataFrame:
    """``rows`` joined with ``table``, which is written, narrow and has one row for each key.

    The table is broadcast while it is counted to have at most ``few`` rows. Beyond that the keys with over a
    ``few``-th of all rows are looked up in a broadcast part of it, and the others in a join by key: no key burdens a task.
    """
    if table.count() <= few:
        return rows.join(F.broadcast(table), keys)
    counts = written(rows.join(table.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n")), "counts")
    floor = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] // max(few, 1)
    largest = written(table.join(counts.where(F.col("_n") > floor).drop("_n"), keys, "left_semi"), "largest")  # fewer than few
    others = rows.join(F.broadcast(largest.select(*keys)), keys, "left_anti").join(table, keys)
    return rows.join(F.broadcast(largest), keys).unionByName(others)


def beside(rows: DataFrame, large: DataFrame, keys: list[str], few: int = 100_000) -> DataFrame:
    """``rows`` left-joined with ``large``, a written list of the keys of large groups with their rows ``_n``.

    The list is broadcast while it is counted to have at most ``few`` rows; of a longer one the largest groups are, so that
    no large group goes to one task of the join with the others.
    """
    if large.count() <= few:
        return rows.join(F.broadcast(large.drop("_n")), keys, "left")
    floor = large.agg(F.sum("_n")).first()[0] // max(few, 1)
    largest, others = (F.broadcast(large.where(F.col("_n") > floor).drop("_n")), large.where(F.col("_n") <= floor).drop("_n"))  # fewer than few are over the floor
    return rows.join(largest, keys).unionByName(rows.join(largest.select(*keys), keys, "left_anti").join(others, keys, "left"))


def left_lookup(rows: DataFrame, table: DataFrame, keys: list[str], few: int = 200_000) -> DataFrame:
    """``lookup`` that keeps the rows without a match, with nulls: neither a common key of the table nor one that it lacks burdens a task."""
    if table.count() <= few:
        return rows.join(F.broadcast(table), keys, "left")
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "counts")
    floor = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] // max(few, 1)
    common = written(counts.where(F.col("_n") > floor).select(*keys), "common")  # fewer than few
    held = written(table.join(F.broadcast(common), keys, "left_semi"), "largest")
    some = rows.join(F.broadcast(common), keys, "left_semi").join(F.broadcast(held), keys, "left")
    return some.unionByName(rows.join(F.broadcast(common), keys, "left_anti").join(table, keys, "left"))
