"""Perceptual near-duplicates: difference hashes, blocking, Hamming pairs and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .components import connected_components, thinned
from .hamming import hamming, links  # noqa: F401
from .joins import lookup


def dhash(pixels: Column, at: int = 0, width: int = 9, height: int = 8) -> Column:
    """A bit for each pixel but the last of a row, row by row, the first the highest: whether it is lighter than its right neighbour.

    The gray frame of ``width`` by ``height`` pixels begins at byte ``at``; it gives at most 64 bits, and a shorter content is an error.
    """
    bits = (width - 1) * height
    if width < 2 or not 1 <= bits <= 64:
        raise ValueError("a frame has from 1 to 64 neighbours in rows")
    byte = lambda n, more: F.substring(pixels, (n + F.floor(n / (width - 1)) + (at + 1 + more)).cast("int"), F.lit(1))
    lighter = lambda n: F.when(byte(n, 0) > byte(n, 1), 1).otherwise(0).cast("long")
    out = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda h, n: F.shiftleft(h, 1).bitwiseOR(lighter(n)))
    return F.when(F.octet_length(pixels) < at + width * height, F.raise_error(F.lit("not enough pixels"))).otherwise(out)


def prefix(h: Column) -> Column:
    return F.shiftrightunsigned(h, 48)


def image_key() -> Column:
    return F.struct(F.floor(F.col("width") / 64).alias("w"), F.floor(F.col("height") / 64).alias("h"), prefix(F.col("h")).alias("p"))


def video_key(bucket: int = 2) -> Column:
    d = F.col("duration")
    aspect = F.when(F.col("height") > 0, F.rint(F.col("width") / F.col("height") * 10)).otherwise(0.0).cast("long")
    length = (F.greatest(d - d % bucket, F.lit(0.0)) / bucket).cast("long") if bucket > 0 else F.lit(0).cast("long")
    return F.struct(length.alias("d"), aspect.alias("a"), prefix(F.col("hashes")[0]).alias("p"))


def marked(rows: DataFrame, key: Column | None, mark: str) -> tuple[DataFrame, DataFrame]:
    """``classes`` and ``members`` as ``class_pairs`` has them, without a look at which classes are similar."""
    hashes = F.col(mark) if dict(rows.dtypes)[mark].startswith("array") else F.array(mark)
    members = rows.where(F.col(mark).isNotNull()).select("path", (F.lit(0) if key is None else key).alias("key"), hashes.alias("hashes"))
    members = written(members, "marks")
    return written(members.groupBy("key", "hashes").agg(F.min("path").alias("rep"), F.count("*").alias("n")), "classes"), members


def class_pairs(rows: DataFrame, key: Column | None, mark: str, total: int, frame: int, limit: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All similar pairs of ``rows(path, mark, ...)`` without writing out those of equal marks.

    ``classes(key, hashes, rep, n)``: rows with one key and equal marks, n of them, the first path of which is rep; ``links(a, b,
    pairs, score)``: the reps of similar classes (a before b) and how many pairs of rows they stand for; ``members(path, key, hashes)``.
    A frame that occurs very often (a black one) is one class and not the square of its rows. ``mark`` is a hash or an array of hashes: classes with as
    many are similar if each two differ in at most ``frame`` bits and all in ``total``; equal ones are, with score 0. Without a
    ``key`` all are compared with all. Pairs are found by the index of ``hamming.links``, so that neither a common key nor
    a missing one makes a task compare all. Rows without a mark take no part.
    """
    classes, members = marked(rows, key, mark)
    # The number of rows goes with the rep: there may be many more links than classes, which no join has to look up.
    found = links(classes.select(F.struct("rep", "n").alias("rep"), "key", "hashes"), total, frame, ["key"], limit).where("a.rep < b.rep")
    pairs = found.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), (F.col("a.n") * F.col("b.n")).alias("pairs"), "score")
    return classes, written(pairs, "links"), members


def image_links(rows: DataFrame, threshold: int = 8, blocking: str = "exact") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``class_pairs`` of images ``(path, h, width, height)`` whose hashes differ in at most ``threshold`` bits.

    ``blocking`` is ``exact`` (those of similar shape whose first 16 bits agree) or ``none`` (all).
    """
    return class_pairs(rows, blocked(blocking, image_key()), "h", threshold, threshold)


def video_links(rows: DataFrame, total: int = 32, frame: int = 12, bucket: int = 2, blocking: str = "exact") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``class_pairs`` of videos ``(path, hashes, width, height, duration)`` of as many frames, within a limit for each frame and for all."""
    return class_pairs(rows, blocked(blocking, video_key(bucket)), "hashes", total, frame)


def blocked(blocking: str, key: Column) -> Column | None:
    if blocking not in ("exact", "none"):
        raise ValueError(f"blocking is exact or none, not {blocking!r}")
    return key if blocking == "exact" else None


def named_members(classes: DataFrame, members: DataFrame) -> DataFrame:
    """``(path, rep)``: the class of every row, by its first path. A common mark burdens no task."""
    return lookup(members, classes.select("key", "hashes", "rep"), ["key", "hashes"]).select("path", "rep")


def clusters(classes: DataFrame, edges: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of what ``class_pairs`` gives: ``(first_path, n_paths, pairs, min_score, max_score)`` and their members ``(first_path, path)``."""
    named = written(connected_components(thinned(edges.select("a", "b"))), "named")
    labelled = classes.join(named.withColumnRenamed("node", "rep"), "rep", "left").select("key", "hashes", "n", F.coalesce("component", "rep").alias("first_path"))
    within = labelled.where("n > 1").select("first_path", F.expr("n * (n - 1) div 2").alias("pairs"), F.lit(0).alias("score"))
    sums = lambda pairs, low, high: [F.sum(pairs).alias("pairs"), F.min(low).alias("min_score"), F.max(high).alias("max_score")]
    across = edges.groupBy("a").agg(*sums("pairs", "score", "score")).join(named.withColumnRenamed("node", "a"), "a")
    within = within.select("first_path", "pairs", F.col("score").alias("min_score"), F.col("score").alias("max_score"))
    summed = within.union(across.select(F.col("component").alias("first_path"), "pairs", "min_score", "max_score")).groupBy("first_path").agg(*sums("pairs", "min_score", "max_score"))
    sized = written(summed.join(labelled.groupBy("first_path").agg(F.sum("n").alias("n_paths")), "first_path"), "summary")
    of = written(labelled.join(sized.select("first_path"), "first_path", "left_semi").select("key", "hashes", "first_path"), "members")
    return sized.select("first_path", "n_paths", "pairs", "min_score", "max_score"), lookup(keyed, of, ["key", "hashes"]).select("first_path", "path")


def image_clusters(rows: DataFrame, threshold: int = 8, blocking: str = "exact") -> tuple[DataFrame, DataFrame]:
    return clusters(*image_links(rows, threshold, blocking))


def video_clusters(rows: DataFrame, total: int = 32, frame: int = 12, bucket: int = 2, blocking: str = "exact") -> tuple[DataFrame, DataFrame]:
    return clusters(*video_links(rows, total, frame, bucket, blocking))
