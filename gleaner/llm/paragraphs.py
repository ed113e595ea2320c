"""Substring dedup: paragraphs that repeat across documents, by MinHash bands, exact Jaccard and components; and verbatim passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_pairs, lookup, settled, written
from ..operators.components import connected_components
from .decontaminate import shingles
from .passages import bit_filter, passes, repeated_passages
from .verify import distinct_groups, similar_edges
from .words import BASE, Chunk, Grams, chunks, mixed

PARAGRAPHS = "doc_id long, para int, start int, length int, whole boolean, id long"


def permutations(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def all_bands(hashes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """The band keys of many sets at once: a set is the run of hashes from its start to the next one's."""
    low, keys = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32), []
    for k in range(len(a) // rows):
        key = np.full(len(starts), k + 1, np.uint64)
        for i in range(k * rows, k * rows + rows):
            v = low * a[i] + b[i]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            key = mixed(key * np.uint64(BASE) + np.minimum.reduceat(v, starts))
        keys.append(key.view(np.int64))
    return np.stack(keys, 1)


@dataclass(frozen=True)
class Layout:
    """What the units of a text are: ``width`` words make a shingle; other names as ``Units`` says."""

    width: int = 5
    shortest: int = 16
    size: int = 50
    long: int = 200
    every: int = 32


class Units:
    """The units of a chunk of texts that are compared as paragraphs: lines, and windows where lines say little.

    A unit is every line of ``shortest`` words or more. Besides, ``size`` words from a place on make a window, whatever lines they
    stand in (fewer at the end of a text, from its last ``shortest`` words on at least): where a line of fewer words
    begins, and in lines of ``long`` words or more at words that their own and the next word's hash choose, about one of
    ``every``. So wrapped paragraphs meet at their lines and text without lines at equal words, and every word of a text
    of ``width`` words is within a unit; a shorter line (a sentence that many texts have) says something only with what follows it. Windows begin more than ``width`` words apart: two of one text are not alike for that they overlap.
    """

    def __init__(self, c: Chunk, grams: Grams, layout: Layout):
        width, shortest, end_of = layout.width, layout.shortest, c.bounds[1:]
        start, end = c.lines
        low, high = np.searchsorted(c.start, start), np.searchsorted(c.start, end)
        lines = np.flatnonzero(high - low >= max(shortest, width))
        begin = low[(high - low < max(shortest, width)) & (high > low)]
        if (long := np.flatnonzero(high - low >= layout.long)).size:
            n = high[long] - low[long] - width
            at = np.repeat(low[long] + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
            chosen = mixed(c.hash[at] * np.uint64(BASE) + c.hash[at + 1]) % np.uint64(layout.every) == 0
            begin = np.sort(np.concatenate([begin, at[chosen]]))
        doc = c.doc[begin] if len(begin) else begin
        begin = np.maximum(c.bounds[doc], np.minimum(begin, end_of[doc] - shortest))
        stop = np.minimum(begin + layout.size, end_of[doc])
        good, last, of = np.zeros(len(begin), bool), 0, -1
        for i, (x, d) in enumerate(zip(begin.tolist(), doc.tolist())):
            if x - last > width or d != of:
                good[i], last, of = True, x, d
        good &= stop - begin >= width
        good &= ~np.isin(begin << 24 | stop - begin, low[lines] << 24 | high[lines] - low[lines])  # a window that is a line
        begin, stop, doc = begin[good], stop[good], doc[good]
        self.low, self.high = np.concatenate([low[lines], begin]), np.concatenate([high[lines], stop])
        self.start, self.end = np.concatenate([start[lines], c.start[begin]]), np.concatenate([end[lines], c.end[stop - 1]])
        self.doc = np.concatenate([np.searchsorted(c.offsets, start[lines], "right") - 1, doc])
        self.para = np.concatenate([lines, np.searchsorted(start, c.start[begin], "right") - 1]) - c.lines_before[self.doc]
        self.whole = np.arange(len(self.low)) < len(lines)
        self.id = grams.between(grams.sums(c.hash), self.low, self.high).view(np.int64)

    def shingles(self, c: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of all units, one unit after the other, and where each begins."""
        n = self.high - self.low - width + 1
        starts = np.cumsum(n) - n
        return shingles(c.hash, width)[np.repeat(self.low - starts, n) + np.arange(n.sum())], starts


def paragraphs(docs: DataFrame, layout: Layout, n_bands: int, rows: int) -> DataFrame:
    """Every unit (see ``Units``): its place, whether it is a whole line, a digest of its words, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(n_bands * rows)
        grams = Grams()
        for batch in batches:
            ids = batch.column(0)
            for first, _, c in chunks(batch.column(1)):
                x = Units(c, grams, layout)
                if not len(x.id):
                    continue
                keys = all_bands(*x.shingles(c, layout.width), a, b, rows)
                start, length = c.chars[x.start] - c.chars[c.offsets[x.doc]], c.chars[x.end] - c.chars[x.start]
                places = [pa.array(v.astype(np.int32)) for v in (x.para, start, length)]
                yield pa.record_batch([ids.take(pa.array(first + x.doc)), *places, pa.array(x.whole), pa.array(x.id), *map(pa.array, np.ascontiguousarray(keys.T))], names=[f.split()[0] for f in schema.split(", ")])

    schema = ", ".join([PARAGRAPHS, *[f"b{k} long" for k in range(n_bands)]])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, layout: Layout, wanted=None) -> DataFrame:
    """``(id, shingles)``: digest and distinct shingle hashes of every unit, or of those alone whose ids are in the sorted array that ``wanted`` broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for _, _, c in chunks(batch.column(0)):
                x = Units(c, grams, layout)
                if not len(x.id):
                    continue
                ids, at = np.unique(x.id, return_index=True)
                if wanted is not None:
                    some = wanted.value[np.minimum(np.searchsorted(wanted.value, ids), len(wanted.value) - 1)] == ids
                    ids, at = ids[some], at[some]
                    if not len(ids):
                        continue
                found, starts = x.shingles(c, layout.width)
                stops = np.append(starts[1:], len(found))
                yield pa.record_batch([pa.array(ids), pa.array([np.unique(found[starts[i] : stops[i]]).tobytes() for i in at.tolist()], pa.binary())], names=["id", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "id long, shingles binary")


def in_bands(classes: DataFrame, across: DataFrame) -> DataFrame:
    """``(id, band)``: the bands of each class ``(id, b0, b1, ...)`` that are in ``across``, and few others, that pass its filter of bits.

    Nothing is shuffled but ``across``. A band that passes by chance has one class, and makes no pair.
    """
    bits = classes.sparkSession.sparkContext.broadcast(bit_filter(across.select(F.col("band").alias("m")), 4 * across.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for keys in (c.to_numpy() for c in batch.columns[1:]):
                held = passes(bits.value, keys.view(np.uint64))
                yield pa.record_batch([pa.array(ids[held]), pa.array(keys[held])], names=["id", "band"])

    return classes.mapInArrow(run, "id long, band long")


def repeated_paragraphs(docs: DataFrame, layout: Layout = Layout(), threshold: float = 0.8, n_bands: int = 10, rows: int = 4, group_limit: int = 1024, few: int = 1_000_000) -> DataFrame:
    """Paragraphs that repeat across documents: ``(doc_id, para, start, length, whole, cluster_doc, cluster_para, kept)``.

    Paragraphs are the lines and windows that ``Units`` tells of; whole says which. Words are runs of letters and digits, in lower case. Equal ones
    are one class. Classes that share a MinHash band (``n_bands`` of ``rows``: a pair with similarity 0.8 shares one with a chance of
    0.995) are compared by the exact Jaccard similarity of their shingles of ``width`` words, and those of
    ``threshold`` or more are linked; a component that occurs in two documents or more is a cluster. Its first
    occurrence by doc_id and place is kept, and so are windows of the same document; kept is false for the ones to remove. start and
    length are in characters, para is the line that a unit begins in.

    Bands with many classes are compared in blocks of ``group_limit``, every pair once. Null and empty texts, and those of fewer than
    ``width`` words, have no units; texts and lines of any length are read whole. Repeated rows (one doc_id) are one document. A null doc_id
    is passed over. Of equal paragraphs in one document each is a row. An empty table gives none. Extra columns are ignored.
    """
    every = written(paragraphs(docs.where("doc_id is not null"), layout, n_bands, rows), "paragraphs")
    bands = [f"b{k}" for k in range(n_bands)]
    once = written(every.groupBy("id").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *[F.first(b).alias(b) for b in bands]), "classes")
    banded = once.select("id", F.explode(F.array(*bands)).alias("band"))
    across = written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "bands")  # unlike paragraphs meet there
    banded = written(in_bands(once.select("id", *bands), across), "banded")
    pairs = written(distinct_groups(chunk_pairs(banded, ["band"], "id", group_limit), ["band", "lo", "hi"]), "groups")
    # Shingles are made for colliding classes alone, again from the text of their first occurrences.
    colliding = written(once.join(pairs.select("id").distinct(), "id", "left_semi").select("id", F.col("low").alias("doc_id")), "colliding")
    n = colliding.count()  # 16 bytes each: broadcast only while they are few
    held = F.broadcast(colliding) if n <= few else colliding
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(colliding.select("id").toArrow().column(0).to_numpy())) if 0 < n <= few else None
    texts = docs.select("doc_id", "text").join(held.select("doc_id"), "doc_id", "left_semi")
    sets = shingle_sets(texts, layout, wanted).join(held.select("id"), "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles"))
    named = connected_components(similar_edges(pairs, sets, threshold)).select(F.col("node").alias("id"), "component")

    classes = once.select("id", "low", "high").join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    clusters = classes.groupBy("component").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("component")
    of = written(classes.select("id", "component").join(clusters, "component").select("id", "component"), "clusters")
    found = written(lookup(every.select("doc_id", "para", "start", "length", "whole", "id"), of, ["id"]).drop("id"), "found")
    place = F.struct("doc_id", "para", "start", "length")
    first = written(found.groupBy("component").agg(F.min(place).alias("first")), "first")
    kept = F.when(F.col("whole"), place == F.col("first")).otherwise(F.col("doc_id") == F.col("first.doc_id")).alias("kept")
    return lookup(found, first, ["component"]).select("doc_id", "para", "start", "length", "whole", F.col("first.doc_id").alias("cluster_doc"), F.col("first.para").alias("cluster_para"), kept)


COLUMNS = ["doc_id", "para", "start", "length", "cluster_doc", "cluster_para", "kept"]


def not_within(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The ``rows`` that do not lie wholly within one of the ``others`` of the same document. One to remove may lie only within another to remove."""
    end = (F.col("start") + F.col("length")).alias("end")
    held = others.groupBy("doc_id").agg(F.collect_list(F.struct("start", end, "kept")).alias("others"))
    within = F.exists("others", lambda x: (x["start"] <= F.col("start")) & (x["end"] >= F.col("start") + F.col("length")) & (F.col("kept") | ~x["kept"]))
    return rows.join(held, "doc_id", "left").where(~F.coalesce(within, F.lit(False))).drop("others")


def merged(windows: DataFrame) -> DataFrame:
    """Windows of one document that overlap, with the same document as their first, become one row."""
    same = Window.partitionBy("doc_id", "cluster_doc", "kept").orderBy("start", "length")
    before = F.max(F.col("start") + F.col("length")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    apart = windows.withColumn("apart", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    part = apart.withColumn("part", F.sum("apart").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    whole = part.groupBy("doc_id", "cluster_doc", "kept", "part").agg(F.min("para").alias("para"), F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.min("cluster_para").alias("cluster_para"))
    return whole.withColumn("length", (F.col("end") - F.col("start")).cast("int")).select(COLUMNS)


def repeated_texts(docs: DataFrame, layout: Layout = Layout(), size: int = 50) -> DataFrame:
    """Repeated paragraphs, and repeated passages of ``size`` words or more that lie in longer lines or run across lines.

    The lines of ``repeated_paragraphs``; the rows of ``repeated_passages`` that are not wholly within one of them in the same
    document; and the windows of ``repeated_paragraphs`` that are within neither, overlapping ones as one row. What is to be removed counts as
    within another row only if that is to be removed too. Nulls, empty and long texts, repeated rows, ties and empty tables
    are treated as these two say.
    """
    units = settled(lambda: repeated_paragraphs(docs, layout), "units")
    passages = settled(lambda: repeated_passages(docs, size), "passages")
    lines = units.where("whole").select(COLUMNS)
    verbatim = lines.unionByName(not_within(passages, lines))
    return verbatim.unionByName(merged(not_within(units.where("not whole").drop("whole"), lines.unionByName(passages))))
