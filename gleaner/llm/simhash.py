"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are compared through the words of covering codes. The 64 bits are dealt to disjoint blocks, and
the threshold is dealt to the blocks as t_i with sum(t_i + 1) = t + 1: two fingerprints that differ in at most t bits
differ in at most t_i bits of some block. In that block a linear code with covering radius R gives the anchors: each
fingerprint has a home anchor within R, and visits every anchor within R + t_i. Of two such fingerprints, the second
therefore visits the home of the first, and comparing homes with visitors at each anchor finds every pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, forget, lookup, settled, utf8, written
from .decontaminate import shingles
from .words import BASE, SPACED, Chunk, Grams, chunks, mixed
from ..operators.components import connected_components, thinned

SLICE = 1 << 16


def shingle_hashes(data: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; of the whole sequence where it is shorter."""
    words = data.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return np.zeros(0, np.uint64)
    n, joined = max(1, len(words) - width + 1), b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 where there are none."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        part = np.ascontiguousarray(hashes[i : i + SLICE])
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every document; fp holds the 64 bits as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t, width)) for t in utf8(b.column(1))], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Code:
    """A linear covering code of length n, given by the syndrome (parity-check column) of each bit."""

    def __init__(self, columns: list[int]):
        self.n, size = len(columns), 1 << max(columns, default=0).bit_length()
        self.halves = []
        for low in range(0, self.n, 12):
            table = np.zeros(1, np.int64)
            for c in columns[low : low + 12]:
                table = np.concatenate([table, table ^ c])
            self.halves.append(table)
        self.columns, leader, self.radius = columns, {}, 0
        for weight in range(self.n + 1):
            for e, s in self._errors(weight):
                if s not in leader:
                    leader[s], self.radius = e, weight
            if len(leader) == size:
                break
        self.errors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.leader = np.array([leader[s] for s in range(size)], np.int64)

    def _errors(self, weight: int) -> Iterator[tuple[int, int]]:
        for bits in itertools.combinations(range(self.n), weight):
            e = s = 0
            for i in bits:
                e |= 1 << i
                s ^= self.columns[i]
            yield e, s

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k, table in enumerate(self.halves):
            out ^= table[(x >> (12 * k)) & (len(table) - 1)]
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        """The nearest anchor, within the covering radius."""
        return x ^ self.leader[self.syndrome(x)]

    def visits(self, x: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Every anchor within radius + ``within``: positions in x, and anchors."""
        if within not in self.errors:
            found: dict[int, list[int]] = {}
            for weight in range(self.radius + within + 1):
                for e, s in self._errors(weight):
                    found.setdefault(s, []).append(e)
            every = [np.array(found.get(s, []), np.int64) for s in range(len(self.leader))]
            self.errors[within] = np.array([len(e) for e in every]), np.concatenate(every)
        counts, flat = self.errors[within]
        syndrome = self.syndrome(x)
        n = counts[syndrome]
        at = np.repeat(np.arange(len(x)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, x[at] ^ flat[(np.cumsum(counts) - counts)[syndrome][at] + nth]


def hamming_code(n: int, parity: int) -> Code:
    """Covering radius 1: the non-zero syndromes of ``parity`` bits, then bits without parity, which stay as they are."""
    return Code([(i + 1) if i + 1 < 1 << parity else 0 for i in range(n)])


def golay_code() -> Code:
    """The perfect binary Golay code of 23 bits, covering radius 3: the columns are the powers of x modulo its generator."""
    columns, x = [], 1
    for _ in range(23):
        columns.append(x)
        x <<= 1
        if x & 0x800:
            x ^= 0xAE3
    return Code(columns)


#: What a row that goes to an anchor costs, in comparisons.
ROW = 1500


def covering(n: int, within: int, count: int) -> Code:
    """The code for a block of ``n`` bits with the least work for ``count`` fingerprints: rows at anchors, and comparisons there.

    A code with fewer anchors copies a fingerprint to fewer of them and compares it with more; every code finds all pairs.
    """
    codes = [(0, 0), *((p, 1) for p in range(2, 5) if n >= (1 << p) - 1), *([(11, 3)] if n == 23 else [])]

    def work(code: tuple[int, int]) -> float:
        parity, radius = code
        visits = sum(math.comb(n, k) for k in range(radius + within + 1)) / 2**parity
        return visits * (ROW + count / 2 ** (n - parity))

    parity, radius = min(codes, key=work)
    return golay_code() if radius == 3 else hamming_code(n, parity) if parity else Code([0] * n)


def blocks(t: int, bits: int = 64, count: int = 0) -> list[tuple[int, int, Code]]:
    """``(shift, t_i, code)`` of disjoint blocks with sum(t_i + 1) = t + 1, the codes chosen for ``count`` fingerprints.

    Blocks get t_i = 1 as far as they go, and one block the odd share, t_i = 0, without redundancy.
    """
    ones, zero = divmod(t + 1, 2)
    narrow = 0
    if zero:
        narrow = min(range(1, bits), key=lambda w: (2.0**-w + (ones and ones * ((bits - w) // ones + 1) * 2.0 ** -((bits - w) // ones)))) if ones else bits
    out, at = [], 0
    for i in range(ones):
        width = (bits - narrow - at) // (ones - i)
        out.append((at, 1, covering(min(width, 23), 1, count)))  # bits of a block that go unused make its cells coarser, and lose no pair
        at += width
    return out + [(at, 0, Code([0] * min(narrow, 24)))] * zero


def cells(prints: DataFrame, t: int, count: int) -> DataFrame:
    """``prints(fp, ...)`` with cell and home: each of the ``count`` rows at its fingerprint's home anchor and at every anchor that it visits."""
    plan = blocks(t, count=count)
    prints = prints.select("fp", *[c for c in prints.columns if c != "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 4096):
                columns = [c.to_numpy()[low : low + 4096] for c in b.columns]
                fp = columns[0]
                for k, (shift, within, code) in enumerate(plan):
                    x = ((fp.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << code.n) - 1)).view(np.int64)
                    at, to = code.visits(x, within)
                    cell = np.concatenate([code.home(x), to]) | (k << 32)
                    home = np.arange(len(cell)) < len(x)
                    yield pa.record_batch([pa.array(cell), pa.array(home), *(pa.array(np.concatenate([c, c[at]])) for c in columns)], names=["cell", "home", *b.schema.names])

    return prints.mapInArrow(run, ", ".join(["cell long", "home boolean", *(f"{c} long" for c in prints.columns)]))


def split_hot(rows: DataFrame, limit: int, few: int = 100_000) -> DataFrame:
    """``rows(cell, home, fp, ...)`` with a column part: cells with over ``limit`` homes or visitors are dealt to blocks of at most about that many.

    Homes and visitors of such a cell are cut into chunks by hash, and every pair of chunks is a part of its own, so that
    no comparison is lost and no task gets an unbounded cell. The list of hot cells has at most rows / limit rows.
    """
    counts = rows.groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / limit).cast("int"))
    hot = written(counts.where((F.col("h") > limit) | (F.col("v") > limit)).select("cell", chunks("h").alias("hn"), chunks("v").alias("vn"), (F.col("h") + F.col("v")).alias("_n")), "hot")
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0))
    joined = beside(rows, hot, ["cell"], few).select(*rows.columns, F.coalesce("hn", F.lit(1)).alias("hn"), F.coalesce("vn", F.lit(1)).alias("vn"))
    own = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("cell", "home")]), F.when(F.col("home"), F.col("hn")).otherwise(F.col("vn"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("vn")).otherwise(F.col("hn")) - 1))
    joined = joined.withColumn("own", own).withColumn("other", other)
    part = F.when(F.col("home"), F.col("own") * F.col("vn") + F.col("other")).otherwise(F.col("other") * F.col("vn") + F.col("own"))
    return joined.withColumn("part", part.cast("int")).drop("hn", "vn", "own", "other")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal keys in rows sorted by the first ``keys`` columns; small runs come together.

    Yields whole runs only, several at once, as numpy columns: a run never is split between two yields.
    """
    kept: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if kept is not None:
            columns = [np.concatenate(x) for x in zip(kept, columns)]
        differs = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:keys]:
            differs |= c[1:] != c[:-1]
        edges = np.flatnonzero(differs)
        if len(edges):
            yield [c[: edges[-1] + 1] for c in columns]
            kept = [c[edges[-1] + 1 :] for c in columns]
        else:
            kept = columns
    if kept is not None:
        yield kept


def runs(columns: list[np.ndarray], keys: int) -> list[tuple[int, int]]:
    differs = np.zeros(len(columns[0]) - 1, bool)
    for c in columns[:keys]:
        differs |= c[1:] != c[:-1]
    cut = [0, *(np.flatnonzero(differs) + 1).tolist(), len(columns[0])]
    return list(zip(cut, cut[1:]))


def forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of the graph that the matrix gives between its rows and its columns."""
    rows, columns = [], []
    new_row, new_column = close.any(1), close.any(0)
    for first in np.flatnonzero(new_row).tolist():
        if not new_row[first]:
            continue
        new_row[first], stack = False, [first]
        while stack:
            r = stack.pop()
            reached = np.flatnonzero(close[r] & new_column)
            if not len(reached):
                continue
            new_column[reached] = False
            rows.append(np.full(len(reached), r))
            columns.append(reached)
            onward = np.flatnonzero(new_row & close[:, reached].any(1))
            if len(onward):
                new_row[onward] = False
                rows.append(onward)
                columns.append(reached[close[np.ix_(onward, reached)].argmax(1)])
                stack.extend(onward.tolist())
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (none, none)


def link_edges(rows: DataFrame, t: int, more: int | None = None, step: int = 1024) -> DataFrame:
    """``(a, b)``: for each part of each cell a spanning forest of the pairs of ``rows(.., fp, id)`` within t bits.

    With ``more`` the rows have a second fingerprint, fp2, and both together may differ in ``more`` bits at most. With a column
    known, pairs of equal known are left out: they are in one component already. Pairs are
    compared in blocks of ``step`` by ``step``; a block's forest has fewer edges than it has rows and columns, and the
    same components as all its pairs.
    """
    names = ["cell", "part", "home", "id", "fp", *(["fp2"] if more is not None else []), *(["known"] if "known" in rows.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in groups(batches, 2):
            home, a_out, b_out = columns[2], [], []
            bits = [c.view(np.uint64) for c in columns[4:6]]
            for low, high in runs(columns[:2], 2):
                own = home[low:high]
                x, y = np.flatnonzero(own) + low, np.flatnonzero(~own) + low
                for i in range(0, len(x), step):
                    for j in range(0, len(y), step):
                        p, q = x[i : i + step], y[j : j + step]
                        apart = np.bitwise_count(bits[0][p][:, None] ^ bits[0][q][None, :])
                        close = (apart <= t) & (columns[3][p][:, None] < columns[3][q][None, :])
                        if more is not None and close.any():
                            close &= apart + np.bitwise_count(bits[1][p][:, None] ^ bits[1][q][None, :]) <= more
                        if names[-1] == "known":
                            close &= columns[-1][p][:, None] != columns[-1][q][None, :]
                        r, c = forest(close)
                        a_out.append(columns[3][p[r]])
                        b_out.append(columns[3][q[c]])
            if a_out:
                yield pa.record_batch([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    dealt = rows.select(*names).repartition("cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, threshold: int = 4, cell_limit: int = 16_384, expected: int | None = None) -> DataFrame:
    """Near-duplicate classes of whole texts: ``(doc_id, fingerprint, component_id)``, a row for each input row.

    The codes are those with the least work for the number of distinct fingerprints (or ``expected``); the links are the same
    with all. Texts of any length are read whole.

    fingerprint: 16 lowercase hex digits of the SimHash over shingles of ``width`` words (lower-cased A-Z, split at
    ASCII white space; a shorter text is one shingle). component_id: the smallest doc_id reachable over links of at most
    ``threshold`` differing bits, the document itself included.

    Null and empty texts, and those without words, have fingerprint zero, which links like any other. Equal texts and
    ties share a fingerprint, and so a class. Repeated rows are returned as often as they come. A null doc_id is
    returned with its fingerprint; it stands for no class, and has the class of its fingerprint. An empty table gives
    none. Extra columns are ignored, whatever their names.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    rows = cells(distinct.select("fp", F.col("fp").alias("id")), threshold, distinct.count() if expected is None else expected)
    edges = link_edges(split_hot(rows, cell_limit), threshold)
    edges = written(edges, "links")
    named = connected_components(edges).select(F.col("node").alias("fp"), "component")
    # The class of each fingerprint is named by its smallest document.
    labelled = written(distinct.join(named, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("class")), "labelled")
    names = labelled.groupBy("class").agg(F.min("rep").alias("component_id"))
    final = labelled.join(names, "class").select("fp", "component_id")
    forget(edges)
    return prints.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Sets:
    """The distinct shingles of ``width`` words of each text of a chunk, or of all its words where they are fewer.

    ``id`` is a digest of the words of each text; ``some`` are the texts that have any, ``values`` their sorted shingle hashes, one text
    after the other, and ``starts`` where each begins.
    """

    def __init__(self, c: Chunk, width: int, grams: Grams):
        sums, low, high = grams.sums(c.hash), c.bounds[:-1], c.bounds[1:]
        self.id = grams.between(sums, low, high).view(np.int64)
        self.some = np.flatnonzero(high > low)
        h, alone = shingles(c.hash, width), self.id.view(np.uint64)
        sets = [np.unique(h[a : b - width + 1]) if b - a >= width else alone[i : i + 1] for i, a, b in zip(self.some.tolist(), low[self.some].tolist(), high[self.some].tolist())]
        self.count = np.array([len(x) for x in sets], np.int64)
        self.values, self.starts = np.concatenate(sets) if sets else h[:0], np.cumsum(self.count) - self.count

    def fingerprints(self, hashes: np.ndarray) -> np.ndarray:
        """The SimHash of each text that has words, of one hash for each value; some texts at a time, a long one by itself."""
        out, ends, low = np.zeros(len(self.starts), np.uint64), self.starts + self.count, 0
        while low < len(out):
            high = max(low + 1, int(np.searchsorted(ends, self.starts[low] + SLICE, "right")))
            part = hashes[self.starts[low] : ends[high - 1]]
            if high == low + 1:
                out[low] = fingerprint(part)
            else:
                bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                over = np.add.reduceat(bits, self.starts[low:high] - self.starts[low], axis=0, dtype=np.int32) * 2 > self.count[low:high, None]
                out[low:high] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
            low = high
        return out.view(np.int64)


def _texts(docs: DataFrame, width: int, n_bands: int, rows: int) -> DataFrame:
    """``(doc_id, id, fp, fp2, n, bands)``: id is a digest of the words, equal for texts with the same ones; two fingerprints of the
    distinct shingles, their number, and their MinHash band keys. Texts without words have zeros."""
    from .paragraphs import all_bands, permutations

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (p, q), grams = permutations(n_bands * rows), Grams()
        for batch in batches:
            for first, after, c in chunks(batch.column(1), table=SPACED):
                x = Sets(c, width, grams)
                out, keys = np.zeros((3, after - first), np.int64), np.zeros((after - first, n_bands), np.int64)
                if len(x.some):
                    out[0, x.some], out[1, x.some], out[2, x.some] = x.fingerprints(x.values), x.fingerprints(mixed(x.values + np.uint64(BASE))), x.count
                    keys[x.some] = all_bands(x.values, x.starts, p, q, rows)
                listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, n_bands, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.record_batch([batch.column(0).slice(first, after - first), pa.array(x.id), *map(pa.array, out), listed], names=["doc_id", "id", "fp", "fp2", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, id long, fp long, fp2 long, n long, bands array<long>")


def _without(docs: DataFrame, go: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and words are in ``go(doc_id, id)``; of rows with the same doc_id and words one.

    For tables in which a doc_id has rows with unlike words: their words are digested again.
    """
    name = "id"
    while name in docs.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.string())
            made = [Sets(c, 1, grams).id for _, _, c in chunks(texts, table=SPACED)] or [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(made))], names=[*b.schema.names, name])

    known = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    left = known.join(go.withColumnRenamed("id", name), ["doc_id", name], "left_anti")
    return left.dropDuplicates(["doc_id", name]).select(*docs.columns)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``(id, shingles)``: the digest of the words of each text, and its distinct shingle hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for first, after, c in chunks(batch.column(0), table=SPACED):
                x = Sets(c, width, grams)
                bounds = np.zeros(after - first + 1, np.int64)
                bounds[x.some + 1] = x.count * 8
                lists = pa.Array.from_buffers(pa.large_binary(), after - first, [None, pa.py_buffer(np.cumsum(bounds)), pa.py_buffer(np.ascontiguousarray(x.values))])
                yield pa.record_batch([pa.array(x.id), lists.cast(pa.binary())], names=["id", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "id long, shingles binary")


def _star(near: DataFrame, sets: DataFrame, limit: int, similarity: float, hubs: int = 4) -> DataFrame:
    """``(a, b)``: links between the members of large components and a few of them, the hubs.

    In a component of over ``limit`` texts of ``near(component, id)`` each one is compared with ``hubs`` of them, picked by hash:
    in a crowd of near copies most are links, and pairs of texts that these connect need no comparison.
    """
    large = written(near.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("component"), "crowds")
    if large.isEmpty():
        return near.sparkSession.createDataFrame([], "a long, b long")
    members = written(lookup(near.select("component", "id"), large, ["component"]), "crowd")
    picked = members.groupBy("component").agg(*[F.min_by("id", F.xxhash64("id", F.lit(j))).alias(f"h{j}") for j in range(hubs)])
    hub = picked.select("component", F.explode(F.array_distinct(F.array(*[f"h{j}" for j in range(hubs)]))).alias("id"))
    hub = written(hub.join(sets, "id").groupBy("component").agg(F.collect_list(F.struct("id", "shingles")).alias("hubs")), "hubs")
    # At most 64 MB of hubs are broadcast, or one component's: of many or long ones the largest components'.
    largest = hub.agg(F.max(F.expr("aggregate(hubs, 0L, (s, h) -> s + octet_length(h.shingles))"))).first()[0] or 0
    rows = lookup(members.join(sets, "id"), hub, ["component"], few=max(1, min(2000, (1 << 26) // (largest + 64)))).select("id", "shingles", "hubs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_out, b_out = [], []
            for k in range(b.num_rows):
                one, own = b.column(0)[k].as_py(), np.frombuffer(b.column(1)[k].as_py(), "<u8")
                for h in b.column(2)[k].as_py():
                    other = np.frombuffer(h["shingles"], "<u8")
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if h["id"] != one and both >= similarity * (len(own) + len(other) - both):
                        a_out.append(one)
                        b_out.append(h["id"])
            yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _leaving(docs: DataFrame, width: int, threshold: int, more: int, similarity: float, cell_limit: int, group_limit: int, few: int, n_bands: int, rows: int, most_shingles: int) -> DataFrame:
    """``(doc_id, id, again)``: the documents and words that leave; and, with again, the doc_ids that come more than once."""
    from .common import unlike_blocks
    from .verify import distinct_groups, similar_edges

    prints = written(_texts(docs, width, n_bands, rows).where("doc_id is not null"), "texts")
    classes = written(prints.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    # Each of the two fingerprints is covered; the second time only for links between components that the first has left apart.
    count = classes.count()
    found = link_edges(split_hot(cells(classes.select("fp", "fp2", "id"), threshold, count), cell_limit), threshold, more)
    named = written(connected_components(thinned(written(found, "links"))), "named").withColumnRenamed("node", "id")
    again = classes.drop("bands", "n").join(named, "id", "left").select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2"), "id", F.coalesce("component", "id").alias("known"))
    found = link_edges(split_hot(cells(written(again, "again"), threshold, count), cell_limit), threshold, more)
    edges = named.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(found)
    near = written(connected_components(thinned(written(edges, "links"))), "candidates").select("component", F.col("node").alias("id"))
    # Bands within one component bring no new pairs.
    banded = written(classes.join(near, "id", "left").select("id", "n", F.coalesce("component", "id").alias("known"), F.explode("bands").alias("band")), "banded")
    across = banded.groupBy("band").agg(F.min("known").alias("least"), F.max("known").alias("most")).where("least < most")
    met = written(lookup(banded, written(across.select("band"), "across"), ["band"]), "met")
    wanted = written(classes.join(near.select("id").union(met.select("id")).distinct(), "id", "left_semi").select("id", "doc_id"), "wanted")
    short = wanted.count() <= few  # some 16 bytes each: broadcast only while they are few
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted.select("doc_id")) if short else wanted.select("doc_id"), "doc_id", "left_semi")
    ids = wanted.select("id")
    sets = _sets(texts, width).join(F.broadcast(ids) if short else ids, "id").groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = written(sets, "sets")
    star = written(_star(near, sets, group_limit, similarity), "star")
    label = connected_components(star).select(F.col("node").alias("id"), F.col("component").alias("label"))
    sized = near.join(classes.select("id", "n"), "id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    found = distinct_groups(unlike_blocks(written(sized, "sized"), ["component"], "id", "label", group_limit, "n", most_shingles), ["component", "kind", "lo", "hi"])
    met = distinct_groups(unlike_blocks(met.select("band", "id", "n", "known"), ["band"], "id", "known", group_limit, "n", most_shingles), ["band", "kind", "lo", "hi"])
    found = written(found.unionByName(met), "groups")
    links = thinned(written(similar_edges(found, sets, similarity).union(star), "links"))
    named = connected_components(links).select(F.col("node").alias("id"), "component")
    grouped = classes.select("id", "doc_id").join(named, "id", "left").withColumn("group", F.coalesce("component", "id"))
    stay = grouped.groupBy("group").agg(F.min(F.struct("doc_id", "id")).alias("first")).select("first.*")
    go = prints.select("doc_id", "id").distinct().join(stay, ["doc_id", "id"], "left_anti").withColumn("again", F.lit(False))
    more_often = prints.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(None).cast("long").alias("id"), F.lit(True).alias("again"))
    return go.union(more_often)


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 5, more: int = 30, similarity: float = 0.8, cell_limit: int = 16_384, group_limit: int = 1024, few: int = 1_000_000, n_bands: int = 20, rows: int = 4, most_shingles: int = 1 << 19) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest doc_id stays, with all its columns.

    Candidates are texts of which either of two SimHashes over the distinct shingles of ``width`` words differs in at most
    ``threshold`` bits, found by the same covering, and both together in at most ``more`` of 128. A pair of similarity 0.8
    differs in about 10 bits of 64: a radius that holds such pairs holds more and more unlike ones as texts grow in number (of
    64 bits, 2 in ten million random pairs are within 12), and the work would grow with their square. So pairs beyond the radius meet
    in MinHash bands (``n_bands`` of ``rows``: a pair at 0.8 shares none with a chance of 0.00003, whatever its length). Within the
    components of candidates and the bands that hold more than one, in blocks of ``group_limit`` texts, pairs are held
    against the exact Jaccard similarity of their shingle sets: those of ``similarity`` or more are links, and a group is a
    component of links. In a larger component each text is held against a few of them first, and after that only against
    texts that these links don't connect it with, so that a crowd of near copies is not compared pair by pair.

    Texts with the same words are copies, as are all null and empty texts. Rows with a null doc_id are in no group and
    stay. Rows with one doc_id are one document where their words are the same, of which one row stays, and documents of
    their own where they are not. Texts of any length are compared whole; a block holds about ``most_shingles`` for each of
    its two chunks, however long its texts are. An empty table gives none. Other columns never matter.
    """
    found = settled(lambda: _leaving(docs, width, threshold, more, similarity, cell_limit, group_limit, few, n_bands, rows, most_shingles), "leaving")
    go, again = found.where("not again").select("doc_id", "id"), found.where("again").select("doc_id")
    if again.isEmpty():
        gone = go.select("doc_id")
        return docs.join(F.broadcast(gone) if gone.count() <= few else gone, "doc_id", "left_anti").select(*docs.columns)
    held = F.broadcast(again) if again.count() <= few else again
    gone = go.select("doc_id").join(again, "doc_id", "left_anti").union(again)
    once = docs.join(F.broadcast(gone) if gone.count() <= few else gone, "doc_id", "left_anti").select(*docs.columns)
    return once.union(_without(docs.join(held, "doc_id", "left_semi").select(*docs.columns), go))
