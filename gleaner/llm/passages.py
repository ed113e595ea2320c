"""Verbatim passages that repeat across documents, wherever they stand in lines: winnowed windows, exact first occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written
from .simhash import groups
from ..operators.blocks import whole
from .words import FOLD, Chunk, Grams, chunks, least  # noqa: F401  FOLD says what counts as a word

#: A filter has 2^bits bits, 16 for each hash; from MOST on it lets more others through, which costs time alone. It is made in pieces of 2^PIECE.
LEAST, MOST, PIECE = 20, 30, 17


def windows(c: Chunk, size: int, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words within one text; the least hash of the runs of half the size in each; the sums of all words."""
    none = np.zeros(0, np.int64)
    if len(c.start) < size:
        return none, none.view(np.uint64), none.view(np.uint64)
    sums, half = grams.sums(c.hash), size // 2
    at = np.flatnonzero(np.arange(size, len(c.start) + 1) <= np.repeat(c.bounds[1:], c.count)[: len(c.start) - size + 1])
    return at, least(grams.hashes(sums, half), size - half + 1)[at], sums


def _hashed(docs: DataFrame, size: int) -> DataFrame:
    """``(m, doc_id, n)``: the least hashes of the windows of each document, one for each run of n windows that share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            ids = b.column(0)
            for first, _, c in chunks(b.column(1)):
                at, m, _ = windows(c, size, grams)
                if len(at):
                    doc = c.doc[at]
                    new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]))
                    columns = [pa.array(m[new].view(np.int64)), ids.take(pa.array(first + doc[new])), pa.array(np.diff(np.append(new, len(m))))]
                    yield pa.record_batch(columns, names=["m", "doc_id", "n"])

    return docs.mapInArrow(run, "m long, doc_id long, n long")


def bit_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """Bits that are set for all the hashes: others pass at times, none of these ever fails.

    The low bits of a least hash are the place of its bit: the high ones are mostly zero.
    """

    def pieces(table: pa.Table) -> pa.Table:
        has = np.zeros(1 << PIECE, np.uint8)
        has[table["bit"].to_numpy()] = 1
        return pa.table({"piece": pa.array([table["piece"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(has, bitorder="little").tobytes()], pa.binary())})

    bits = min(MOST, max(LEAST, (16 * count).bit_length()))
    at = F.col("m").bitwiseAND((1 << bits) - 1)
    rows = hashes.select(F.shiftrightunsigned(at, PIECE).cast("int").alias("piece"), at.bitwiseAND((1 << PIECE) - 1).cast("int").alias("bit")).distinct()
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (PIECE - 3)
    for r in rows.groupBy("piece").applyInArrow(pieces, "piece int, bits binary").toLocalIterator():
        out[r.piece * width : (r.piece + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that pass a filter."""
    bit = hashes & np.uint64(8 * len(bits) - 1)
    return np.flatnonzero(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)


WINDOWS = "h long, doc_id long, at long, place long"


def _passing(batches: Iterator[pa.RecordBatch], size: int, passing, common: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """For each chunk the windows whose least hash passes the filter, those of the very common ones or the others.

    Their least hash, their own, their document, first word and its line, first character and that after the last, within the document.
    """
    grams, (bits, often) = Grams(), passing.value
    for b in batches:
        ids = b.column(0)
        for first, _, c in chunks(b.column(1)):
            at, m, sums = windows(c, size, grams)
            held = passes(bits, m)
            at, m = at[held], m[held]
            if len(often):
                near = often[np.minimum(np.searchsorted(often, m), len(often) - 1)] == m
                at, m = at[near == common], m[near == common]
            if len(at):
                doc = c.doc[at]
                begin, stop = c.start[at], c.end[at + size - 1]
                line = np.searchsorted(c.lines[0], begin, "right") - 1 - c.lines_before[doc]
                before = c.chars[c.offsets[doc]]
                yield m, grams.hashes(sums, size)[at], ids.take(pa.array(first + doc)).to_numpy(), at - c.bounds[doc], line, c.chars[begin] - before, c.chars[stop] - before


def _both(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.int64) << 32 | low


def _candidates(docs: DataFrame, size: int, passing, common: bool) -> DataFrame:
    """``(h, doc_id, at, place)``: a row for each window that ``_passing`` tells of. ``_runs`` holds the same in fewer rows.

    ``at`` holds the first word and its line, ``place`` the first character and that after the last, 32 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, doc, at, line, begin, stop in _passing(batches, size, passing, common):
            yield pa.record_batch([pa.array(x) for x in (h.view(np.int64), doc, _both(at, line), _both(begin, stop))], names=["h", "doc_id", "at", "place"])

    return docs.mapInArrow(run, WINDOWS)


#: Windows of one least hash m that follow each other in a document: at and place are of the first one, hashes has eight bytes for each,
#: steps how far the first character, the character after the last, and the line of each are from those of the window before: all
#: of one kind, then all of the next, one byte each, or four where some step needs them.
RUNS = "m long, doc_id long, at long, place long, hashes binary, steps binary"


def _packed(values: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Binary values: the bytes of the numbers up to each stop."""
    ends = np.concatenate([[0], stops * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all binary values, one after the other, and how many each has."""
    data = column.combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    _, ends, raw = data.buffers()
    ends = np.frombuffer(ends, np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    return np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _planes(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where the three steps of each window are among those of runs of n windows, of which each begins at low."""
    first = np.repeat(2 * low, n) + np.arange(n.sum())
    return np.stack([first, first + np.repeat(n, n), first + 2 * np.repeat(n, n)])


def _runs(docs: DataFrame, size: int, passing, common: bool = False) -> DataFrame:
    """``RUNS`` of the windows that ``_passing`` tells of, of the very common ones or the others: a row for each run, not for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, h, doc, at, *places in _passing(batches, size, passing, common):
            line, begin, stop = places
            low = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
            n = np.diff(np.append(low, len(m)))
            steps = np.stack([np.diff(x, prepend=x[:1]) for x in (begin, stop, line)])
            steps[:, low] = 0
            wide = np.maximum.reduceat(steps.max(0), low) > 255
            for some, kind in ((~wide, np.uint8), (wide, np.uint32)):
                if some.any():
                    each, rows, many = np.repeat(some, n), low[some], n[some]
                    packed = np.empty(3 * many.sum(), kind)
                    packed[_planes(np.cumsum(many) - many, many)] = steps[:, each]
                    columns = (m[rows].view(np.int64), doc[rows], _both(at[rows], line[rows]), _both(begin[rows], stop[rows]))
                    ends = np.cumsum(many)
                    yield pa.record_batch([*map(pa.array, columns), _packed(h[each], ends), _packed(packed, 3 * ends)], names=[x.split()[0] for x in RUNS.split(", ")])

    return docs.mapInArrow(run, RUNS)


def _told(t: pa.Table) -> tuple[np.ndarray, ...]:
    """The windows of a table of ``RUNS``: their run, hash, at and place."""
    hashes, held = _unpacked(t["hashes"])
    packed, wide = _unpacked(t["steps"])
    n = held // 8
    low, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    steps, begins = np.empty((3, len(of)), np.int64), np.cumsum(wide) - wide
    for kind in (np.uint8, np.uint32):
        some = wide == 3 * n * np.dtype(kind).itemsize
        if some.any():
            each = np.repeat(some, n)
            own = packed[np.repeat(some, wide)].view(kind)
            many = n[some]
            steps[:, each] = own[_planes(np.cumsum(many) - many, many)]
    sums = np.cumsum(steps, 1)
    begin, stop, line = sums - sums[:, low][:, of]  # from the run's first window on
    at, place = (t[c].to_numpy()[of] for c in ("at", "place"))
    return of, hashes.view(np.uint64), at + (_both(np.arange(len(of)) - low[of], line)), place + _both(begin, stop)


#: Windows of so many bytes of hashes are unpacked at a time, or one run that has more.
UNPACKED = 1 << 21


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, tuple[np.ndarray, ...]]]:
    """Rows of ``RUNS``, the row of each of their windows, and the window as in ``WINDOWS``. Rows of ``WINDOWS`` are one window each."""
    for b in batches:
        t = pa.Table.from_batches([b])
        if "hashes" not in t.column_names:
            yield t, np.arange(len(t)), tuple(t[c].to_numpy() for c in ("h", "doc_id", "at", "place"))
            continue
        ends = np.cumsum(pc.binary_length(t["hashes"]).to_numpy().astype(np.int64))
        low = 0
        while low < len(t):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + UNPACKED, "right")))
            some = t.slice(low, high - low)
            of, h, at, place = _told(some)
            yield some, of, (h.view(np.int64), some["doc_id"].to_numpy()[of], at, place)
            low = high


def _seen(rows: DataFrame) -> DataFrame:
    """``(h, doc_id, at, high)``: the windows of ``RUNS``, each at least once, with its first occurrence and the highest doc_id among these rows.

    Runs of the same windows, whose lines change at the same ones, are one before they are opened: what is inside a passage is opened
    once, however many copies it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of, (h, doc, at, _) in _opened(batches):
            order = np.lexsort((at, doc, h))
            h = h[order]
            low = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            high = np.maximum.reduceat(t["high"].to_numpy()[of][order], low)
            yield pa.record_batch([pa.array(x) for x in (h[low], doc[order][low], at[order][low], high)], names=["h", "doc_id", "at", "high"])

    lines = F.expr("substring(steps, cast(length(steps) div 3 * 2 + 1 as int))")
    first = F.min(F.struct("doc_id", "at", "place", "steps")).alias("f")
    alike = rows.groupBy("hashes", lines.alias("lines")).agg(first, F.max("doc_id").alias("high")).select("hashes", "f.*", "high")
    return alike.mapInArrow(run, "h long, doc_id long, at long, high long")


def _known(rows: DataFrame, first: DataFrame, few: int) -> DataFrame:
    """``RUNS`` with ``known``, the rows of ``first`` for their windows, which are looked up once for runs of the same windows. Runs without any fall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of, (h, *_) in _opened(batches):
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
            yield from pa.table({"same": t["same"].take(pa.array(of[new])), "h": h[new]}).to_batches()

    rows = rows.withColumn("same", F.md5("hashes"))
    alike = rows.groupBy("same").agg(F.min(F.struct("doc_id", "at", "place", "hashes", "steps")).alias("f")).select("same", "f.*")
    found = lookup(written(alike.mapInArrow(run, "same string, h long"), "each"), first, ["h"], few)
    table = written(found.groupBy("same").agg(F.collect_list(F.struct("h", "first_doc", "first_at")).alias("known")), "known")
    return lookup(rows, table, ["same"], few // 16).drop("same")  # a run has some ten windows


def _listed(column: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """The windows of a column ``known``, each once in ascending order, the documents and the places of their first occurrences."""
    flat = pc.list_flatten(column)
    h, docs, places = (pc.struct_field(flat, name).to_numpy() for name in ("h", "first_doc", "first_at"))
    windows, at = np.unique(h, return_index=True)
    return windows, docs[at], places[at]


#: n windows that follow each other and whose first occurrences do, or return among those before, first_n in all: at and first_at
#: are of the first one, place is from its start to the end of the last.
FIRSTS = "doc_id long, at long, place long, first_doc long, first_at long, n int, first_n int"


def _begins(near: np.ndarray, at: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which runs of windows begin a passage: windows at to stop occur first at low to high; only the near ones can go on with the one before.

    They do if they follow it and their first occurrence begins within the passage's own or just after it: so does text that
    repeats itself (a pair of words, hundreds of times). Runs may be cut anywhere, and repeated rows elsewhere: the passages are the same.
    """
    begins, last, columns = ~near, -1, [x.tolist() for x in (at, stop, low, high)]
    for i in np.flatnonzero(near).tolist():
        if i != last + 1:
            start, end, least, most = (x[i - 1] for x in columns)
        at_i, stop_i, low_i, high_i = (x[i] for x in columns)
        returns = end - start > most + 1 - least or stop_i - at_i > high_i + 1 - low_i
        if least <= low_i <= most + 1 and (at_i == end or at_i < end and returns):
            end, most = max(end, stop_i), max(most, high_i)
        else:
            begins[i] = True
            start, end, least, most = at_i, stop_i, low_i, high_i
        last = i
    return begins


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in two documents or more, with their first occurrence; rows are ``RUNS`` sorted by m, which equal windows share."""
    for t, _ in whole(batches, 1):
        of, h, at, place = _told(t)
        m, doc = (t[c].to_numpy()[of] for c in ("m", "doc_id"))
        order = np.lexsort((at, doc, h, m))
        differs = (h[order[1:]] != h[order[:-1]]) | (m[order[1:]] != m[order[:-1]])
        starts = np.flatnonzero(np.concatenate([[True], differs]))
        many = np.diff(np.append(starts, len(h)))
        some = np.repeat(doc[order[starts]] != doc[order[starts + many - 1]], many)
        first = np.empty(len(h), np.int64)
        first[order] = np.where(some, np.repeat(order[starts], many), -1)
        held = np.flatnonzero(first >= 0)
        if not len(held):
            continue
        of, doc, at, place, first_doc, first_at = of[held], doc[held], at[held], place[held], doc[first[held]], at[first[held]]
        word, first_word = at >> 32, first_at >> 32
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (word[1:] != word[:-1] + 1) | (first_doc[1:] != first_doc[:-1]) | (first_word[1:] != first_word[:-1] + 1)])
        low = np.flatnonzero(new)
        n = np.diff(np.append(low, len(at)))
        many = pa.array(n.astype(np.int32))
        columns = (doc[low], at[low], _both(place[low] >> 32, place[low + n - 1] & 0xFFFFFFFF), first_doc[low], first_at[low])
        yield pa.record_batch([*map(pa.array, columns), many, many], names=[x.split()[0] for x in FIRSTS.split(", ")])


def _common(rows: DataFrame, few: int) -> DataFrame:
    """The same for windows that very many rows share, as ``RUNS`` or a row for each: they are summed where they are made, and looked up.

    Up to ``few`` distinct windows are looked up where the rows are, which come in the order of their texts, so that a
    passage makes one row for each of its copies and not one for each of its windows, nor one for each time that it repeats
    itself. More of them are joined, with runs of the same windows once.
    """
    runs = "hashes" in rows.columns
    seen = _seen(rows) if runs else rows.withColumn("high", F.col("doc_id"))
    first = seen.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max("high").alias("high")).where("f.doc_id < high")
    first = written(first.select("h", F.col("f.doc_id").alias("first_doc"), F.col("f.at").alias("first_at")), "first")
    many, known = first.count() > few, None
    if many and not runs:
        return lookup(rows, first, ["h"], few).select("doc_id", "at", "place", "first_doc", "first_at", F.lit(1).alias("n"), F.lit(1).alias("first_n"))
    if many:
        rows = _known(rows, first, few)
    else:
        known = rows.sparkSession.sparkContext.broadcast([c.to_numpy() for c in first.orderBy("h").toArrow().columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, (h, doc, at, place) in _opened(batches):
            windows, docs, places = known.value if known else _listed(t["known"])
            found = np.searchsorted(windows, h)
            held = np.flatnonzero(np.append(windows, 0)[found] == h) if len(windows) else found[:0]
            held = held[found[held] < len(windows)]
            if not len(held):
                continue
            doc, at, place, first_doc, first_at = doc[held], at[held], place[held], docs[found[held]], places[found[held]]
            word, first_word = at >> 32, first_at >> 32
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1] + 1) | (first_doc[1:] != first_doc[:-1]) | (first_word[1:] != first_word[:-1] + 1)])
            low = np.flatnonzero(new)
            n = np.diff(np.append(low, len(at)))
            word, first_word, stop = word[low], first_word[low], word[low] + n
            kept = (doc[low] == first_doc[low]) & (at[low] == first_at[low])
            near = np.concatenate([[False], (doc[low[1:]] == doc[low[:-1]]) & (word[1:] == stop[:-1]) & (first_doc[low[1:]] == first_doc[low[:-1]]) & (kept[1:] == kept[:-1])])
            part = np.flatnonzero(_begins(near, word, stop, first_word, first_word + n - 1))
            first_n, low = np.maximum.reduceat(first_word + n, part) - first_word[part], low[part]
            n = np.diff(np.append(low, len(at)))
            whole = place[low] & ~0xFFFFFFFF | place[low + n - 1] & 0xFFFFFFFF
            counts = (pa.array(x.astype(np.int32)) for x in (n, first_n))
            yield pa.record_batch([*(pa.array(x) for x in (doc[low], at[low], whole, first_doc[low], first_at[low])), *counts], names=[x.split()[0] for x in FIRSTS.split(", ")])

    return rows.mapInArrow(run, FIRSTS)


SPANS = "doc_id long, para int, start int, length int, cluster_doc long, cluster_para int, kept boolean"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that follow each other, and whose first occurrences do or return, become one span; rows come sorted by document."""
    for doc, at, place, first_doc, first_at, n, first_n in groups(batches, 1):
        apart, returns = (first_at >> 32) - (at >> 32), n > first_n
        order = np.lexsort((at, apart, returns, first_doc, doc))
        doc, at, place, first_doc, first_at, n, first_n, apart, returns = (x[order] for x in (doc, at, place, first_doc, first_at, n, first_n, apart, returns))
        other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first_doc[1:] != first_doc[:-1]) | (apart[1:] != apart[:-1]) | returns[1:]])
        word, line = at >> 32, np.cumsum(other) << 32
        after = np.maximum.accumulate(line + word + n)  # of all rows before in the same line of windows: repeated rows lie within
        low = np.flatnonzero(other | np.concatenate([[True], (line + word)[1:] > after[:-1]]))
        most, stop, end = (np.maximum.reduceat(x, low) for x in ((first_at >> 32) + first_n - 1, word + n, place & 0xFFFFFFFF))
        doc, at, place, first_doc, first_at = (x[low] for x in (doc, at, place, first_doc, first_at))
        kept = (doc == first_doc) & (at == first_at)
        order = np.lexsort((at, kept, first_doc, doc))
        doc, at, place, first_doc, first_at, kept, most, stop, end = (x[order] for x in (doc, at, place, first_doc, first_at, kept, most, stop, end))
        same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (first_doc[1:] == first_doc[:-1]) & (kept[1:] == kept[:-1])])
        word, line = at >> 32, np.cumsum(~same) << 32
        near = same & np.concatenate([[False], (line + word)[1:] <= np.maximum.accumulate(line + stop)[:-1]])
        low = np.flatnonzero(_begins(near, word, stop, first_at >> 32, most))
        start, end = place[low] >> 32, np.maximum.reduceat(end, low)
        columns = [doc[low], (at[low] & 0xFFFFFFFF).astype(np.int32), start.astype(np.int32), (end - start).astype(np.int32), first_doc[low], (first_at[low] & 0xFFFFFFFF).astype(np.int32), kept[low]]
        yield pa.record_batch([pa.array(x) for x in columns], names=[x.split()[0] for x in SPANS.split(", ")])


def repeated_passages(docs: DataFrame, size: int = 50, often: int = 20_000, few: int = 200_000) -> DataFrame:
    """Runs of ``size`` words or more that occur in two documents: ``(doc_id, para, start, length, cluster_doc, cluster_para, kept)``.

    Words are runs of letters and digits in lower case, whatever the lines they stand in. Every window of ``size`` words that
    another document holds too is found, and nothing else: a window's key is the least hash of its runs of half the size (a
    MinHash of one row), equal windows have an equal one, and windows whose key occurs in two documents are compared in
    full. Windows of keys that over ``often`` windows have are summed before they are shuffled, equal runs of them before equal
    windows, and if at most ``few`` of them differ, looked up without a shuffle and gathered to passages. Successive windows whose first
    occurrences (by doc_id and place) are successive too make one row; kept says that it is itself the first occurrence. So do
    those whose first occurrences return among those before in the row: a text that repeats itself is one row, which
    may be longer than the passage where its windows occur first.

    Null and empty texts have no words; texts of any length are read whole. Rows with a null doc_id are passed over; rows that
    repeat a doc_id are one document. An empty table gives none. Extra columns are ignored.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = _hashed(docs, size).groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n").alias("n")).where("a < b")
    met = written(met.select("m", "n"), "met")
    n, total = met.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = np.sort(np.array([r.m for r in met.where(F.col("n") > max(often, total // 100_000)).select("m").toLocalIterator()], np.int64).view(np.uint64))
    passing = docs.sparkSession.sparkContext.broadcast((bit_filter(met.select("m"), n), common))
    rows = _runs(docs, size, passing).repartition("m").sortWithinPartitions("m")
    shared = rows.mapInArrow(_firsts, FIRSTS)
    if len(common):
        shared = shared.union(_common(written(_runs(docs, size, passing, True), "common"), few))
    return shared.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_spans, SPANS)
