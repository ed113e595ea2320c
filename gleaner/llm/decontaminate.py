"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Chunk, chunks, mixed

#: Bits of each block of a fingerprint, and the place in the index that each block begins at.
WIDTHS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)
SHIFTS, PARTS = tuple(sum(WIDTHS[:k]) for k in range(len(WIDTHS))), 1 << max(WIDTHS)
FACTORS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(5)], np.uint64)
FILTER = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    return Chunk(raw, np.array([0, len(raw)])).hash


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each shingle of ``width`` words, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h += words[i : i + n] * FACTORS[i]
    return mixed(h)


def window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every window of ``size`` consecutive shingles."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    over = (total[size:] - total[:-size]) * 2 > size
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles, each weighted by how often it occurs."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def block(prints: np.ndarray, k: int) -> np.ndarray:
    """Block k of each fingerprint."""
    return ((prints >> np.uint64(SHIFTS[k])) & np.uint64((1 << WIDTHS[k]) - 1)).astype(np.int64)


class Index:
    """Benchmark items by shingle, and their fingerprints by every block value within one bit.

    A fingerprint within 19 bits of an item's differs from it in at most one bit of one of the 10 blocks, and so meets
    the item there: the multi-index finds every item within the radius.
    """

    radius = 2 * len(WIDTHS) - 1

    def __init__(self, items: list[tuple[int, bytes]], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        self.ids, self.hashes, self.widths = [], [], []
        for item_id, text in items:
            words = word_hashes(text)
            if len(words):
                w = min(width, len(words))
                self.ids.append(item_id)
                self.widths.append(w)
                self.hashes.append(shingles(words, w))
        self.sizes = np.array([len(h) for h in self.hashes], np.int64)
        self.prints = np.array([window_prints(h, len(h))[0] for h in self.hashes], np.uint64)
        self.of_width = {}
        for w in sorted(set(self.widths)):
            of = [i for i, x in enumerate(self.widths) if x == w]
            keys = np.concatenate([self.hashes[i] for i in of])
            sizes = np.repeat(self.sizes[of], self.sizes[of])
            pairs = np.unique(np.rec.fromarrays([keys, sizes], names="k,s"))
            maybe = np.zeros(FILTER, bool)
            maybe[keys & np.uint64(FILTER - 1)] = True
            at = self.multi_index(of)
            self.of_width[w] = maybe, pairs.k.copy(), pairs.s.copy(), *at

    def multi_index(self, of: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start of each (block, value) in the list of items that have it within one bit, and the list."""
        own, keys, items = np.array(of), [], []
        for k, width in enumerate(WIDTHS):
            near = np.array([0] + [1 << i for i in range(width)])
            keys.append((k * PARTS + (block(self.prints[own], k)[:, None] ^ near)).ravel())
            items.append(np.repeat(own, len(near)))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        return np.searchsorted(keys[order], np.arange(len(WIDTHS) * PARTS + 1)), items[order]

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """``(item_id, similarity, first word, words, differing bits)`` of the best window for each item that leaks, by a text's word hashes.

        Windows have the item's number of words (or all words of a shorter text). Those that share no shingle with any
        item of that size have similarity 0 and are passed over; every other one is fingerprinted and looked up.
        """
        best: dict[int, tuple[float, int, int, int]] = {}
        for w, (maybe, keys, key_sizes, starts, listed) in self.of_width.items():
            h = shingles(words, w)
            hit = np.flatnonzero(maybe[h & np.uint64(FILTER - 1)])
            if not len(hit):
                continue
            low, high = np.searchsorted(keys, h[hit]), np.searchsorted(keys, h[hit], "right")
            n = high - low
            at = np.repeat(hit, n)
            size_of = key_sizes[np.repeat(low, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
            for size in np.unique(size_of).tolist():
                m = min(size, len(h))
                wanted = np.zeros(len(h) + 1, np.int64)
                p = at[size_of == size]
                np.add.at(wanted, np.maximum(p - m + 1, 0), 1)
                np.add.at(wanted, p + 1, -1)
                begin = np.flatnonzero(np.cumsum(wanted)[: len(h) - m + 1] > 0)
                for a, b, d, i in self.near(h, begin, m, size, starts, listed):
                    s = similarity(h[a:b], self.hashes[i])
                    if s >= self.threshold and (i not in best or (-s, a) < (-best[i][0], best[i][1])):
                        best[i] = s, a, m + w - 1, d
        return [(self.ids[i], *x) for i, x in sorted(best.items())]

    def near(self, h, begin, m, size, starts, listed) -> Iterator[tuple[int, int, int, int]]:
        """Windows at ``begin`` and items of that size within the radius: start, end, differing bits, item."""
        cuts = np.flatnonzero(np.diff(begin) > m) + 1
        for run in np.split(begin, cuts):
            for low in range(0, len(run), 4096):
                some = run[low : low + 4096]
                base = int(some[0])
                prints = window_prints(h[base : int(some[-1]) + m], m)[some - base]
                pairs = []
                for k in range(len(WIDTHS)):
                    key = k * PARTS + block(prints, k)
                    n = starts[key + 1] - starts[key]
                    window = np.repeat(np.arange(len(some)), n)
                    pairs.append(window * len(self.ids) + listed[np.repeat(starts[key], n) + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)])
                window, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.ids))
                bits = np.bitwise_count(prints[window] ^ self.prints[item])
                for j in np.flatnonzero((bits <= self.radius) & (self.sizes[item] == size)).tolist():
                    a = int(some[window[j]])
                    yield a, a + m, int(bits[j]), int(item[j])


def _passes(docs: DataFrame, benchmark: DataFrame, width: int, threshold: float, items_each: int, most_bytes: int = 1 << 26) -> Iterator:
    """Broadcasts of the benchmark in blocks of at most ``items_each`` items and about ``most_bytes`` of text (or one longer item): each block is held against all documents."""
    part: list[tuple[int, bytes]] = []
    size, send = 0, lambda: docs.sparkSession.sparkContext.broadcast(Index(part, width, threshold))
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for r in rows.toLocalIterator():
        part.append((r[0], r[1].encode()))
        size += len(part[-1][1])
        if len(part) == items_each or size >= most_bytes:
            yield send()
            part, size = [], 0
    if part:
        yield send()


def each_text(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for _, _, c in chunks(column):
        for low, high in zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist()):
            yield c.hash[low:high]


LEAKS = "doc_id long, item_id long, similarity double, start_word int, n_words int, bits int"


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, items_each: int = 4096) -> DataFrame:
    """Benchmark passages in documents: ``(doc_id, item_id, similarity, start_word, n_words, bits)``.

    A row for each document and item for which a window of the document, as long as the item, has a SimHash within 19 bits
    of the item's and a weighted Jaccard similarity of ``threshold`` or more over shingles of ``width`` words (of
    all its words for a shorter item); the best window, of equal ones the first. Words are runs of letters and digits in
    lower case (ASCII punctuation parts them). A text shorter than the item is one window.

    Null and empty texts and items have no words: nothing matches them. Texts of any length are read whole. Repeated documents
    and items are matched each. A null id is returned as null. Empty tables give no rows. Extra columns are ignored. The
    benchmark goes to the executors in blocks of ``items_each`` items or 64 MB of text; documents are never shuffled.
    """
    out, schema = None, LEAKS
    for shared in _passes(docs, benchmark, width, threshold, items_each):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                rows = [(d, *m) for d, words in zip(b.column(0).to_pylist(), each_text(b.column(1))) for m in index.matches(words)]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, items_each: int = 4096) -> DataFrame:
    """The documents without those in which ``leaks`` finds an item, all columns as they are; the same rules for odd input."""
    for shared in _passes(docs, benchmark, width, threshold, items_each):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).cast(pa.string())
                yield b.filter(pa.array([not index.matches(words) for words in each_text(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
