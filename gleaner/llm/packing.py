"""Packing by concatenate and cut: token totals of partitions, prefix sums over them, then fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, written

TOKENS = "part int, doc_id long, n long, start long, ids binary"


@lru_cache(maxsize=2)
def encoder(vocabulary: str, special: str):
    """A function from texts to lists of ids, as the tokenizer file ``vocabulary`` gives them.

    A byte-level BPE file that has its ranks beside it (the same name, .tiktoken) is run from those, which gives the same
    ids in less time; a text that holds the ``special`` string is left to the tokenizer file itself, where it is one id.
    """
    import base64
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    whole: list[Tokenizer] = []

    def slow(text: str) -> list[int]:
        if not whole:
            whole.append(Tokenizer.from_file(path))
        return whole[0].encode(text, add_special_tokens=False).ids

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import tiktoken

    with open(ranks, "rb") as lines:
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    return lambda text: slow(text) if special in text else fast.encode_ordinary(text)


def tokens(docs: DataFrame, vocabulary: str, special: str = "<|endoftext|>", end_id: int = 0) -> DataFrame:
    """``(part, doc_id, n, start, ids)``: ids (little-endian unsigned 32 bits) with ``end_id`` after each document.

    part is the partition that made the row, start the tokens before it in that partition. Written once: a partition
    that runs again commits one attempt only, so offsets and ids always come from the same run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, encode = TaskContext.get().partitionId(), 0, encoder(vocabulary, special)
        for b in batches:
            texts, keys = strings(b.column(1)), b.column(0)
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and size < 4_000_000:
                    size += len(texts[high])
                    high += 1
                ids = [np.array([*encode(t), end_id], "<u4") for t in texts[low:high]]
                n = np.array([len(x) for x in ids], np.int64)
                start = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), keys.slice(low, high - low), pa.array(n), pa.array(start), pa.array([x.tobytes() for x in ids], pa.binary())], names=["part", "doc_id", "n", "start", "ids"])
                low = high

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS), "tokens")


def offsets(table: DataFrame) -> DataFrame:
    """``(part, first)``: tokens in all earlier partitions. One small row for each partition goes to the driver."""
    totals = [(r.part, r.total) for r in table.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").collect()]
    first, rows = 0, []
    for part, total in totals:
        rows.append((part, first))
        first += total
    return table.sparkSession.createDataFrame(rows, "part int, first long")


def pack(docs: DataFrame, length: int = 1024, vocabulary: str = "byte_bpe_50k.json", special: str = "<|endoftext|>", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents packed into sequences of ``length`` tokens, a row for each piece of a document.

    All documents' ids, each with ``end_id`` after them, are concatenated in the order of the table and cut every
    ``length`` tokens. Columns: doc_id, start (the document's ids before the piece), length, ids_crc32 (of the piece's
    ids as little-endian unsigned 32 bits), doc_tokens, sequence_id, offset (in the sequence, gapless from 0),
    padded_length (of the sequence: ``length``, but the tokens it has where they are a power of two), and with
    ``with_ids`` the ids as array<int>. Only the last sequence can be short.

    Null and empty texts are one token, ``end_id``. Long texts span as many sequences as they need. Repeated rows are
    packed as often as they come; a null doc_id is kept as null. An empty table gives no rows. Extra columns are ignored.
    """
    table = tokens(docs, vocabulary, special, end_id)
    first = offsets(table)
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    last, rest = divmod(total, length)
    short = rest if rest & (rest - 1) == 0 else length
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, n, at, ids in zip(*(b.column(k).to_pylist() for k in range(4))):
                start, view = 0, memoryview(ids)
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    piece = view[4 * start : 4 * (start + size)]
                    row = (doc_id, start, size, zlib.crc32(piece), n, sequence, offset, short if rest and sequence == last else length)
                    rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if with_ids else row)
                    start += size
            if rows:
                names = [x.split()[0] for x in schema.split(", ")]
                types = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # One row for each partition of the first pass: some 16 bytes each, far below any broadcast limit.
    placed = table.join(F.broadcast(first), "part").select("doc_id", "n", (F.col("first") + F.col("start")).alias("at"), "ids")
    return placed.mapInArrow(run, schema)
