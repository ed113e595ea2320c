"""Digests of contents: built-in SHA-256, and BLAKE2b in Arrow batches."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_offsets(size: Column, sample: int) -> Column:
    """Distinct starts of the first, the middle and the last sample, each clamped to the content."""
    top = F.greatest(F.lit(0).cast("long"), size - sample)
    clamp = lambda o: F.least(F.greatest(o, F.lit(0).cast("long")), top)
    return F.array_distinct(F.array(F.lit(0).cast("long"), clamp((size / 2).cast("long")), clamp(size - sample)))


def samples(content: Column, size: Column, sample: int) -> Column:
    """The sampled bytes of a content, one after the other."""
    piece = lambda o: F.substring(content, (o + 1).cast("int"), F.lit(sample))
    offsets = sample_offsets(size, sample)
    part = lambda i: F.coalesce(piece(F.get(offsets, F.lit(i))), F.lit(b""))
    return F.concat(part(0), part(1), part(2))


def blake2b(size: int):
    """A function from a binary column to the hex digest of ``size`` bytes; null for null."""

    @F.arrow_udf("string")
    def digest(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.blake2b(x, digest_size=size).hexdigest() for x in column.to_pylist()], pa.string())

    return digest


def quick_blake2b(content: Column, size: Column, sample: int = 65536) -> Column:
    if sample <= 0:
        raise ValueError("sample size must be positive")
    return blake2b(16)(samples(content, size, sample))


def full_blake2b(content: Column) -> Column:
    return blake2b(32)(content)


CHUNK, SAMPLE = 1 << 20, 65536


def _tried(function, *columns: pa.Array) -> pa.Array:
    """Values of a function of file paths; null for a file that can't be read."""

    def one(*values):
        try:
            return function(*values)
        except OSError:
            return None

    return pa.array([one(*v) for v in zip(*(c.to_pylist() for c in columns))], pa.string())


def quick_of_file(path: Column, size: Column, sample: int = 65536) -> Column:
    """BLAKE2b (16 bytes) of the distinct samples of a file as large as ``size``: only those are read."""
    if sample <= 0:
        raise ValueError("sample size must be positive")

    def read(name: str, offsets: list[int]) -> str:
        digest = hashlib.blake2b(digest_size=16)
        with open(name, "rb") as f:
            for at in offsets:
                f.seek(at)
                digest.update(f.read(sample))
        return digest.hexdigest()

    @F.arrow_udf("string")
    def digest(name: pa.Array, offsets: pa.Array) -> pa.Array:
        return _tried(read, name, offsets)

    return digest(path, sample_offsets(size, sample))


def digest_bytes(data: bytes) -> str:
    """BLAKE2b (16 bytes) of bytes, in hex; anything else is a TypeError."""
    if isinstance(data, (bytes, bytearray)):
        return hashlib.blake2b(data, digest_size=16).hexdigest()
    raise TypeError(f"bytes are digested, not {type(data).__name__}")


def digest_samples(path: str, sample: int = SAMPLE) -> str:
    """The sampled digest of one file, the same as ``quick_of_file`` gives."""
    if sample <= 0:
        raise ValueError("sample size must be positive")
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        top, parts = max(0, size - sample), []
        for at in sorted({0, min(size // 2, top), top}):
            f.seek(at)
            parts.append(f.read(sample))
    return digest_bytes(b"".join(parts))


def _whole(path: Column, new) -> Column:
    def read(name: str) -> str:
        digest = new()
        with open(name, "rb") as f:
            while piece := f.read(CHUNK):
                digest.update(piece)
        return digest.hexdigest()

    @F.arrow_udf("string")
    def digest(name: pa.Array) -> pa.Array:
        return _tried(read, name)

    return digest(path)


def full_of_file(path: Column) -> Column:
    """BLAKE2b (32 bytes) of a whole file, read in pieces of 1 MiB."""
    return _whole(path, lambda: hashlib.blake2b(digest_size=32))


def sha256_of_file(path: Column) -> Column:
    return _whole(path, hashlib.sha256)
