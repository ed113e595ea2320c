"""Groups of rows that are compared in blocks, within Arrow batches: no block holds more than two chunks of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the first ``keys`` columns, which are longs, as tables of whole groups, and where in them each group of two rows or more begins and ends.

    Small groups come together; a group never is split between two tables.
    """
    kept: list[pa.Table] = []

    def starts(t: pa.Table) -> np.ndarray:
        differs = np.zeros(max(len(t) - 1, 0), bool)
        for c in t.columns[:keys]:
            c = c.to_numpy()
            differs |= c[1:] != c[:-1]
        return np.flatnonzero(differs) + 1

    def told(parts: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
        t = pa.concat_tables(parts).combine_chunks()
        cut = np.concatenate([[0], starts(t), [len(t)]])
        return t, np.stack([cut[:-1], cut[1:]], 1)[np.diff(cut) > 1]

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        edges = starts(t)
        goes_on = bool(kept) and all(kept[-1].column(i)[-1].as_py() == t.column(i)[0].as_py() for i in range(keys))
        if kept and not goes_on:
            yield told(kept)
            kept = []
        if len(edges):
            yield told([*kept, t.slice(0, edges[-1])])
            kept = [t.slice(edges[-1])]
        else:
            kept.append(t)
    if kept:
        yield told(kept)
