"""Sorted Arrow batches cut so that no key lies in two of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def first_of_keys(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's key differs from that of the row before; nulls are equal."""
    new = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        codes = [pc.fill_null(batch.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for k in keys]
        new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return new


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = 2048) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, number of each row's key in them) of about `size` rows."""
    held = None
    for whole in batches:
        for start in range(0, whole.num_rows, size):
            part = whole.slice(start, size)
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            new = first_of_keys(part, keys)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield part.slice(0, last), np.cumsum(new[:last]) - 1
            held = part.slice(last)
    if held is not None:
        yield held, np.zeros(held.num_rows, np.int64)
