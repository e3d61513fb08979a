"""Rows that come by block and place, put together to arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def assembled(batches: Iterator[pa.RecordBatch], size: Callable[[int], int], kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """(block, values (place, column)) of batches whose columns are block, place and values, sorted by block. One block is held at a time; places without a row are NaN."""
    number, held, seen = None, None, None
    for batch in batches:
        block, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(2, batch.num_columns)]
        for run in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            if not len(run):
                continue
            if block[run[0]] != number:
                if number is not None:
                    yield number, held
                number = int(block[run[0]])
                held, seen = np.full((size(number), len(values)), np.nan, kind), np.zeros(size(number), bool)
            places = at[run]
            if seen[places].any() or len(np.unique(places)) < len(places):
                raise ValueError("two rows have the same place")
            seen[places] = True
            for c, own in enumerate(values):
                held[places, c] = own[run]
    if number is not None:
        yield number, held
