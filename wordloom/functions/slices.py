"""Arrow functions that take a batch a few rows at a time, so that a worker's memory goes by bytes and not by rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf

#: Bytes of input that are Python objects at a time; a longer row is a slice of its own.
SLICE_BYTES = 128 << 10


def _bytes(column: pa.Array) -> np.ndarray:
    """About the bytes of each row."""
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("i8")
        values = pc.list_flatten(column)
        return counts * 8 if not len(values) else counts * max(8, values.nbytes // len(values))
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("i8")
    return np.full(len(column), 8)


def cut(columns: Tuple[pa.Array, ...], limit: int = SLICE_BYTES) -> Iterator[Tuple[pa.Array, ...]]:
    """The rows of the columns in their order, in slices of at most ``limit`` bytes or of one row."""
    n = len(columns[0])
    ends = np.cumsum(sum(_bytes(c) + 8 for c in columns)) if n else ()
    start = done = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield tuple(c.slice(start, stop - start) for c in columns)
        start, done = stop, int(ends[stop - 1])


def sliced(kind: str, of: Callable[..., pa.Array]):
    """An Arrow function of one column that gives its result slice by slice."""

    @arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in cut((batch,)):
                yield of(*part)

    return run


def sliced_pair(kind: str, of: Callable[..., pa.Array]):
    """The same of two columns."""

    @arrow_udf(kind)
    def run(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in cut(tuple(batch)):
                yield of(*part)

    return run
