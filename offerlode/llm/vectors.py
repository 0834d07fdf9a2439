"""What the two vector operators share: reading arrays and streaming sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector may take part: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed_vectors(column: pa.Array) -> list[bytes]:
    """Each list of floats as little-endian bytes of its own float type."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    return [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]


def float_type(frame: DataFrame, name: str) -> str:
    """Numpy's name of the column's element type; other types than float are read as double."""
    return "<f4" if frame.schema[name].dataType.elementType.typeName() == "float" else "<f8"


def matrix(values: list[bytes], dtype: str) -> np.ndarray:
    """Rows of one length, in double precision."""
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1).astype(np.float64)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in rows that are sorted by them, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(key).to_numpy(zero_copy_only=False) for key in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for column in columns:
            change |= column[1:] != column[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
        first = tuple(column[0] for column in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if held and start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
        last = tuple(column[-1] for column in columns)
    if held:
        yield pa.Table.from_batches(held)
