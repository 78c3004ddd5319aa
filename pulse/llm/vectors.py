"""Vector columns inside tasks: validity, unit vectors, blocks of products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite and not all zero."""
    fine = F.forall(col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(col) > 0) & fine & F.exists(col, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which keeps every digit: the largest component is then below one, and no square vanishes or overflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that tiny and huge components neither vanish nor overflow."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, in turn, from batches sorted by ``keys``; holds one key's rows at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        starts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(at)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and (a or (at[0] != last).any()):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
        last = at[-1]
    if held:
        yield pa.Table.from_batches(held)
