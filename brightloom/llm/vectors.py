"""What the vector operators share: valid vectors, and arrays to and from bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0.0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a float64 matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the batch's vectors of each length."""
    values = batch.column(column)
    lengths = np.array([len(x) for x in values], np.int64) if len(values) else np.zeros(0, np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, matrix(values.take(pa.array(rows)))


def forest(near: np.ndarray, rows: np.ndarray, cols: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the bipartite links near[r, c] between nodes rows[r] and cols[c].

    ``label`` names each node's tree so far and is brought up to date.
    """
    edges: list[tuple[int, int]] = []
    for r in np.flatnonzero(near.any(1)).tolist():
        x, found = int(rows[r]), cols[near[r]]
        labels, first = np.unique(label[found], return_index=True)
        new = labels != label[x]
        if new.any():
            edges += [(x, int(y)) for y in found[first[new]]]
            label[np.isin(label, labels)] = label[x]
    return edges
