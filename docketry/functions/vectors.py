"""Scores of a vector column against one query vector, a matrix product per Arrow batch.

A null score stands for a vector that takes no part: null, of another length
than the query, with a null or NaN component, or all zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors whose components are held in double at once.
ROWS = 4096


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that take part, and their vectors."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    where = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(where)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dims)
    fine = ~np.isnan(x).any(axis=1) & x.any(axis=1)
    return where[fine], x[fine]


def _scored(query: Sequence[float], score: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: pa.DataType) -> Callable:
    q = np.asarray(query, dtype=np.float32)

    def over(column: pa.Array) -> pa.Array:
        where, x = _matrix(column, len(q))
        out = np.zeros(len(column))
        for i in range(0, len(where), ROWS):
            out[where[i : i + ROWS]] = score(x[i : i + ROWS], q)
        missing = np.ones(len(column), dtype=bool)
        missing[where] = False
        return pa.array(out, mask=missing).cast(kind)

    return over


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    x, q = x.astype(np.float64), q.astype(np.float64)
    return np.round(x @ q / (np.linalg.norm(x, axis=1) * (np.linalg.norm(q) or 1.0)), 6)


def cosine_to(query: Sequence[float], vector: Column) -> Column:
    """Cosine in double, rounded to 6 places."""
    over = _scored(query, _cosines, pa.float64())

    @F.arrow_udf("double")
    def cosine(v: pa.Array) -> pa.Array:
        return over(v)

    # a filter on the score must not score every vector once more
    return cosine.asNondeterministic()(vector)


def hamming_to(query: Sequence[float], vector: Column) -> Column:
    """How many components have another sign (above 0 or not) than the query's."""
    over = _scored(query, lambda x, q: ((x > 0) != (q > 0)).sum(axis=1).astype(float), pa.int32())

    @F.arrow_udf("int")
    def hamming(v: pa.Array) -> pa.Array:
        return over(v)

    return hamming.asNondeterministic()(vector)
