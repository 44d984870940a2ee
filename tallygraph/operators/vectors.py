"""Sums of vectors by key: added up within tasks first, so that a key of many rows is no task's load."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of sums that a task holds before it passes them on.
HELD = 64 << 20


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one width, none of them null, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), pa.float64()))


def scattered(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place."""
    out, order = np.zeros((n, values.shape[1])), np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    if len(places):
        out[places] = np.add.reduceat(values[order], first)
    return out


def summed(keys: pa.Array, values: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Each key once, in order of appearance, with the sum of its rows."""
    coded = keys.dictionary_encode()
    return coded.dictionary, scattered(values, coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary))


def vector_sums(rows: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """key and value: the sum of the vectors, all of one width, of each key; rows with a null vector or key are left out."""
    held = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value)
    kind = held.schema[key].dataType
    names, spec = [key, value], f"`{key}` {kind.simpleString()}, `{value}` array<double>"
    batch_of = lambda k, v: pa.RecordBatch.from_arrays([k.cast(to_arrow_type(kind)), lists(v)], names=names)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[pa.Array, np.ndarray]] = []

        def merged() -> tuple[pa.Array, np.ndarray]:
            return summed(pa.concat_arrays([k for k, _ in parts]), np.concatenate([v for _, v in parts]))

        for batch in batches:
            if batch.num_rows:
                parts.append(summed(batch.column(0), matrix(batch.column(1), width)))
            if sum(v.nbytes for _, v in parts) > HELD:
                parts = [merged()]
                if parts[0][1].nbytes > HELD // 2:
                    yield batch_of(*parts.pop())
        if parts:
            yield batch_of(*merged())

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, so all but a batch's last key are complete."""
        last: tuple[pa.Array, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v = summed(*((batch.column(0), matrix(batch.column(1), width)) if last is None else (pa.concat_arrays([last[0], batch.column(0)]), np.concatenate([last[1], matrix(batch.column(1), width)]))))
            last = k[-1:], v[-1:]
            if len(k) > 1:
                yield batch_of(k[:-1], v[:-1])
        if last is not None:
            yield batch_of(*last)

    return held.mapInArrow(within, spec).repartition(key).sortWithinPartitions(key).mapInArrow(across, spec)
