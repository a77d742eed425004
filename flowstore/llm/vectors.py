"""Vectors as Arrow batches: what is usable, and streams of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 64


def exploded(df: DataFrame, ids: str, vectors: str) -> DataFrame:
    """(id, v) of two parallel array columns; entries without an id are left out."""
    pairs = F.arrays_zip(F.col(f"`{ids}`").alias("id"), F.col(f"`{vectors}`").alias("v"))
    return df.select(F.inline(pairs)).toDF("id", "v").where("id is not null")


def usable(batch: pa.RecordBatch, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 vectors of the usable rows of a batch (id, v): not null, of length dim, finite, not all zero."""
    ids, v = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
    size = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    if not len(at):
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    flat = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    good = np.isfinite(flat).all(1) & (flat != 0).any(1)
    return ids[at[good]], np.ascontiguousarray(flat[good])


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of norm 1, in float64."""
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def packed(raw: np.ndarray) -> pa.Array:
    """Rows as a column of bytes."""
    return fixed(np.ascontiguousarray(raw, np.float32).view(np.uint8).reshape(len(raw), -1))


def fixed(rows: np.ndarray) -> pa.Array:
    """uint8 rows of one width as a binary column, without a copy for each row."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def bytes_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The inverse of `fixed`. A width of -1 is that of the rows."""
    if not len(column):
        return np.empty((0, max(0, width)), np.uint8)
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(a), -1)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000, shift: int = 0) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows (but for the last) that never cut a run of equal keys.

    The batches must be sorted, or at least clustered, by the key; of its bits the lowest
    `shift` do not count.
    """
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy() >> shift
        last = np.flatnonzero(k != k[-1])
        done = int(last[-1]) + 1 if len(last) else 0
        if done:
            yield t.slice(0, done)
            rest = t.slice(done).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
        else:
            held = t.to_batches()
            rows = max(rows, 2 * n)  # one long run: look again when it has doubled
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    if len(keys):
        at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        yield from zip(at[:-1].tolist(), at[1:].tolist())
