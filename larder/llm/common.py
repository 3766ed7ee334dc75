"""Shared helpers: written intermediate tables, hashing and row batching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larder.sources.scratch import ARROW, drop_written, fresh_path, shared_dir, written

__all__ = ["bounded_batches", "drop_written", "fresh_path", "id_crc32", "list_parts", "mix64", "ragged_arange", "shared_dir", "slices", "text_slices", "written"]


def bounded_batches(spark: SparkSession) -> None:
    """Lets the session hand few rows at a time to Python workers, wherever the result of a map over whole texts is used.

    The default of 10,000 rows makes batches of many megabytes, in the worker and in the buffers that its executor keeps.
    """
    for key, value in ARROW.items():
        spark.conf.set(key, value)


def id_crc32(col: str | Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the column's values in each slice stay near max_bytes (one row at least)."""
    for batch in batches:
        sizes = np.diff(_offsets(batch.column(batch.schema.get_field_index(column))))
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < len(sizes):
            yield batch.slice(start)


def text_slices(texts: pa.Array, max_bytes: int = 4 << 20) -> Iterator[pa.Array]:
    """Cuts an array of texts as slices() does record batches."""
    for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", max_bytes):
        yield part.column(0)


def _offsets(array: pa.Array) -> np.ndarray:
    """Offsets of a string, binary or list array, from the slice's own start."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) or pa.types.is_large_list(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, kind)


def list_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (from 0) and flat values of a list array; nulls count as empty lists."""
    if array.null_count:
        array = pa.array([x if x is not None else [] for x in array.to_pylist()], array.type)
    offsets = _offsets(array).astype(np.int64)
    values = np.asarray(array.values.to_numpy(zero_copy_only=False))
    return offsets - offsets[0], values[offsets[0] : offsets[-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit words (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ragged_arange(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
