"""Reading, staging and Arrow-batch helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.workspace import Workspace

PIECE_BYTES = 1 << 20  # text that a kernel holds as numpy arrays at once; a longer text is one piece


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> Workspace:
    """A new folder below the one all executors share (``spark.checkpoint.dir``)."""
    return Workspace(spark)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and the row offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows [first, last) of a column with at most ``limit`` bytes, or one longer row."""
    buf, at = text_buffer(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, buf[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def binary_array(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of the given slices of a byte buffer."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    take = np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])
    data = np.ascontiguousarray(buf[take])
    if at[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)])
