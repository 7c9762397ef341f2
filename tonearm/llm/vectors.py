"""Shared by the embedding operators: checked vectors as packed bytes, and work on pairs of row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C


def packed(frame: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", kind: str | None = None) -> DataFrame:
    """id, v: vectors as little-endian bytes (floats or doubles, as given, or of `kind`), null where they can't take part.

    That is: null, empty, zero, or with null or non-finite components. Vectors of any length take part, each with those
    of its own length.
    """
    kind = kind or kind_of(frame, embedding)

    def pack(batches):
        for b in batches:
            lists = b.column("x")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(kind)  # nulls: nan
            offsets -= offsets[0]
            size = np.diff(offsets)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))[offsets]
            some = np.concatenate(([0], np.cumsum(flat != 0)))[offsets]
            ok = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bad) == 0) & (np.diff(some) > 0)
            data = flat[np.repeat(ok, size)]
            ends = np.concatenate(([0], np.cumsum(np.where(ok, size, 0)))) * data.itemsize
            v = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ok), [pa.array(ok).buffers()[1], pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column("id"), v.cast(pa.binary())], ["id", "v"])

    cast = F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>")
    return C.materialise(frame.select(F.col(vec_id).cast("long").alias("id"), cast.alias("x")).mapInArrow(pack, "id long, v binary"), "vectors")


def kind_of(frame: DataFrame, embedding: str = "embedding") -> str:
    """Number format of the packed vectors: floats stay floats, all else becomes doubles."""
    return "<f4" if isinstance(frame.schema[embedding].dataType.elementType, T.FloatType) else "<f8"


def usual_size(rows: DataFrame) -> int | None:
    """The commonest length of the packed vectors, in bytes (ties: the shortest); None without any."""
    first = rows.where("v is not null").groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return first["n"] if first else None


def sizes(column) -> np.ndarray:
    """Lengths in bytes of a binary column without nulls."""
    return pc.binary_length(column).to_numpy()


def unpack(column, dim: int, kind: str) -> np.ndarray:
    """Packed vectors as a matrix of doubles."""
    return C.fixed_bytes(column, dim * np.dtype(kind).itemsize).view(kind).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is divided out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, in double precision and alike for equal rows."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def star_edges(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the components of pairs (a, b) over 0 .. n - 1: node, smallest node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]
