"""Vectors packed into tiles: one row holds up to some thousand vectors of equal length as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = "tile long, dim int, n int, ids binary, copies binary, data binary"


def is_sound(embedding: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(embedding)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, good), F.lit(False))


def tiles(vectors: DataFrame, rows: int, components: int | None = None) -> DataFrame:
    """vectors (id long, copies long, v array<float or double>) -> tiles in the order of the rows.

    A tile holds vectors of one length, at most so many of them and, if given, so many components. Its number is unique within the table; write the
    table before numbers are used twice.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, {}

        def tile(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, copies, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            row = [(part << 32) + made, dim, len(ids), ids.tobytes(), copies.tobytes(), data.astype("<f8").tobytes()]
            made += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            names = [f.split()[0] for f in TILE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            ids, copies = (np.asarray(batch.column(i), np.int64) for i in range(2))
            lists = batch.column(2)
            values, ends = np.asarray(lists.flatten(), np.float64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            dims = np.diff(ends)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                most = rows if components is None else max(1, min(rows, components // max(dim, 1)))
                for low in range(0, len(at), most):
                    some = at[low : low + most]
                    data = values[ends[some][:, None] + np.arange(dim)]
                    held.setdefault(dim, []).append((ids[some], copies[some], data))
                    if sum(len(x[0]) for x in held[dim]) >= most:
                        yield tile(dim)
        for dim in sorted(held):
            yield tile(dim)

    return vectors.select(F.col("id").cast("long"), F.col("copies").cast("long"), F.col("v")).mapInArrow(pack, TILE)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, copies and the matrix of a tile."""
    data = np.frombuffer(row["data"], "<f8").reshape(row["n"], row["dim"])
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row.get("copies", b""), np.int64), data


def sampled(own: DataFrame, rows: int, components: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """own (id, v) -> ids and vectors of a sample by length, the same for the same rows; so many rows and components at most."""
    longest = own.agg(F.max(F.size("v"))).first()[0] or 1
    some = own.select("id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(max(1, min(rows, components // longest))).collect()
    out = {}
    for dim in {len(r["v"]) for r in some}:
        of = [r for r in some if len(r["v"]) == dim]
        out[dim] = np.array([r["id"] for r in of], np.int64), np.array([r["v"] for r in of], float).reshape(len(of), dim)
    return out
