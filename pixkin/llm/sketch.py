"""Rows of a count-min sketch over cells of hashes: gathered in tasks of bounded memory, merged by ranges
of cells, and brought to the driver as a few bits a cell, whatever the number of hashes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches

#: Ranges of cells that a sketch row is merged in.
SHARDS = 64
#: Cells that a task gathers of each row before it hands them on.
FLUSH = 1 << 19
#: Parts in an Arrow batch; one takes up to 50 KB.
PART_ROWS = 200
#: Columns of what tasks hand on.
PARTS = "shard int, cells binary, counts binary"
_TYPES = (pa.int32(), pa.binary(), pa.binary())


def log2_cells(items: float, a_cell: float, least: int, most: int) -> int:
    """Cells, as a power of two, for so many items with about `a_cell` in each, within bounds."""
    return int(min(max(np.ceil(np.log2(max(items / a_cell, 1))), least), most))


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Bytes of equal weight together, which compress well."""
    x = values.astype(kind)
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplaned(data: bytes | pa.Buffer, kind: str) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(x.T).view(kind).ravel().astype(np.int64)


def _zip(data: bytes) -> bytes:
    return zlib.compress(data, 1)


class Gathered:
    """Cells of each row that a task has seen since its last flush, which comes after `flush` of them.
    zipped: parts are handed on in fewer bytes, for more work."""

    def __init__(self, rows: int, log2: int, flush: int = FLUSH, zipped: bool = False):
        self.size, self.most, self.zipped = (1 << log2) // SHARDS, flush, zipped
        self.held: list[list[np.ndarray]] = [[] for _ in range(rows)]
        self.many = 0

    def add(self, row: int, cells: np.ndarray) -> None:
        self.held[row].append(cells.astype(np.uint32))
        self.many += len(cells) if row == 0 else 0

    def full(self) -> bool:
        return self.many >= self.most

    def flush(self) -> list[pa.Array]:
        """The columns of PARTS."""
        out = []
        for row, held in enumerate(self.held):
            cells, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint32), return_counts=True)
            bounds = np.searchsorted(cells, np.arange(SHARDS + 1) * self.size)
            for s in range(SHARDS):
                own, n = cells[bounds[s] : bounds[s + 1]].astype(np.int64), counts[bounds[s] : bounds[s + 1]]
                if len(own):
                    part = _planes(np.diff(own, prepend=s * self.size), "<u4"), _planes(np.minimum(n, 65_535), "<u2")
                    out.append((row * SHARDS + s, *(map(_zip, part) if self.zipped else part)))
            held.clear()
        self.many = 0
        return [pa.array([x[i] for x in out], t) for i, t in enumerate(_TYPES)]


def merged(parts: DataFrame, rows: int, log2: int, pack: Callable[[np.ndarray], np.ndarray], zipped: bool = False) -> list[np.ndarray]:
    """parts: PARTS.  Per row the packed counts of all cells.  pack: from the counts of a range to bytes."""
    size = (1 << log2) // SHARDS
    read = (lambda x: zlib.decompress(x.as_buffer())) if zipped else (lambda x: x.as_buffer())

    def merged_shard(shard: int, total: np.ndarray) -> pa.RecordBatch:
        packed = zlib.compress(pack(total).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed], pa.binary())], names=["shard", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts in the order of their shards, one shard's counts at a time."""
        shard, total = None, np.zeros(0, np.uint32)
        for batch in batches:
            for own, cells, counts in zip(batch.column("shard").to_pylist(), batch.column("cells"), batch.column("counts"), strict=True):
                if own != shard:
                    if shard is not None:
                        yield merged_shard(shard, total)
                    shard, total = own, np.zeros(size, np.uint32)
                at = np.cumsum(_unplaned(read(cells), "<u4"))
                total[at] = np.minimum(total[at] + _unplaned(read(counts), "<u2"), 1 << 31)
        if shard is not None:
            yield merged_shard(shard, total)

    width = len(pack(np.zeros(size, np.uint32)))
    out = [np.zeros(SHARDS * width, np.uint8) for _ in range(rows)]
    with small_batches(parts.sparkSession, PART_ROWS):
        dealt = parts.repartition("shard").sortWithinPartitions("shard")
        found = dealt.mapInArrow(merge, "shard int, packed binary").collect()  # rows * SHARDS rows of a fixed size
    for r in found:
        s = r["shard"] % SHARDS
        out[r["shard"] // SHARDS][s * width : (s + 1) * width] = np.frombuffer(zlib.decompress(r["packed"]), np.uint8)
    return out
