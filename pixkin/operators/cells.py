"""Cells of vectors around pivots, with balls that tell which of them a query can leave out.

Pivots are the centres of a bounded sample of the corpus.  Every vector belongs to the pivot nearest to it, and
a cell's ball reaches to its farthest vector: for a query q and a cell with pivot c and radius r, no inner
product lies outside q.c - |q| r to q.c + |q| r.  A cell with many rows, as of one vector that is repeated a
lot, is dealt into blocks of bounded size; a block is one group of a task, and corpus rows are never copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, about, and of a cell.
BLOCK = 16_384
#: Pivots at most, vectors of the sample for each, and rounds of moving pivots to their centres.
PIVOTS, SAMPLE, ROUNDS = 4096, 8, 4
#: Bounds are taken this much wider, for rounding.
SLACK = 1e-9
#: Queries that are multiplied with a block at a time.
QUERIES = 256


def usable(vector: Column | str, size: int | Column | None = None) -> Column:
    """Whether a vector can be searched: neither null nor empty, without null, NaN or infinite components,
    and of the given length."""
    v = F.col(vector) if isinstance(vector, str) else vector
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    long_enough = F.size(v) > 0 if size is None else F.size(v) == size
    return F.coalesce(v.isNotNull() & long_enough & sound, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    half = 0.5 * (pivots**2).sum(1)
    return np.concatenate([(x[i : i + 1024] @ pivots.T - half).argmax(1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, int)


@dataclass
class Cells:
    """size: components of a vector; rows: of the corpus; per cell its pivot, radius, rows and blocks."""

    size: int
    rows: int
    pivots: np.ndarray
    radius: np.ndarray
    many: np.ndarray
    block: int

    @property
    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.many // self.block))

    @classmethod
    def fit(cls, corpus: DataFrame, block: int = BLOCK) -> Cells | None:
        """corpus: (id, cls).  Vectors of another length than most of them (of equally many, the longer), null
        ones and those that `usable` rejects count as missing.  None if there are no others."""
        sound = corpus.filter(usable("cls"))
        sizes = sound.groupBy(F.size("cls").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        if sizes is None:
            return None
        size, rows = sizes["size"], sizes["count"]
        n = min(PIVOTS, -(-rows // block))
        if n == 1:  # one ball around nothing: all queries meet it
            return cls(size, rows, np.zeros((1, size)), np.array([1e300]), np.array([rows]), block)
        taken = sound.filter(F.size("cls") == size).orderBy(F.xxhash64("id"), "id").limit(SAMPLE * n).select("cls").toArrow()
        x = matrix(taken.column("cls").combine_chunks())
        pivots = x[:: max(1, len(x) // n)][:n]
        for _ in range(ROUNDS):
            own = _nearest(x, pivots)
            total = np.zeros_like(pivots)
            np.add.at(total, own, x)
            count = np.bincount(own, minlength=len(pivots))
            pivots = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], pivots)
        found = cls(size, rows, pivots, np.zeros(n), np.zeros(n, np.int64), block)
        for r in found.placed(corpus).groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("many")).collect():  # a row a cell
            found.radius[r["cell"]], found.many[r["cell"]] = r["far"], r["many"]
        return found

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows: (id, cls).  Those usable, with cell and the distance from its pivot."""
        pivots = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("cls"))
                cell = _nearest(x, pivots)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cls"), pa.array(cell.astype(np.int32)), pa.array(np.linalg.norm(x - pivots[cell], axis=1))], names=["id", "cls", "cell", "far"])

        kind = rows.schema["id"].dataType.simpleString()
        rows = rows.filter(usable("cls", self.size)).select("id", F.col("cls").cast("array<double>").alias("cls"))
        return rows.mapInArrow(place, f"id {kind}, cls array<double>, cell int, far double")

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row and cell the least and largest inner product with a vector of the cell."""
        middle, reach = x @ self.pivots.T, np.linalg.norm(x, axis=1)[:, None] * self.radius
        reach = np.where(self.many > 0, reach + SLACK, -np.inf)
        return middle - reach, middle + reach

    def routed(self, queries: DataFrame, choose: Callable[[Cells, np.ndarray, pa.RecordBatch], np.ndarray], carry: str = "") -> DataFrame:
        """queries: (id, cls and the columns of carry, as `name type, ...`).  A row for each block of each cell that
        choose, from the vectors and their batch, says yes to: rows by cells."""
        names = ["id", "cls", *[c.split()[0] for c in carry.split(", ") if c]]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    x = matrix(b.column("cls"))
                    row, cell = np.nonzero(choose(self, x, b))
                    many = self.blocks[cell]
                    row, cell = np.repeat(row, many), np.repeat(cell, many)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    own = _nearest(x, self.pivots)[row]
                    for i in range(0, len(row), 10_000):
                        take = pa.array(row[i : i + 10_000])
                        more = [pa.array(v[i : i + 10_000].astype(np.int32)) for v in (cell, part, own)]
                        yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in names], *more], names=[*names, "cell", "part", "own"])

        kind = queries.schema["id"].dataType.simpleString()
        queries = queries.filter(usable("cls", self.size)).select("id", F.col("cls").cast("array<double>").alias("cls"), *names[2:])
        more = f", {carry}" if carry else ""
        return queries.mapInArrow(route, f"id {kind}, cls array<double>{more}, cell int, part int, own int")

    def met(self, routed: DataFrame, corpus: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        """Every routed query with its block: work(queries, their vectors, the block's ids and vectors).  A task
        holds one block at a time, and queries come in batches."""
        many = F.array(*[F.lit(int(n)) for n in self.blocks]) if len(self.blocks) > 1 or self.blocks[0] > 1 else None
        rows = self.placed(corpus)
        part = F.lit(0) if many is None else F.pmod(F.xxhash64("id"), F.element_at(many, F.col("cell") + 1).cast("long")).cast("int")
        rows = rows.select("cell", part.alias("part"), F.lit(False).alias("asks"), F.col("id").alias("row_id"), "cls")
        asked = routed.select("cell", "part", F.lit(True).alias("asks"), "cls", *[c for c in routed.columns if c not in ("cell", "part", "cls")])
        both = rows.unionByName(asked, allowMissingColumns=True).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, vectors = None, [], []
            for b in batches:
                cell, sub, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "asks"))
                new = np.flatnonzero((cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]) | (asks[1:] != asks[:-1])) + 1
                for first, last in zip([0, *new], [*new, b.num_rows], strict=True):
                    if first == last:
                        continue
                    run = b.slice(first, last - first)
                    if (here := (cell[first], sub[first])) != at:
                        at, ids, vectors = here, [], []
                    if not asks[first]:
                        ids.append(run.column("row_id").to_numpy(zero_copy_only=False))
                        vectors.append(matrix(run.column("cls")))
                    elif ids:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                        for i in range(0, run.num_rows, QUERIES):
                            some = run.slice(i, QUERIES)
                            yield work(some, matrix(some.column("cls")), ids[0], vectors[0])

        return both.mapInArrow(meet, schema)
