"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are brought to length one and rotated, and their coordinates split into blocks.  Two
vectors with a cosine of c or more are at most 2 - 2c apart (squared), so in at least one block they
are within that block's share of it.  Each block is range-joined: its first coordinates are cut
into cells as wide as the share's root, a vector visits the neighbouring cells that it may have
partners in, and a cell is worked in bounded pieces.  Block distances are taken between coordinates
on an integer grid, so that every task computes them exactly alike, and a pair counts in the first
block that brings it up; then its cosine is taken in double precision.

Exactly equal vectors are one class with a multiplicity.  Links are counted where they are found
and passed on as sums and as one edge a vector, never as pairs.

Vectors of different lengths have no cosine; each length is joined by itself.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and neither does a null vec_id, whose component is null; repeated rows link with each
other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, written

COSINE = 0.95
BLOCKS = 4
GRID_DIMS = 2
#: Vectors of a cell that are taken together, and their bytes; a task holds two such pieces at most.
PIECE = 16_384
PIECE_BYTES = 32 << 20
#: Rows of a piece that are compared at once.
STRIP = 256
GRID = float(1 << 20)
SEED = 20_240


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Space:
    """How vectors of d components are split and compared."""

    def __init__(self, d: int, cosine: float = COSINE, blocks: int = BLOCKS):
        self.cosine, self.turn = cosine, rotation(d)
        edges = np.linspace(0, d, min(blocks, d) + 1).astype(int)
        self.blocks = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        # a share in proportion to a block's components; the slack covers the grid's rounding
        self.budget = [(2 - 2 * cosine) * (s.stop - s.start) / d + 1e-4 for s in self.blocks]
        self.dims = [min(GRID_DIMS, s.stop - s.start) for s in self.blocks]

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated unit vectors on the integer grid."""
        return np.rint(self.unit(vectors) @ self.turn * GRID)

    def visits(self, placed: np.ndarray, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Rows, their cells and whether these are their homes.  Of two neighbouring cells the one
        with the smaller coordinates is visited from the other."""
        g, width = self.dims[b], math.sqrt(self.budget[b])
        x = placed[:, self.blocks[b]][:, :g] / GRID
        home = np.floor(x / width).astype(np.int64)
        for step in product((-1, 0, 1), repeat=g):
            if step > (0,) * g:
                continue
            cell = home + np.array(step)
            gap = np.maximum(np.maximum(cell * width - x, x - (cell + 1) * width), 0)
            near = np.flatnonzero((gap * gap).sum(1) <= self.budget[b] + 1e-9)
            number = np.zeros(len(near), np.int64)
            for i in range(g):
                number = number * 4096 + cell[near, i] + 2048
            yield near, number, not any(step)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()]) if len(column) else np.zeros((0, 1))


def _repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as `times` says, and which of its repeats it is."""
    place = np.repeat(np.arange(len(times)), times)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Brings label, per node a smaller or equal node, to its components' smallest after links a-b."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        least = np.minimum(la, lb)[differ]
        for side in (la[differ], lb[differ], a[differ], b[differ]):
            np.minimum.at(label, side, least)
        while (label != label[label]).any():
            label[:] = label[label]


def linked_in_piece(space: Space, b: int, vectors: np.ndarray, first: np.ndarray, weight: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows that are `first` (within), or else between them and all others, found by
    block b and none before it.  Per row: the weight of what it is linked with, and the smallest row
    of its component."""
    placed, units = space.placed(vectors), space.unit(vectors)
    left = np.flatnonzero(first)
    right = left if within else np.flatnonzero(~first)
    own = placed[:, space.blocks[b]]
    norm = (own * own).sum(1)
    limit = [x * GRID * GRID for x in space.budget]
    links, label = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    other = own[right].T.copy()
    for at in range(0, len(left), STRIP):
        rows = left[at : at + STRIP]
        skip = at if within else 0  # what was compared with these rows before
        apart = norm[rows][:, None] + norm[right][None, skip:] - 2 * (own[rows] @ other[:, skip:])
        i, j = np.nonzero(apart <= limit[b])
        if within:
            i, j = i[j > i], j[j > i]
        i, j = rows[i], right[skip + j]
        for k in range(0, len(i), 1 << 18):
            p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            for earlier in range(b):
                s = space.blocks[earlier]
                fresh = ((placed[p, s] - placed[q, s]) ** 2).sum(1) > limit[earlier]
                p, q = p[fresh], q[fresh]
            close = (units[p] * units[q]).sum(1) >= space.cosine
            p, q = p[close], q[close]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            _merge(label, p, q)
    return links, label


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: (vec_id, embedding).  Rows with the key of their class (null if they link with nothing),
    and the classes: key, rep, the class's rows and its vector."""
    value = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & value.isNotNull() & (F.size(value) > 0) & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(value, lambda x: x != 0)
    keyed = rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"), F.size(value).alias("d"))))
    keyed = written(keyed.select("vec_id", "key.*", value.alias("embedding")), "vectors")
    groups = keyed.filter("d IS NOT NULL").groupBy("a", "b", "d").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("embedding").alias("embedding"))
    return keyed, groups


def linked(groups: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, piece: int = PIECE) -> DataFrame:
    """groups: a written table (node, many, embedding), all of one length.  Per node with links: node,
    links and a smaller or equal node of its component; a node may have several rows."""
    top = groups.select(F.size("embedding").alias("d")).first()
    if top is None:
        return groups.sparkSession.createDataFrame([], "node long, links long, to long")
    space = Space(top["d"], cosine, blocks)
    piece = max(1, min(piece, PIECE_BYTES // (8 * top["d"])))
    plain = groups.select("node", "many", F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    def values(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = space.placed(values(batch))
            for b in range(len(space.blocks)):
                for near, number, home in space.visits(placed, b):
                    cell, n = np.unique(number, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), b, np.int32)), pa.array(cell), pa.array(np.full(len(cell), home)), pa.array(n.astype(np.int64))], names=["block", "cell", "home", "n"])

    # cells of a block: at most (2 / width + 2) ** GRID_DIMS, whatever the number of vectors
    counted = plain.mapInArrow(cells, "block int, cell long, home boolean, n long").groupBy("block", "cell", "home").agg(F.sum("n").alias("n")).collect()
    pieces = {(r["block"], r["cell"], r["home"]): -(-r["n"] // piece) for r in counted}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = values(batch)
            placed, nodes = space.placed(x), batch.column("node")
            data = pa.array([v.tobytes() for v in x], pa.binary())
            spread = (nodes.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for b in range(len(space.blocks)):
                for near, number, home in space.visits(placed, b):
                    cell, at = np.unique(number, return_inverse=True)
                    homes, visitors = (np.array([pieces.get((b, c, h), 0) for c in cell.tolist()], np.int64)[at] for h in (True, False))
                    mine = (spread[near] % np.maximum(homes if home else visitors, 1).astype(np.uint64)).astype(np.int64)
                    # in a home with its pieces, then as the side that is visited; or as a visitor
                    row, k = _repeated(homes)
                    if home:
                        own, (seen, j) = mine[row], _repeated(visitors * (homes > 0))
                        visit = np.arange(len(row) + len(seen)) >= len(row)
                        first, second = np.concatenate([np.minimum(own, k), mine[seen]]), np.concatenate([np.maximum(own, k), j])
                        side, row = np.concatenate([own <= k, np.ones(len(seen), bool)]), np.concatenate([row, seen])
                    else:
                        first, second, visit, side = k, mine[row], np.ones(len(row), bool), np.zeros(len(row), bool)
                    if len(row):
                        take = pa.array(near[row])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(row), b, np.int32)), pa.array(number[row]), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(visit), pa.array(side), nodes.take(take), batch.column("many").take(take), data.take(take)],
                            names=["block", "cell", "i", "j", "visit", "side", "node", "many", "v"],
                        )

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        b, x = table.column("block")[0].as_py(), _matrix(table.column("v"))
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy(zero_copy_only=False)
        within = not table.column("visit")[0].as_py() and table.column("i")[0] == table.column("j")[0]
        links, label = linked_in_piece(space, b, x, side, table.column("many").to_numpy(), within)
        hit = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
        return pa.table({"node": node[hit], "links": links[hit], "to": node[label[hit]]})

    dealt = plain.mapInArrow(deal, "block int, cell long, i int, j int, visit boolean, side boolean, node long, many long, v binary")
    return dealt.groupBy("block", "cell", "i", "j", "visit").applyInArrow(join, "node long, links long, to long")


def near_vectors(rows: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, piece: int = PIECE) -> DataFrame:
    """rows: (vec_id, embedding).  Per row: vec_id, n_links, component_id and kept."""
    keyed, groups = classes(rows)
    groups = written(groups.withColumn("node", F.col("rep").cast("long")), "vector-classes")
    lengths = sorted(r["d"] for r in groups.select("d").distinct().collect())  # a table has few
    parts = [groups.filter(F.col("d") == d) for d in lengths] or [groups]
    found = written(reduce(DataFrame.unionByName, [linked(x, cosine, blocks, piece) for x in parts]), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), Scratch(rows.sparkSession))
    by = groups.select("a", "b", "d", "rep", "many", "node").join(links, "node", "left").join(joined.withColumnRenamed("id", "node"), "node", "left")
    by = by.select("a", "b", "d", "rep", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), "component_id")
    out = keyed.drop("embedding").join(by, ["a", "b", "d"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "rep", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT DISTINCT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
m AS (SELECT id AS vec_id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""
