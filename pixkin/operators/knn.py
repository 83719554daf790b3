"""Exact inner-product neighbours by cells: a query meets those blocks only whose ball can reach its k-th score.

Every query first meets the cells nearest to it, until they hold k rows.  The k-th score of these is the least
that the rest has to reach, and it goes only to the cells whose bound does.  On vectors without clusters the
bounds exclude little and the work is that of all pairs of blocks; copies of queries are then one a block.

Vectors that are null, empty, hold null or non-finite components, or have another length than most vectors of the
corpus, are missing: they find nothing and are not found.  Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixkin.operators.cells import BLOCK, Cells, matrix

_FOUND = ["id_a", "id_b", "coarse"]


def _schema(corpus: DataFrame, columns: str) -> str:
    kind = corpus.schema["id"].dataType.simpleString()
    return columns.replace("ID", kind)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same whatever block the rows come from."""
    return (x * y).sum(1)


def _best(k: int, drop_self: bool):
    def work(asked: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        mine = asked.column("id").to_numpy(zero_copy_only=False)
        score = x @ y.T
        if drop_self:
            score[mine[:, None] == ids[None, :]] = -np.inf
        take = min(k, len(ids))
        # all that come near the k-th score, so that ties are decided by id
        cut = np.partition(score, len(ids) - take, axis=1)[:, len(ids) - take]
        i, j = np.nonzero((score >= cut[:, None] - 1e-9) & np.isfinite(score))
        coarse = _exact(x[i], y[j])
        order = np.lexsort((ids[j], -coarse, i))
        i, j, coarse = i[order], j[order], coarse[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, coarse = i[place < take], j[place < take], coarse[place < take]
        return pa.RecordBatch.from_arrays([asked.column("id").take(pa.array(i)), pa.array(ids[j], asked.column("id").type), pa.array(coarse)], names=_FOUND)

    return work


def _first(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id_a").orderBy(F.desc("coarse"), "id_b")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int, drop_self: bool = True, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """queries, corpus: (id, cls).  Per query its k nearest rows: id_a, id_b, coarse, rank.

    report: gets the number of blocks, of queries, and of queries' meetings with a block, for which
    it runs further jobs; without pruning the last is the product of the others."""
    queries, corpus = queries.select("id", "cls"), corpus.select("id", "cls")
    cells = Cells.fit(corpus, block)
    kind = corpus.schema["id"].dataType.simpleString()
    if cells is None:
        return corpus.sparkSession.createDataFrame([], f"id_a {kind}, id_b {kind}, coarse double, rank int")
    enough = k + int(drop_self)

    def nearest(own: Cells, x: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
        score = np.where(own.many > 0, x @ own.pivots.T, -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")
        held = np.cumsum(own.many[order], axis=1) - own.many[order]  # before each cell
        out = np.zeros(score.shape, bool)
        np.put_along_axis(out, order, held < enough, axis=1)
        return out & (own.many > 0)

    schema = _schema(corpus, "id_a ID, id_b ID, coarse double")
    routed = cells.routed(queries, nearest)
    hits = cells.met(routed, corpus, _best(k, drop_self), schema)
    more = None
    if len(cells.pivots) > 1:
        least = _first(hits, k).groupBy("id_a").agg(F.min("coarse").alias("least"), F.count("*").alias("n"))
        least = least.select(F.col("id_a").alias("id"), F.when(F.col("n") == k, F.col("least")).otherwise(float("-inf")).alias("least"))

        def reachable(own: Cells, x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            least = batch.column("least").to_numpy(zero_copy_only=False)[:, None]
            return (own.bounds(x)[1] >= least) & (own.many > 0) & ~nearest(own, x, batch)

        asked = queries.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        more = cells.routed(asked, reachable, "least double")
        hits = hits.unionByName(cells.met(more.drop("least"), corpus, _best(k, drop_self), schema))
    if report is not None:
        report |= {"blocks": int(cells.blocks[cells.many > 0].sum()), "queries": queries.count(), "met": routed.count() + (more.count() if more else 0)}
    return _first(hits, k)


def knn_self(features: DataFrame, k: int, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """Every row's k nearest others; the window keeps WindowGroupLimit rows a task."""
    return knn(features, features, k, block=block, report=report)


#: Scores this close are equal: block products of other shapes may differ in the last bits.
TIE = 1e-12


def _ahead(hits: DataFrame, queries: DataFrame, corpus: DataFrame, block: int) -> DataFrame:
    """Per hit (id_a, id_b, coarse) the number of corpus rows that come before it.  Cells that lie before all
    hits of a query as a whole are counted as such, and only those that a hit's score falls into are met."""
    cells = Cells.fit(corpus.select("id", "cls"), block)
    kind = corpus.schema["id"].dataType.simpleString()
    mine = hits.groupBy("id_a").agg(F.collect_list(F.struct("id_b", "coarse")).alias("near"))
    mine = mine.select(F.col("id_a").alias("id"), F.col("near.id_b").alias("near"), F.col("near.coarse").alias("coarse"))
    if cells is None:
        return corpus.sparkSession.createDataFrame([], f"id_a {kind}, id_b {kind}, ahead long")

    def ends(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column("coarse").to_pylist()
        return np.array([[min(x)] for x in lists]), np.array([[max(x)] for x in lists])

    def touched(own: Cells, x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        (low, high), (least, most) = own.bounds(x), ends(batch)
        return (high >= least - TIE) & ~(low > most + TIE) & (own.many > 0)

    def whole(batches):
        for b in batches:
            if not b.num_rows:
                continue
            before = (cells.bounds(matrix(b.column("cls")))[0] > ends(b)[1] + TIE) & (cells.many > 0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("near"), pa.array((before * cells.many).sum(1).astype(np.int64))], names=["id_a", "near", "ahead"])

    def count(asked: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        out = [[], [], []]
        for q, row in zip(x, asked.to_pylist(), strict=True):
            score = np.asarray(_exact(q[None], y))
            near, coarse = np.asarray(row["near"])[:, None], np.asarray(row["coarse"])[:, None]
            before = (score > coarse + TIE) | ((np.abs(score - coarse) <= TIE) & (ids < near))
            for values, own in zip(out, ([row["id"]] * len(near), near[:, 0].tolist(), (before & (ids != near)).sum(1).tolist()), strict=True):
                values += own
        kinds = (asked.column("id").type, asked.column("id").type, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["id_a", "id_b", "ahead"])

    asked = queries.select("id", F.col("cls").cast("array<double>").alias("cls")).join(mine, "id")
    met = cells.met(cells.routed(asked, touched, f"near array<{kind}>, coarse array<double>"), corpus, count, _schema(corpus, "id_a ID, id_b ID, ahead long"))
    base = asked.mapInArrow(whole, f"id_a {kind}, near array<{kind}>, ahead long").select("id_a", F.explode("near").alias("id_b"), "ahead")
    return met.unionByName(base).groupBy("id_a", "id_b").agg(F.sum("ahead").alias("ahead"))


def restricted_each(queries: DataFrame, corpus: DataFrame, allowed: DataFrame, k: int, mode: str = "postfilter", block: int = BLOCK) -> DataFrame:
    """queries, corpus: (id, cls); allowed: (id).  Each query may find all allowed rows but itself.  prefilter
    searches the allowed ones only.  postfilter ranks the corpus first, keeps max(|allowed|, 4k) and then
    the allowed ones, so it may return fewer: these are the first of prefilter's hits, as far as their places
    in the whole corpus, which are counted, are low enough."""
    corpus = corpus.select("id", "cls")
    hits = knn(queries, corpus.join(allowed, "id", "left_semi"), k, block=block)
    if mode == "prefilter":
        return hits
    own = queries.join(allowed, "id", "left_semi").select(F.col("id").alias("id_a"), F.lit(1).alias("own"))
    wide = F.greatest(F.lit(allowed.count()) - F.coalesce("own", F.lit(0)), F.lit(4 * k))
    placed = hits.join(_ahead(hits, queries, corpus, block), ["id_a", "id_b"]).join(own, "id_a", "left")
    return placed.filter(F.col("ahead") < wide).select("id_a", "id_b", "coarse", "rank")


def candidate_pairs(neighbours: DataFrame, coarse: float) -> DataFrame:
    """Unordered pairs with id_a < id_b, once each, at least `coarse` alike."""
    pair = neighbours.filter(F.col("coarse") >= coarse)
    return pair.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "coarse").groupBy("id_a", "id_b").agg(F.max("coarse").alias("coarse"))


def pairs_above(features: DataFrame, coarse: float, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """All pairs id_a < id_b at least `coarse` alike: a row meets its own cell and the later ones that its
    bound allows.  report: as of `knn`."""
    rows = features.select("id", "cls")
    cells = Cells.fit(rows, block)
    schema = _schema(rows, "id_a ID, id_b ID, coarse double")
    if cells is None:
        return rows.sparkSession.createDataFrame([], schema)

    def reachable(own: Cells, x: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
        mine = np.argmax(x @ own.pivots.T - 0.5 * (own.pivots**2).sum(1), axis=1)[:, None]
        return (own.bounds(x)[1] >= coarse) & (own.many > 0) & (np.arange(len(own.many)) >= mine)

    def close(asked: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(x @ y.T >= coarse - 1e-9)
        a, b, score = asked.column("id").to_numpy(zero_copy_only=False)[i], ids[j], _exact(x[i], y[j])
        other = (asked.column("cell").to_numpy() != asked.column("own").to_numpy())[i]
        keep = (score >= coarse) & np.where(other, a != b, a < b)
        a, b, score = a[keep], b[keep], score[keep]
        kind = asked.column("id").type
        return pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b), kind), pa.array(np.where(a < b, b, a), kind), pa.array(score)], names=_FOUND)

    routed = cells.routed(rows, reachable)
    if report is not None:
        report |= {"blocks": int(cells.blocks[cells.many > 0].sum()), "queries": rows.count(), "met": routed.count()}
    return cells.met(routed, rows, close, schema)
