"""A change feed applied to the index, each batch as one change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixkin.sources.store import IndexStore


def latest_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def follow(changes: DataFrame, store: IndexStore, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """changes: a stream of (song_id, op, number, vec_id, emb_key, cls), op being add, edit or delete.
    What the last change of a batch leaves is upserted or removed, in one change of the index;
    running a batch again changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        last = latest_changes(batch, "song_id", ["number"]).persist()
        if last.first() is not None:
            store.apply(last.filter("op <> 'delete'"), deleted=last.filter("op = 'delete'"))
        last.unpersist()

    writer = changes.writeStream.queryName(name) if name else changes.writeStream
    return writer.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
