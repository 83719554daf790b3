"""Building the index: songs that aren't there yet are fetched, decoded, turned into features and added."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.config import ScoringConfig
from pixkin.functions.ids import eligible, stable_vec_id, thumbnail_url
from pixkin.operators.embedding import Provider
from pixkin.operators.features import Embedder, extract_features
from pixkin.sources.feature_table import FeatureTable, ImageCache
from pixkin.sources.images import usable
from pixkin.sources.store import IndexStore


def build_index(songs: DataFrame, store: IndexStore, table: FeatureTable, cache: ImageCache, get: Callable, decode: Callable, embed: Embedder | Provider, config: ScoringConfig = ScoringConfig(), batches: int = 1, retry_failed: bool = False, report: Callable[[dict], None] | None = None) -> dict:
    """songs: (song_id, video_id).  Adds every song with a video that the store hasn't seen, in batches
    by a hash of the song, each committed by itself: an interrupted build goes on with what is left.
    What can't be fetched, decoded or embedded counts as failed and is tried again only on request.

    Returns, and reports after each batch, the counts, the rate a second and the seconds left."""
    began, done, failed = time.time(), 0, 0
    wanted = songs.filter(eligible(F.col("video_id"))).select(F.col("song_id").cast("string").alias("song_id"), "video_id").dropDuplicates(["song_id"])
    batch = F.pmod(F.xxhash64("song_id"), F.lit(batches))
    left = store.pending(wanted, retry_failed).count()
    pending, seen = left, {}
    for i in range(batches if left else 0):
        todo = store.pending(wanted.filter(batch == i), retry_failed)
        urls = todo.select(F.col("song_id").alias("id"), thumbnail_url(F.col("video_id")).alias("url"))
        found = cache.images(urls, get, decode).filter(usable(F.col("width"), F.col("height")))
        rows = store.scratch(extract_features(found, config, embed))
        good = rows.filter("error IS NULL")
        table.add(good)
        entries = good.select(F.col("id").alias("song_id"), stable_vec_id(F.col("id")).alias("vec_id"), "emb_key", "cls")
        lost = store.scratch(todo.select("song_id").join(entries.select("song_id"), "song_id", "left_anti"))
        added, missed = good.count(), lost.count()
        if added or missed:
            store.upsert(entries, lost)
        done, failed, left = done + added, failed + missed, left - added - missed
        took = time.time() - began
        rate = done / took if took > 0 else 0.0
        seen = {"pending": pending, "processed": done, "failed": failed, "left": left, "rate": rate, "seconds_left": left / rate if rate else None}
        if report:
            report(seen)
    return seen or {"pending": 0, "processed": 0, "failed": 0, "left": 0, "rate": 0.0, "seconds_left": None}
