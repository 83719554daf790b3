"""One image against the songs of some levels: from its pixels, or from a request to its response."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.config import ScoringConfig
from pixkin.functions.ids import any_level
from pixkin.operators.embedding import Provider
from pixkin.operators.features import Embedder, extract_features
from pixkin.operators.knn import restricted_each
from pixkin.operators.pairs import NARROW, score_pairs
from pixkin.plans.duplicates import best_match
from pixkin.service import ServiceError, check_request, http_get, request_image, response
from pixkin.sources.feature_table import FeatureTable
from pixkin.sources.scratch import written
from pixkin.sources.store import IndexStore

#: The query's id: no song's, as those are never empty.
QUERY = ""


def image_features(store: IndexStore, rgb: np.ndarray, embed: Embedder | Provider | None, config: ScoringConfig) -> DataFrame:
    """The feature row of an image that is in no table."""
    if embed is None:
        raise ServiceError("EMBEDDER_NOT_READY")
    height, width = rgb.shape[:2]
    row = (QUERY, bytearray(np.ascontiguousarray(rgb[:, :, ::-1], np.uint8).tobytes()), width, height, 3)
    image = store.spark.createDataFrame([row], "id string, data binary, width int, height int, nChannels int")
    rows = written(extract_features(image, config, embed), "query-features")
    if (error := rows.first()["error"]) is not None:
        raise ServiceError("PIPELINE_ERROR", error)
    return rows


def image_matches(query: DataFrame, songs: DataFrame, store: IndexStore, table: FeatureTable, config: ScoringConfig = ScoringConfig(), threshold: float | None = None) -> DataFrame:
    """query: a row of `image_features`; songs: (song_id) that may match, of the index.  Its nearest songs by the
    index, scored with their stored features; songs without these are left out.  Only the hits' features are read."""
    index = store.entries().select(F.col("song_id").alias("id"), "emb_key", "cls")
    allowed = songs.select(F.col("song_id").alias("id")).distinct()
    own = query.select("id", "cls")
    k = min(config.neighbours, max(1, allowed.count()))
    hits = written(restricted_each(own, index.select("id", "cls").unionByName(own), allowed, k), "hits")
    keys = index.select("id", "emb_key").join(hits.select(F.col("id_b").alias("id")), "id", "left_semi")
    columns = [*NARROW, "patches"]
    stored = table.read(columns).join(F.broadcast(keys), "emb_key").select("id", *columns)
    features = written(stored.unionByName(query.select("id", *columns)), "hit-features")
    return score_pairs(hits, features, config, "query", config.threshold if threshold is None else threshold, matrix=True)


def query_image(rgb: np.ndarray, level: str, songs: DataFrame, store: IndexStore, table: FeatureTable, embed: Embedder | Provider, config: ScoringConfig = ScoringConfig(), threshold: float = 0.50, most: int = 5) -> DataFrame:
    """songs: (song_id, levels).  The best `most` songs of a level for an image, with their places."""
    found = songs.filter(any_level(F.col("levels"), [level])).join(store.ids(), "song_id", "left_semi")
    matches = image_matches(image_features(store, rgb, embed, config), found, store, table, config, threshold)
    first = matches.orderBy(F.desc("composite"), F.desc("coarse"), "id_b").limit(most)
    rows = [r.asDict() for r in first.collect()]  # `most` of them
    return store.spark.createDataFrame([(i, r["id_b"], r["composite"], r["verdict"]) for i, r in enumerate(rows, 1)], "place int, song_id string, composite double, verdict string")


def check_duplicate(body: str, songs: DataFrame, store: IndexStore, table: FeatureTable, decode: Callable, embed: Embedder | Provider | None, get: Callable = http_get, config: ScoringConfig = ScoringConfig()) -> dict:
    """body: the request's JSON; songs: (song_id, song_name, name, video_id, levels).  The response's fields, none if
    no song of the levels reaches the threshold; what is wrong is a ServiceError with its code."""
    began = time.time()
    url, levels, exclude = check_request(body)
    rgb = request_image(url, decode, get)
    if store.ids().first() is None:
        raise ServiceError("INDEX_NOT_FOUND")
    of_levels = songs.filter(any_level(F.col("levels"), levels))
    if of_levels.first() is None:
        raise ServiceError("NO_SONGS_FOR_LEVEL")
    indexed = of_levels.join(store.ids(), "song_id", "left_semi")
    indexed = written(indexed if exclude is None else indexed.filter(F.col("song_id") != exclude), "songs-of-levels")
    if indexed.first() is None:
        raise ServiceError("NO_INDEXED_SONGS")
    best = best_match(image_matches(image_features(store, rgb, embed, config), indexed, store, table, config)).first()
    if best is None:
        return response(None)
    song = indexed.filter(F.col("song_id") == best["id_b"]).first()
    match = best.asDict() | {"label_b": song["song_name"] or song["name"], "video_id": song["video_id"], "elapsed_ms": 1000 * (time.time() - began)}
    return response(match | {"stages_run": ["hash_ensemble", "dct_spectrum", "sector_grid", "global_semantic", "patch_spatial"]})
