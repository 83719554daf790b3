"""Adding, editing and deleting one song on request: the image is fetched, its features are stored
under the key of its pixels, and the index takes one change.  Each returns its response's body."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.config import ScoringConfig
from pixkin.functions.ids import stable_vec_id
from pixkin.operators.features import Embedder, extract_features
from pixkin.service import ServiceError, change_request, http_get, request_image
from pixkin.sources.feature_table import FeatureTable
from pixkin.sources.store import IndexStore, SongExists, WriteConflict


def _featured(store: IndexStore, table: FeatureTable, doc_id: str, rgb: np.ndarray, embed: Embedder | None, config: ScoringConfig) -> DataFrame:
    """The song's entry; its features are in the table when this returns."""
    if embed is None:
        raise ServiceError("EMBEDDER_NOT_READY")
    height, width = rgb.shape[:2]
    row = (doc_id, bytearray(np.ascontiguousarray(rgb[:, :, ::-1], np.uint8).tobytes()), width, height, 3)
    image = store.spark.createDataFrame([row], "id string, data binary, width int, height int, nChannels int")
    rows = store.scratch(extract_features(image, config, embed))
    if (error := rows.first()["error"]) is not None:
        raise ServiceError("PIPELINE_ERROR", error)
    table.add(rows)
    return rows.select(F.col("id").alias("song_id"), stable_vec_id(F.col("id")).alias("vec_id"), "emb_key", "cls")


def _body(action: str, entry: DataFrame, *names: str) -> dict:
    row = entry.first()
    return {"action": action, "mongo_id": row["song_id"], "faiss_id": row["vec_id"]} | {n: row[n] for n in names}


def _writing(change: Callable, *args: DataFrame) -> None:
    try:
        change(*args)
    except (PySparkException, WriteConflict) as e:
        raise ServiceError("INDEX_WRITE_FAILED", str(e)) from e


def _held(store: IndexStore, doc_id: str) -> DataFrame:
    return store.scratch(store.entries().filter(F.col("song_id") == doc_id))


def add_song(store: IndexStore, table: FeatureTable, body: str, decode: Callable, embed: Embedder | None, get: Callable = http_get, config: ScoringConfig = ScoringConfig()) -> dict:
    url, doc_id = change_request(body)
    if _held(store, doc_id).first() is not None:
        raise ServiceError("DOC_ALREADY_INDEXED")
    entry = _featured(store, table, doc_id, request_image(url, decode, get), embed, config)
    try:
        _writing(store.add, entry)
    except SongExists:  # added by another writer meanwhile
        raise ServiceError("DOC_ALREADY_INDEXED") from None
    return _body("added", entry, "emb_key")


def edit_song(store: IndexStore, table: FeatureTable, body: str, decode: Callable, embed: Embedder | None, get: Callable = http_get, config: ScoringConfig = ScoringConfig()) -> dict:
    """A song that isn't in the index is added.  Features of the old image go if no song has them."""
    url, doc_id = change_request(body)
    old = _held(store, doc_id)
    entry = _featured(store, table, doc_id, request_image(url, decode, get), embed, config)
    _writing(store.upsert, entry)
    if old.first() is None:
        return _body("added", entry, "emb_key")
    table.remove_unreferenced(store.entries(), old.select("emb_key"))
    return _body("updated", entry, "emb_key")


def delete_song(store: IndexStore, table: FeatureTable, body: str) -> dict:
    _, doc_id = change_request(body, needs_image=False)
    old = _held(store, doc_id)
    if old.first() is None:
        raise ServiceError("DOC_NOT_FOUND")
    _writing(store.delete, old.select("song_id"))
    table.remove_unreferenced(store.entries(), old.select("emb_key"))
    return _body("deleted", old)
