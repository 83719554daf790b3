"""Embeddings of batches of images by a model that each worker loads once."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.model_cache import ModelCache

Predict = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Provider:
    """load: makes the model in a worker; it takes images (n, height, width, 3) of bytes and gives their vectors (n,
    d) and patches (n, patches, e).  batch: images a call."""

    load: Callable[[], Predict]
    batch: int = 16


def _units(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def predictor(provider: Provider, key: uuid.UUID) -> Callable[[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray] | None]]:
    """From images of one size, provider.batch of them at most, to the unit vectors of each; None for one that the model
    fails on, which is found by trying a failed batch one by one.  The model stays in the worker under the key, where
    `predict_batch_udf` would keep it; that one isn't used as its pixels would pass through the JVM once more."""
    model = ModelCache.get(key)
    if model is None:
        ModelCache.add(key, model := provider.load())

    def one_call(images: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        cls, patches = model(np.stack(images))
        return [(_units(np.asarray(c, float)), _units(np.asarray(p, float)).ravel()) for c, p in zip(cls, patches, strict=True)]

    def predict(images: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        try:
            found = one_call(images)
            if len(found) == len(images):
                return found
        except Exception:  # one bad image must not stop the others
            pass
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for x in images:
            try:
                out.append(one_call([x])[0])
            except Exception:  # it has no vectors, as its row says
                out.append(None)
        return out

    return predict
