"""Feature rows of images, and alignment of image pairs."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.config import ScoringConfig
from pixkin.functions import imaging as I
from pixkin.functions.signatures import pack
from pixkin.operators.embedding import Provider, predictor

Embedder = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]

SCHEMA = (
    "id string, emb_key string, cls array<double>, patches array<double>, phash array<long>, dhash array<long>, ahash array<long>, whash array<long>, "
    "hash_size int, dct_bands array<double>, grid array<long>, grid_rows int, grid_cols int, grid_hash_size int, n_keypoints int, width int, height int, error string"
)


#: Bytes and rows that a task hands on at a time: a batch of small rows can stand for large images.
HANDED_BYTES, HANDED_ROWS = 8 << 20, 1000


def framed(rows: Iterable[dict], names: list[str]) -> Iterator[pd.DataFrame]:
    """The rows a bounded few at a time, as soon as they are made."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if held >= HANDED_BYTES or len(out) >= HANDED_ROWS:
            yield pd.DataFrame({c: pd.Series([x[c] for x in out], dtype=object) for c in names})
            out, held = [], 0
    if out:
        yield pd.DataFrame({c: pd.Series([x[c] for x in out], dtype=object) for c in names})


def deflated(rows: DataFrame, column: str) -> DataFrame:
    """rows with the bytes of a column as they go through a join: those of smooth pixels take a small part."""
    at = rows.columns.index(column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                b = whole.slice(first, 64)
                small = pa.array([None if x is None else zlib.compress(x, 1) for x in b.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([small if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return rows.mapInArrow(work, rows.schema)


def pixels(row) -> np.ndarray:
    """RGB of a row of Spark's image source, which stores BGR (or grey, or BGRA)."""
    raw = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
    return np.repeat(raw, 3, 2) if row.nChannels == 1 else raw[:, :, 2::-1]


def extract_features(images: DataFrame, config: ScoringConfig = ScoringConfig(), embed: Embedder | Provider | None = None) -> DataFrame:
    """images: (id, data, width, height, nChannels).  One feature row an image, from its canonical
    size; embed gives the global and the patch vectors, image by image or, as a provider, in batches;
    without it they are null.  A row that can't be worked on keeps its id and says why."""
    provider, key = embed if isinstance(embed, Provider) else None, uuid.uuid4()
    embed = None if provider else embed
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        import hashlib

        for pdf in batches:
            for row in pdf.itertuples():
                done = dict.fromkeys(names) | {"id": row.id, "width": row.width, "height": row.height}
                try:
                    rgb = I.resized(pixels(row), *config.canonical)
                    grey, n = I.luma(rgb), config.hash_size
                    done |= {h: pack(getattr(I, h)(grey, n)) for h in ("phash", "dhash", "ahash", "whash")}
                    data = rgb.round().astype(np.uint8).tobytes()
                    done |= {"emb_key": hashlib.sha256(data).hexdigest(), "hash_size": n}
                    done |= {"dct_bands": I.band_energies(grey, config.dct_side), "grid": pack(I.cell_hashes(grey, config.grid_side, config.grid_hash_size))}
                    done |= {"grid_rows": config.grid_side, "grid_cols": config.grid_side, "grid_hash_size": config.grid_hash_size, "n_keypoints": len(I.corners(grey))}
                    if provider is not None:
                        done["pixels"] = data  # until the vectors are there
                    if embed is not None:
                        cls, patches = embed(rgb)
                        done |= {"cls": cls / np.linalg.norm(cls), "patches": (patches / np.linalg.norm(patches, axis=1, keepdims=True)).ravel()}
                except Exception as e:  # one bad row must not stop the others; it is reported
                    done["error"] = f"{type(e).__name__}: {e}"
                yield done

    def embedded(rows: Iterator[dict]) -> Iterator[dict]:
        predict, (width, height) = predictor(provider, key), config.canonical
        while some := list(islice(rows, provider.batch)):
            sound = [x for x in some if x.get("pixels") is not None]
            found = predict([np.frombuffer(x["pixels"], np.uint8).reshape(height, width, 3) for x in sound]) if sound else []
            for x, vectors in zip(sound, found, strict=True):
                x |= {"error": "no embedding"} if vectors is None or not len(vectors[0]) else dict(zip(("cls", "patches"), vectors, strict=True))
            yield from ({c: x[c] for c in names} for x in some)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = made(batches)
        return framed(rows if provider is None else embedded(rows), names)

    return images.select("id", "data", "width", "height", "nChannels").mapInPandas(work, SCHEMA)


def _aligned(a: np.ndarray, b: np.ndarray, config: ScoringConfig) -> tuple[dict, np.ndarray | None]:
    """How b is mapped onto a, and the map; the reason says why it isn't used."""
    grey = [I.luma(x) for x in (a, b)]
    points = [I.corners(g) for g in grey]
    if min(map(len, points)) < 4:
        return {"reason": "few_keypoints"}, None
    found = I.ratio_matches(I.descriptors(grey[0], points[0]), I.descriptors(grey[1], points[1]), config.ratio)
    if len(found) < config.min_inliers:
        return {"reason": "few_matches"}, None
    h, good = I.ransac(points[1][found[:, 1]], points[0][found[:, 0]])
    if h is None:
        return {"reason": "no_homography"}, None
    scale = (np.hypot(h[0, 0], h[1, 0]) + np.hypot(h[0, 1], h[1, 1])) / 2
    turn = np.degrees(np.arctan2(h[1, 0], h[0, 0]))
    done = {"inliers": int(good.sum()), "scale": scale, "rotation": turn}
    if done["inliers"] < config.min_inliers:
        return {"inliers": done["inliers"], "reason": "few_inliers"}, None
    if not 1 / config.max_scale <= scale <= config.max_scale:
        return done | {"reason": "scale"}, None
    return (done | {"reason": "rotation"}, None) if abs(turn) > config.max_rotation else (done | {"reason": "applied"}, h)


ALIGNED = "pair_id string, applied boolean, reason string, scale double, rotation double, inliers int"


def align_pairs(pairs: DataFrame, config: ScoringConfig = ScoringConfig(), warp: bool = False, inflate: bool = False) -> DataFrame:
    """pairs: (pair_id, a and b as structs of an image).  Scale, rotation, inliers and whether b can be
    warped onto a, with the reason if not.  A pair that can't be worked on has `error` and what it
    was as its reason.  warp: adds b as seen from a, as columns of an image.  inflate: data is `deflated`."""
    names = [c.split()[0] for c in ALIGNED.split(", ")] + (["data", "width", "height", "nChannels"] if warp else [])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            for row in pdf.itertuples():
                done = dict.fromkeys(names) | {"pair_id": row.pair_id, "applied": False}
                try:
                    both = [pd.Series(x if isinstance(x, dict) else x.asDict(), dtype=object) for x in (row.a, row.b)]
                    for x in both if inflate else ():
                        x["data"] = zlib.decompress(x["data"])
                    a, b = map(pixels, both)
                    found, h = _aligned(a, b, config)
                    done |= found | {"applied": h is not None}
                    if warp and h is not None:
                        height, width = a.shape[:2]
                        seen = I.warped(b.astype(float), h, width, height).round().astype(np.uint8)
                        done |= {"data": seen[:, :, ::-1].tobytes(), "width": width, "height": height, "nChannels": 3}
                except Exception as e:  # one bad pair must not stop the others; it is reported
                    done |= {"applied": False, "reason": f"error: {type(e).__name__}: {e}"}
                yield done

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return framed(made(batches), names)

    return pairs.select("pair_id", "a", "b").mapInPandas(work, ALIGNED + (", data binary, width int, height int, nChannels int" if warp else ""))


Decoder = Callable[[bytes], np.ndarray]


def ppm(content: bytes) -> np.ndarray:
    """RGB of a binary portable pixmap of 8 bits; other decoders of whole files can stand in its place."""
    head = re.match(rb"P6\s+(\d+)\s+(\d+)\s+255\s", content)  # one space, what follows are pixels
    if head is None:
        raise ValueError("no pixmap of 8 bits")
    return np.frombuffer(content, np.uint8, offset=head.end()).reshape(int(head[2]), int(head[1]), 3)


def decoded(files: DataFrame, decode: Decoder, keep: bool = False) -> DataFrame:
    """files: (id, content).  (id, data, width, height, nChannels) as of Spark's image source, all null
    where there is no content or it can't be decoded.  keep: content in place of data."""
    names = ["id", "content" if keep else "data", "width", "height", "nChannels"]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            for row in pdf.itertuples():
                done = dict.fromkeys(names) | {"id": row.id}
                try:
                    rgb = decode(bytes(row.content))
                    done |= {"width": rgb.shape[1], "height": rgb.shape[0], "nChannels": 3}
                    done |= {"content": bytes(row.content)} if keep else {"data": np.ascontiguousarray(rgb[:, :, ::-1]).tobytes()}
                except Exception:  # what can't be decoded counts as failed
                    pass
                yield done

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return framed(made(batches), names)

    kind = files.schema["id"].dataType.simpleString()
    return files.select("id", "content").mapInPandas(work, f"id {kind}, {names[1]} binary, width int, height int, nChannels int")


def equal_files(files: DataFrame) -> DataFrame:
    """files: (path, content).  Each file with the first path of equal bytes, where that is another."""
    keyed = files.select("path", F.sha2("content", 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("path").alias("first_path"))
    return keyed.join(first, "key").filter("path <> first_path").select(F.col("first_path").alias("path_a"), F.col("path").alias("path_b"))
