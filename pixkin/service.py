"""Request checks, the error catalogue and responses."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np

from pixkin.sources.images import LEAST_SIDE

TIMEOUT = 15.0

#: Codes and HTTP statuses are fixed values, the messages are our own.
ERRORS = {
    "MISSING_FIELDS": (400, "The request lacks image_url or level_ids"),
    "INVALID_IMAGE_URL": (400, "image_url has to begin with http:// or https://"),
    "INVALID_LEVEL_ID": (400, "level_ids has to name at least one level"),
    "IMAGE_FETCH_FAILED": (502, "The image could not be fetched"),
    "IMAGE_DECODE_FAILED": (422, "What was fetched is no image"),
    "IMAGE_TOO_SMALL": (422, "The image has a side of fewer than 64 pixels"),
    "NO_SONGS_FOR_LEVEL": (404, "The levels have no songs"),
    "NO_INDEXED_SONGS": (404, "No song of the levels is in the index"),
    "INDEX_NOT_FOUND": (503, "There is no index yet"),
    "MONGO_ERROR": (503, "The songs could not be read"),
    "PIPELINE_ERROR": (500, "The comparison failed"),
    "DOC_ALREADY_INDEXED": (409, "The song is in the index already and can be edited"),
    "DOC_NOT_FOUND": (404, "The song is not in the index"),
    "EMBEDDER_NOT_READY": (503, "There is no function for embeddings"),
    "INDEX_WRITE_FAILED": (500, "The index could not be written"),
}
#: What each verdict says.
DESCRIPTIONS = {
    "EXACT": "the same image",
    "MICRO_VARIANT": "the same image with slight changes",
    "MODIFIED_VARIANT": "the same image with clear changes",
    "DISTANT": "images that share parts",
    "DISTINCT": "different images",
}


class ServiceError(Exception):
    """An error of the catalogue; its status always comes from there."""

    def __init__(self, code: str, message: str | None = None):
        self.code = code
        self.status, default = ERRORS.get(code, (500, ERRORS["PIPELINE_ERROR"][1]))
        self.message = message or default
        super().__init__(self.message)

    def body(self) -> str:
        return json.dumps({"error": self.code, "message": self.message})


def _url(value: object) -> str:
    if not isinstance(value, str) or not value.startswith(("http://", "https://")):
        raise ServiceError("INVALID_IMAGE_URL")
    return value


def check_request(body: str) -> tuple[str, list[str], str | None]:
    """The image's URL, the level ids and the id to leave out, of a duplicate check."""
    try:
        fields = json.loads(body)
    except ValueError:
        raise ServiceError("MISSING_FIELDS", "The body is no JSON") from None
    if not isinstance(fields, dict) or not fields.get("image_url") or fields.get("level_ids") is None:
        raise ServiceError("MISSING_FIELDS")
    url, levels = _url(fields["image_url"]), fields["level_ids"]
    levels = [s for x in (levels if isinstance(levels, list) else [levels]) if (s := str(x).strip())]
    if not levels:
        raise ServiceError("INVALID_LEVEL_ID")
    return url, levels, str(fields.get("exclude_id") or "").strip() or None


def change_request(body: str, needs_image: bool = True) -> tuple[str | None, str]:
    """The image's URL and the document's id, of add, edit and (without image) delete."""
    try:
        fields = json.loads(body)
    except ValueError:
        raise ServiceError("MISSING_FIELDS", "The body is no JSON") from None
    doc_id = str(fields.get("doc_id") or "").strip()
    if not doc_id or (needs_image and not fields.get("image_url")):
        raise ServiceError("MISSING_FIELDS", "The request lacks " + ("image_url or doc_id" if needs_image else "doc_id"))
    return (_url(fields["image_url"]) if needs_image else None), doc_id


def response(match: dict | None) -> dict:
    """The record of a match, scores to 4 places, or nothing."""
    if not match:
        return {}
    scores = ("hash_ensemble", "dct_spectrum", "sector_grid", "global_semantic", "patch_spatial")
    place = lambda name, n=4: None if match.get(name) is None else round(match[name], n)
    return {
        "duplicate": True,
        "mongo_id": str(match["id_b"]),
        "song_name": match.get("label_b") or "",
        "yt_video_id": match.get("video_id") or "",
        "composite": place("composite"),
        "verdict": match["verdict"],
        "verdict_description": DESCRIPTIONS.get(match["verdict"], ""),
        "scores": {s: place(s) for s in scores},
        "grid": {"matrix": match.get("grid_matrix"), "min_cell": place("grid_min_cell"), "variance": place("grid_variance")},
        "alignment": {"applied": bool(match.get("align_applied")), "scale": place("align_scale"), "rotation_deg": place("align_rotation_deg", 2), "inliers": match.get("align_inliers")},
        "stages_run": list(match.get("stages_run") or ()),
        "elapsed_ms": place("elapsed_ms", 1),
    }


def health(vectors: int | None, threshold: float) -> dict:
    return {"status": "ok" if vectors is not None else "starting", "index_vectors": vectors or 0, "threshold": threshold}


def http_get(url: str, timeout: float = TIMEOUT) -> tuple[int, bytes]:
    """Status and body; redirects are followed."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "pixkin"}), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def request_image(url: str, decode: Callable[[bytes], np.ndarray], get: Callable[[str], tuple[int, bytes]] = http_get) -> np.ndarray:
    """RGB of the image that a request names, or the error that its response carries."""
    try:
        status, content = get(_url(url))
    except TimeoutError:
        raise ServiceError("IMAGE_FETCH_FAILED", f"No answer in time from {url}") from None
    except OSError as e:
        raise ServiceError("IMAGE_FETCH_FAILED", f"{url}: {e}") from None
    if not 200 <= status < 300:
        raise ServiceError("IMAGE_FETCH_FAILED", f"{url} answered with status {status}")
    try:
        rgb = decode(content)
    except Exception:
        raise ServiceError("IMAGE_DECODE_FAILED") from None
    if min(rgb.shape[:2]) < LEAST_SIDE:
        raise ServiceError("IMAGE_TOO_SMALL", f"The image has {rgb.shape[1]} x {rgb.shape[0]} pixels; {LEAST_SIDE} x {LEAST_SIDE} are needed")
    return rgb
