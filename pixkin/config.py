"""Scoring settings and the three scoring profiles."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

#: The cuts of the verdicts, highest first, all inclusive.
VERDICTS = ((0.97, "EXACT"), (0.88, "MICRO_VARIANT"), (0.70, "MODIFIED_VARIANT"), (0.50, "DISTANT"))
LOWEST_VERDICT = "DISTINCT"


@dataclass(frozen=True)
class Profile:
    """What a scorer does beside the five scores: the grid veto, the OCR penalty and the short circuits on the
    hash score."""

    name: str
    veto: bool
    ocr: bool
    short_circuit: bool


PROFILES = {
    "live": Profile("live", veto=False, ocr=True, short_circuit=True),
    "query": Profile("query", veto=True, ocr=False, short_circuit=False),
    "batch": Profile("batch", veto=False, ocr=False, short_circuit=False),
}


@dataclass(frozen=True)
class ScoringConfig:
    # shares of the composite
    weights: dict[str, float] = field(default_factory=lambda: {"hash": 0.25, "grid": 0.30, "dct": 0.05, "global": 0.20, "patch": 0.20})
    # shares of the hash ensemble
    hash_weights: dict[str, float] = field(default_factory=lambda: {"phash": 0.35, "dhash": 0.35, "ahash": 0.15, "whash": 0.15})
    variance_penalty: float = 1.20
    veto_below: float = 0.65
    veto_factor: float = 1.1
    ocr_weight: float = 0.15
    ocr_trigger: float = 0.3
    short_high: float = 0.99
    short_low: float = 0.05
    neighbours: int = 20
    threshold: float = 0.80
    coarse_margin: float = 0.05
    coarse_floor: float = 0.65
    min_inliers: int = 12
    max_scale: float = 2.5
    max_rotation: float = 30.0
    ratio: float = 0.75
    embed_batch: int = 16
    # shapes
    canonical: tuple[int, int] = (480, 360)
    hash_size: int = 16
    grid_side: int = 8
    grid_hash_size: int = 8
    dct_side: int = 64
    patch_side: int = 14

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1) > 1e-9 or abs(sum(self.hash_weights.values()) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")

    @property
    def coarse(self) -> float:
        return max(self.threshold - self.coarse_margin, self.coarse_floor)


#: For vectors of 64 components that stand for images: a 4 x 4 grid of 4 bits and 16 patches of 4 components.
VECTOR = ScoringConfig(threshold=0.50, coarse_floor=0.30, coarse_margin=0.20, hash_size=8, grid_side=4, grid_hash_size=2, patch_side=4)


PREFIX = "pixkin"


def configured(spark: SparkSession | None = None, options: Mapping[str, object] | None = None, environ: Mapping[str, str] | None = None, base: ScoringConfig = ScoringConfig()) -> ScoringConfig:
    """base with what is set elsewhere: options first, then the session's `pixkin.<field>`, then the environment's
    PIXKIN_<FIELD>.  Only single numbers can be set; an unknown option or a value that is no number is an error."""
    environ, options = os.environ if environ is None else environ, dict(options or {})
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base) if isinstance(getattr(base, f.name), int | float)}
    if unknown := set(options) - set(kinds):
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    found = {}
    for name, kind in kinds.items():
        conf = spark.conf.get(f"{PREFIX}.{name}", None) if spark else None
        value = next((v for v in (options.get(name), conf, environ.get(f"{PREFIX}_{name}".upper())) if v is not None), None)
        if value is not None:
            try:
                found[name] = kind(value)
            except (TypeError, ValueError):
                raise ValueError(f"{name} has to be a number, not {value!r}") from None
    return ScoringConfig(**{**base.__dict__, **found})
