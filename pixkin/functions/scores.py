"""Stage scores, composite and verdict as column expressions.

Bits are signatures (longs), vectors arrays of doubles; shapes come from the configuration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixkin.config import LOWEST_VERDICT, VERDICTS, Profile, ScoringConfig
from pixkin.functions.signatures import differing, differing_in_runs
from pixkin.functions.transform import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon)


def bit_similarity(a: Column, b: Column, bits: int) -> Column:
    """1 - share of differing bits."""
    return 1 - differing(a, b, bits) / bits


def hash_ensemble(a: Callable[[str], Column], b: Callable[[str], Column], config: ScoringConfig) -> Column:
    parts = [F.lit(w) * bit_similarity(a(h), b(h), config.hash_size**2) for h, w in config.hash_weights.items()]
    return parts[0] + parts[1] + parts[2] + parts[3]


def grid_cells(a: Column, b: Column, config: ScoringConfig) -> Column:
    """The similarity of each cell, row by row, from the cells' bits one after the other."""
    bits = config.grid_hash_size**2
    return F.array(*[1 - d / bits for d in differing_in_runs(a, b, config.grid_side**2, bits)])


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def variance(values: Column) -> Column:
    """Population variance."""
    return let(mean(values), lambda m: total(F.transform(values, lambda x: x * x)) / F.size(values) - m * m)


def dct_spectrum(a: Column, b: Column) -> Column:
    return clamp(cosine(a, b, 1e-9))


def weighted(scores: dict[str, Column], config: ScoringConfig) -> Column:
    out = F.lit(0.0)
    for name, w in config.weights.items():
        out = out + scores[name] * w
    return out / sum(config.weights.values())


def ocr_penalised(composite: Column, similarity: Column, config: ScoringConfig) -> Column:
    differ = 1 - similarity
    cut = F.greatest(F.lit(0.0), composite - config.ocr_weight * differ)
    return F.when(similarity.isNotNull() & (differ > config.ocr_trigger), cut).otherwise(composite)


def composite(scores: dict[str, Column], grid_variance: Column, config: ScoringConfig, profile: Profile, ocr: Column | None = None) -> Column:
    """Weighted mean less the variance penalty, from 0 to 1; then the profile's veto or OCR penalty."""
    out = clamp(weighted(scores, config) - config.variance_penalty * grid_variance)
    if profile.veto:
        out = F.when(scores["grid"] < config.veto_below, F.least(out, scores["grid"] * config.veto_factor)).otherwise(out)
    if profile.ocr and ocr is not None:
        out = ocr_penalised(out, ocr, config)
    if profile.short_circuit:
        out = F.when(scores["hash"] >= config.short_high, scores["hash"]).otherwise(out)
    return out


def upper_bound(scores: dict[str, Column], grid_variance: Column, config: ScoringConfig) -> Column:
    """The composite with a perfect patch score: what lies below a threshold here needs no patches."""
    return weighted(scores | {"patch": F.lit(1.0)}, config) - config.variance_penalty * grid_variance


def verdict(score: Column) -> Column:
    out = None
    for cut, code in VERDICTS:
        out = F.when(score >= cut, code) if out is None else out.when(score >= cut, code)
    return out.otherwise(LOWEST_VERDICT)


#: Heat colours and shades by the least similarity that has them.
HEAT = ((0.95, 21), (0.85, 39), (0.70, 48), (0.55, 226), (0.40, 208))
COLDEST = 196
SHADES = ((0.90, "██"), (0.75, "▓▓"), (0.55, "▒▒"), (0.35, "░░"))
LIGHTEST = ".."
#: The verdicts' badges.
BADGES = {"EXACT": "#ff4444", "MICRO_VARIANT": "#ff8800", "MODIFIED_VARIANT": "#ffcc00", "DISTANT": "#88aaff", "DISTINCT": "#888888"}


def bucket(x: Column, steps: tuple, rest) -> Column:
    out = F.when(x >= steps[0][0], F.lit(steps[0][1]))
    for cut, value in steps[1:]:
        out = out.when(x >= cut, F.lit(value))
    return out.otherwise(F.lit(rest))


def score_colour(score: Column) -> Column:
    t = clamp((score - 0.80) / 0.20)
    return F.format_string("rgb(%d,%d,60)", F.floor(255 * (1 - t)), F.floor(200 * t + 55))


def badge_colour(code: Column) -> Column:
    out = F.lit("#888888")
    for name, colour in BADGES.items():
        out = F.when(code == name, colour).otherwise(out)
    return out


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the stripped texts; both empty 1, one empty 0."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    a, b = strip(a), strip(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def homography_parts(h00: Column, h01: Column, h10: Column, h11: Column) -> tuple[Column, Column]:
    """Scale (mean length of the first two columns) and rotation in degrees."""
    scale = (F.sqrt(h00 * h00 + h10 * h10) + F.sqrt(h01 * h01 + h11 * h11)) / 2
    return scale, F.degrees(F.atan2(h10, h00))


def alignment_reason(inliers: Column, scale: Column, rotation: Column, config: ScoringConfig) -> Column:
    return (
        F.when(inliers < config.min_inliers, "few_inliers")
        .when((scale < 1 / config.max_scale) | (scale > config.max_scale), "scale")
        .when(F.abs(rotation) > config.max_rotation, "rotation")
        .otherwise("applied")
    )


def zoom_label(scale: Column) -> Column:
    return F.when(scale > 1.005, "zoomed in").when(scale < 0.995, "zoomed out").otherwise("identical")
