"""Scoring of candidate pairs: joins to the features, the cheap scores, a lossless prune and the patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixkin.config import PROFILES, ScoringConfig
from pixkin.functions import scores as S


def with_features(pairs: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (id_a, id_b, ...) and both sides' columns as a_ and b_; pairs without features go."""
    out = pairs
    for side in "ab":
        own = features.select(F.col("id").alias(f"id_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(own, f"id_{side}")
    return out


def patch_score(a: Column, b: Column, side: int) -> Column:
    """Mean over a's patches of the best match in b, each weighted by a Gaussian of the distance
    between their places; not symmetric.  A null side has no score, and costs nothing."""
    place = np.array([(i, j) for i in range(side) for j in range(side)], dtype=float)
    apart = ((place[:, None] - place[None]) ** 2).sum(-1)
    near = np.exp(-apart / (2 * (side / 3) ** 2))

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out, n = np.full(len(x), np.nan), side * side
        some = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        for i in range(0, len(some), 64):
            at = some[i : i + 64]
            p = np.stack(x.iloc[at].to_numpy()).reshape(len(at), n, -1)
            q = np.stack(y.iloc[at].to_numpy()).reshape(p.shape)
            out[at] = (np.matmul(p, q.transpose(0, 2, 1)) * near).max(2).mean(1).clip(0, 1)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return score(a, b)


NARROW = ["cls", "phash", "dhash", "ahash", "whash", "dct_bands", "grid"]


def cheap_scores(pairs: DataFrame, features: DataFrame, config: ScoringConfig, matrix: bool = False) -> DataFrame:
    """All scores but the patches'.  Patches are wide, so only survivors are joined to them.  matrix: adds
    grid_matrix, the cells row by row."""
    df = with_features(pairs, features, NARROW)
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    df = df.withColumn("cells", S.grid_cells(a("grid"), b("grid"), config))
    cells = F.col("cells")
    return df.select(
        *pairs.columns,
        S.hash_ensemble(a, b, config).alias("hash_ensemble"),
        S.dct_spectrum(a("dct_bands"), b("dct_bands")).alias("dct_spectrum"),
        S.mean(cells).alias("sector_grid"),
        F.array_min(cells).alias("grid_min_cell"),
        (F.array_position(cells, F.array_min(cells)) - 1).cast("int").alias("coldest_cell"),
        S.variance(cells).alias("grid_variance"),
        S.clamp(S.cosine(a("cls"), b("cls"))).alias("global_semantic"),
        *([F.transform(F.sequence(F.lit(0), F.lit(config.grid_side - 1)), lambda i: F.slice(cells, i * config.grid_side + 1, F.lit(config.grid_side))).alias("grid_matrix")] if matrix else []),
    )


def _named() -> dict[str, Column]:
    return {"hash": F.col("hash_ensemble"), "grid": F.col("sector_grid"), "dct": F.col("dct_spectrum"), "global": F.col("global_semantic"), "patch": F.col("patch_spatial")}


def score_pairs(pairs: DataFrame, features: DataFrame, config: ScoringConfig, profile: str = "batch", threshold: float | None = None, ocr: Column | None = None, matrix: bool = False) -> DataFrame:
    """Adds all scores, composite and verdict.  With a threshold, pairs that no patch score can lift
    to it never meet their patches, and only pairs that reach it are returned."""
    df = cheap_scores(pairs, features, config, matrix)
    kind = PROFILES[profile]
    if threshold is not None and not kind.short_circuit:
        df = df.filter(S.upper_bound(_named(), F.col("grid_variance"), config) >= threshold - 1e-9)
    low = F.lit(False)
    if kind.short_circuit:  # these pairs need no vectors: they never meet their patches
        low = F.coalesce(F.col("hash_ensemble") <= config.short_low, F.lit(False))
    df = df.withColumns({f"_{s}": F.when(~low, F.col(s)) for s in ("id_a", "id_b")})
    for side in "ab":
        own = features.select(F.col("id").alias(f"_id_{side}"), F.col("patches").alias(f"{side}_patches"))
        df = df.join(own, f"_id_{side}", "left")
    df = df.filter(low | (F.col("a_patches").isNotNull() & F.col("b_patches").isNotNull()))
    df = df.withColumn("patch_spatial", F.coalesce(patch_score(F.col("a_patches"), F.col("b_patches"), config.patch_side), F.lit(0.0))).drop("a_patches", "b_patches", "_id_a", "_id_b")
    if kind.short_circuit:
        df = df.withColumn("global_semantic", F.when(low, 0.0).otherwise(F.col("global_semantic")))
    df = df.withColumn("composite", S.composite(_named(), F.col("grid_variance"), config, kind, ocr))
    df = df.withColumn("verdict", S.verdict(F.col("composite")))
    return df if threshold is None else df.filter(F.col("composite") >= threshold)
