"""The corpus scan, the query against a level and the duplicate check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixkin.config import VECTOR, ScoringConfig
from pixkin.functions.ids import label
from pixkin.operators.knn import candidate_pairs, knn_self, restricted_each
from pixkin.operators.pairs import score_pairs


def find_duplicates(features: DataFrame, config: ScoringConfig = VECTOR) -> DataFrame:
    """Every row's neighbours, deduplicated, cut coarsely, scored and cut at the threshold."""
    pairs = candidate_pairs(knn_self(features, config.neighbours), config.coarse)
    return score_pairs(pairs, features, config, "batch", config.threshold)


def with_metadata(matches: DataFrame, songs: DataFrame) -> DataFrame:
    """songs: (song_id, song_name, name, video_id).  Labels of both sides; an unknown id is its own."""
    out = matches
    for side in "ab":
        own = songs.select(F.col("song_id").alias(f"id_{side}"), F.col("song_name").alias("_s"), F.col("name").alias("_n"))
        out = out.join(own, f"id_{side}", "left").withColumn(f"label_{side}", label(F.col("_s"), F.col("_n"), F.col(f"id_{side}"))).drop("_s", "_n")
    return out


def query_level(query: DataFrame, features: DataFrame, allowed: DataFrame, config: ScoringConfig = VECTOR, k: int | None = None, mode: str = "postfilter", threshold: float | None = None) -> DataFrame:
    """The allowed neighbours of each query, scored with the query as first image.  The queries' rows have
    to be among the features."""
    hits = restricted_each(query.select("id", "cls"), features.select("id", "cls"), allowed, k or config.neighbours, mode)
    return score_pairs(hits, features, config, "query", config.threshold if threshold is None else threshold)


def best_match(matches: DataFrame) -> DataFrame:
    """Per query the match with the highest composite; of equals the first in neighbour order."""
    first = Window.partitionBy("id_a").orderBy(F.desc("composite"), F.desc("coarse"), "id_b")
    return matches.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def check_duplicate(query: DataFrame, features: DataFrame, allowed: DataFrame, config: ScoringConfig = VECTOR) -> DataFrame:
    """Per query no row or one: the best match with rounded scores."""
    best = best_match(query_level(query, features, allowed, config))
    scores = ["composite", "hash_ensemble", "dct_spectrum", "sector_grid", "global_semantic", "patch_spatial", "grid_min_cell", "grid_variance"]
    return best.select("id_a", "id_b", "verdict", *[F.round(c, 4).alias(c) for c in scores])
